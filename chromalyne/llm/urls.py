"""URL filters: allow and block rules, and block decisions that reach aliases over redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import written
from chromalyne.llm.components import components

#: Rules that are broadcast at most.
BROADCAST_RULES = 50_000
#: Parameters that name where a visit came from, not what is shown.
TRACKING = r"(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"
#: Where a page names its canonical address or sends its readers on.
LINKS = (
    r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*\bhref=["']?([^"'\s>]+)""",
    r"""(?i)<link\b[^>]*\bhref=["']?([^"'\s>]+)["']?[^>]*\brel=["']?canonical""",
    r"""(?i)<meta\b[^>]*\bhttp-equiv=["']?refresh["']?[^>]*\burl=["']?([^"'\s>]+)""",
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without :// (or null) empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """One name for the spellings of an address: no scheme, www., fragment, tracking parameters or last slash; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    name = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", name)


def _flat(path: Column) -> Column:
    """A path without . and .. segments."""
    whole = F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/")
    empty = F.array().cast("array<string>")

    def step(kept: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    return F.array_join(F.aggregate(F.split(whole, "/"), empty, step), "/")


def resolved(source: Column, target: Column) -> Column:
    """The url that a link's target names on a page; null for what is no address of its own (a fragment, mailto: and the like)."""
    site, path = F.concat(F.lit("http://"), host_of(source)), path_of(source)
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, _flat(own), rest))
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(F.concat(site, _flat(F.concat(folder, own)), rest))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): the url of each page and of each of its canonical links and refresh targets, relative ones resolved."""
    body = F.coalesce(F.col(html), F.lit(""))
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in LINKS]))
    spread = pages.where(body.rlike("|".join(f"({p})" for p in LINKS))).select(F.col(url).alias("source"), F.explode(found).alias("target"))
    return spread.select(F.col("source").alias("u"), resolved(F.col("source"), F.regexp_replace("target", "&amp;", "&")).alias("v"))


def judge(urls: DataFrame, rules: DataFrame, key: str = "key") -> DataFrame:
    """(key, rule, verdict) of keys that a rule fits: urls has key, host, path; rules has host, path, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest (host and path together)
    wins, of equal ones allow. Hosts are spread over their suffixes, so rules are joined by equality.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spread = urls.select(F.col(key).alias("key"), "path", F.explode(suffixes).alias("suffix"))
    own = rules.where("host is not null and verdict in ('allow', 'block')").select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    own = F.broadcast(own) if own.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else own
    fits = spread.join(own, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("key").agg(F.max(F.struct(F.length(name).alias("n"), (F.col("verdict") == "allow").alias("allow"), name.alias("rule"), "verdict")).alias("best"))
    return best.select("key", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Judge every page's url.

    rules: host, path, verdict. edges: (u, v) redirects between urls, added to the pages' own canonical and refresh
    links. Returns a row per input row: page_id, host, path, rule (of the rule that fits, else null), verdict, alias_of
    (the smallest address of its component) and verdict_by (rule, alias or default).

    Addresses tied by links are one component. A page that a rule fits has the rule's verdict, so an explicit allow
    is never overruled by an alias. Any other page is blocked if an address of its component is blocked by a rule, and
    allowed otherwise. Addresses that are no page but that a link names are judged too. Null urls and urls without ://
    have an empty host and path, no alias and are allowed. The key is returned as it is and may be null or repeated;
    repeated rows are judged alike. Of rules of equal length an allow wins. Long pages are searched whole. Only key,
    url and html are read, so names of other columns can't clash. An empty table gives no rows. Blocked addresses, rules and
    components meet by joins on addresses and component names, large components by the skew join.
    """
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), address(F.col(url)).alias("address"))
    hops = link_edges(pages, url, html)
    if edges is not None:
        hops = hops.unionByName(edges.select("u", "v"))
    named = {end: (address(F.col(end)), host_of(F.col(end)), path_of(F.col(end))) for end in "uv"}
    hops = hops.select(*[c.alias(f"{end}{part}") for end, cells in named.items() for c, part in zip(cells, ("", "_host", "_path"))])
    links = written(hops.where("u is not null and v is not null").distinct(), "url-edges")
    hosts = own.select("host", "path").distinct().withColumn("key", F.struct("host", "path"))
    ruled = judge(hosts, rules).select(F.col("key.host").alias("rh"), F.col("key.path").alias("rp"), "rule", F.col("verdict").alias("rule_verdict"))
    judged = own.join(ruled, (F.col("host") == F.col("rh")) & (F.col("path") == F.col("rp")), "left").drop("rh", "rp")
    # urls at both ends of a link are judged by their own host and path: an address has lost the last slash, which a rule may need
    ends = links.select("u", "u_host", "u_path").union(links.select("v", "v_host", "v_path")).toDF("address", "host", "path").distinct()
    targets = ends.select(F.struct("address", "host", "path").alias("key"), "host", "path")
    blocked = judge(targets, rules).where("verdict = 'block'").select(F.col("key.address").alias("address"))
    blocked = blocked.union(judged.where("rule_verdict = 'block' and address is not null").select("address")).distinct()
    groups = written(components(links.select("u", "v"), "url-groups"), "url-groups")
    bad = blocked.join(groups, F.col("address") == F.col("node"), "left").select(F.coalesce("component", "address").alias("bad")).distinct()
    named = judged.join(groups, F.col("address") == F.col("node"), "left").withColumn("alias_of", F.coalesce("component", "address"))
    out = named.join(bad, F.col("alias_of") == F.col("bad"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad").isNotNull(), "block"), F.lit("allow"))
    by = F.when(F.col("rule_verdict").isNotNull(), "rule").when(F.col("bad").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_of", by.alias("verdict_by"))
