"""DuckDB SQL for the queries that SQL can express: 5, 7 and 9."""

from __future__ import annotations

from chromalyne.llm.urls import LINKS, TRACKING

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') s from d, unnest(range(1, len(w) - 11)) t(i)),
least as (select s, min(doc_id) m from win group by s),
gone as (select distinct doc_id, i + k place from win join least using (s), range(13) r(k) where m < doc_id),
words as (select doc_id, i place, w[i] word from d, unnest(range(1, len(w) + 1)) t(i)),
kept as (select doc_id, string_agg(word, ' ' order by place) body from words anti join gone using (doc_id, place) group by doc_id),
n as (select doc_id, count(*) n from gone group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n.n, 0)::bigint n_removed, sha256(coalesce(body, '')) kept_sha256
from d left join kept using (doc_id) left join n using (doc_id)"""

OP7 = f"""
with recursive d as (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') s from d, unnest(range(1, len(w) - 1)) t(i) where len(w) >= 3
  union all select doc_id, array_to_string(w, ' ') from d where len(w) in (1, 2)),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
edge as (select x u, y v from link union all select y, x from link),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, v from reach join edge on edge.u = reach.r)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r) component_id, min(r) = d.doc_id kept
from d left join n using (doc_id) join reach using (doc_id) group by d.doc_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _host(url: str) -> str:
    return rf"translate(regexp_extract(coalesce({url}, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _address(url: str) -> str:
    query = rf"regexp_replace(regexp_replace(regexp_extract(coalesce({url}, ''), '^[^?#]*\?([^#]*)', 1), {_quoted(TRACKING)}, '', 'g'), '^&', '')"
    return rf"(case when {_host(url)} <> '' then concat(regexp_replace({_host(url)}, '^www\.', ''), regexp_replace({_path(url)}, '/+$', ''), case when {query} <> '' then concat('?', {query}) else '' end) end)"


_TARGETS = " union ".join(f"select url source, replace(unnest(regexp_extract_all(coalesce(html, ''), {_quoted(p)}, 1)), '&amp;', '&') target from pages" for p in LINKS)


def _flat(path: str) -> str:
    parts = rf"list_transform(string_split(regexp_replace({path}, '(^|/)(\.\.?)$', '\1\2/'), '/'), lambda x: [x])"
    return f"array_to_string(list_reduce({parts}, lambda s, x: case when x[1] = '..' then s[1:greatest(len(s) - 1, 1)] when x[1] = '.' then s else s || x end), '/')"


def _resolved(source: str, target: str) -> str:
    own, rest = f"regexp_extract({target}, '^[^?#]*', 0)", f"regexp_extract({target}, '^[^?#]*(.*)$', 1)"
    folder = f"case when {_path(source)} = '' then '/' else regexp_replace({_path(source)}, '[^/]*$', '') end"
    return f"""case when {target} = '' or starts_with({target}, '#') then null when regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {target}
  when regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with({target}, '//') then 'http:' || {target}
  when starts_with({target}, '/') then concat('http://', {_host(source)}, {_flat(own)}, {rest}) when starts_with({target}, '?') then concat('http://', {_host(source)}, {_path(source)}, {target})
  else concat('http://', {_host(source)}, {_flat(f"concat({folder}, {own})")}, {rest}) end"""


def op9(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)

    def ruled(source: str) -> str:
        """(key, rule, verdict): the longest of the rules that fit rows (key, host, path)."""
        return f"""select key, rh || rp rule, verdict from {source} join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  qualify row_number() over (partition by key order by length(rh || rp) desc, verdict) = 1"""

    return f"""
with recursive rules(rh, rp, verdict) as (values {values}),
target as ({_TARGETS}),
whole as (select source, {_resolved('source', 'target')} target from target),
link as (select distinct {_address('source')} u, {_address('target')} v, source, target from whole),
edge as (select u, v from link where u is not null and v is not null union select v, u from link where u is not null and v is not null),
page as (select page_id, {_host('url')} host, {_path('url')} path, {_address('url')} address, page_id key from pages),
own as ({ruled('page')}),
urls as (select source url from link where u is not null and v is not null union select target from link where u is not null and v is not null),
ends as (select url key, {_host('url')} host, {_path('url')} path from urls),
blocked as (select {_address('key')} address from ({ruled('ends')}) e where verdict = 'block' union select address from page join own using (key) where verdict = 'block' and address is not null),
reach as (select address from blocked union select v from reach join edge on u = reach.address)
select page_id, host, path, rule, coalesce(own.verdict, case when address in (select address from reach) then 'block' end, 'allow') verdict
from page left join own using (key)"""
