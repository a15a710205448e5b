"""Document quality from a text classifier and hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import Words, crc_rest, fitted, map_arrow, slices, training_rows, written

SLICE_BYTES = 2 << 20
FEATURES = 14
#: Texts that are described at once in training.
PIECE = 200


def _kinds() -> np.ndarray:
    """Classes of bytes: letters, capitals, digits, ends of sentences, other signs, line ends."""
    out = np.zeros((256, 6), bool)
    out[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = True
    out[65:91, 1] = True
    out[48:58, 2] = True
    out[[33, 46, 63], 3] = True
    out[[b for b in range(33, 127) if not chr(b).isalnum() and b not in (33, 44, 46, 63)], 4] = True
    out[10, 5] = True
    return out


_KIND = _kinds()


def describe(column: pa.Array) -> np.ndarray:
    """Rows x FEATURES: lengths, shares of byte classes, variety of words, repeated words in a row, share of words with signs."""
    words = Words(column)
    rows = len(words.counts)
    size = np.maximum(np.diff(words.ends), 1)
    out = np.zeros((rows, FEATURES))
    filled = np.flatnonzero(np.diff(words.ends) > 0)
    for k in range(6):
        if len(filled):
            out[filled, k] = np.add.reduceat(_KIND[words.block, k].astype(np.int64), words.ends[:-1][filled]) / size[filled]
    n = np.maximum(words.counts, 1)
    some = np.flatnonzero(words.counts > 0)
    first = words.first[:-1][some]
    out[:, 6] = np.log1p(words.counts)
    if len(some):
        h, row = words.hashes(), words.row_of()
        order = np.lexsort((h, row))
        fresh = np.ones(len(h))
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        kinds = np.bincount(row, fresh, minlength=rows) if len(row) else np.zeros(rows)
        out[:, 7] = np.log1p(kinds) / np.log1p(n)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        length = (words.stops - words.starts).astype(float)
        out[some, 8] = np.add.reduceat(same, first) / n[some]
        out[some, 9] = np.add.reduceat(length, first) / n[some]
        out[some, 10] = np.add.reduceat((length == 1).astype(float), first) / n[some]
        signs = np.concatenate([[0], np.cumsum(_KIND[words.block, 4])])
        out[some, 11] = np.add.reduceat((signs[words.stops] > signs[words.starts]).astype(float), first) / n[some]
        out[some, 12] = np.add.reduceat((length > 20).astype(float), first) / n[some]
    out[:, 13] = out[:, 3] * size / n
    return out


@dataclass
class Evidence:
    """A logistic regression on standardised features and its squares, with the rate of good documents it was fitted at."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(2 * FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2 * FEATURES))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(2 * FEATURES + 1))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.column_stack([x, x * x]) - self.mean) / self.scale, -8, 8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.inputs(x) @ self.beta[:-1] + self.beta[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -12, 12)))


def fit(x: np.ndarray, good: np.ndarray, prior: float) -> Evidence:
    out = Evidence()
    if len(x) == 0:
        return out
    both = np.column_stack([x, x * x])
    out.mean, out.scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    f = np.column_stack([out.inputs(x), np.ones(len(x))])
    weight = np.where(good, prior / max(1, good.sum()), (1 - prior) / max(1, (~good).sum())) * len(x)
    penalty = np.full(f.shape[1], 1.0)
    penalty[-1] = 1e-3
    beta = np.zeros(f.shape[1])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(f @ beta, -30, 30)))
        grad = f.T @ (weight * (good - p)) - penalty * beta
        step = np.linalg.solve((f * (weight * p * (1 - p) + 1e-9)[:, None]).T @ f + np.diag(penalty), grad)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-7:
            break
    out.beta = beta
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", a_class: int = 3000, most_bytes: int = 50_000) -> Evidence:
    """Evidence from labelled documents whose key is not held out: at most a_class of each label, texts of at most most_bytes.

    Held out are keys whose CRC-32 as text leaves 1 modulo 3. One task holds the sample and fits.
    """
    marks = labels.where((crc_rest(key, 3) != 1) & F.col(label).isin(0, 1)).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y")).dropDuplicates(["__id"])
    rates = {r["__y"]: r["n"] for r in marks.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(marks, "__id")
    sample = training_rows(rows, "__y", a_class, most_bytes, "__id", "__text", texts=docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")))
    prior = (rates.get(1, 0) + 1) / (sum(rates.values()) + 2)

    def fit_rows(held: list[tuple]) -> Evidence:
        return fit(np.concatenate([describe(pa.array([r[2] for r in held[i : i + PIECE]], pa.large_string())) for i in range(0, len(held), PIECE)]), np.array([r[0] == 1 for r in held], bool), prior)

    return Evidence() if sample is None else fitted(sample, ["by", "place", "text"], fit_rows)


def document_evidence(docs: DataFrame, evidence: Evidence, key: str, text: str, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and p_doc of every row, from its whole text."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text", SLICE_BYTES):
            p = evidence.probability(describe(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p)], ["doc_id", "host", "path", "p_doc"])

    return map_arrow(own, run, "doc_id long, host string, path string, p_doc double")


def _strength(groups: DataFrame, centre: Column) -> float:
    """How many documents the prior of a level is worth: within variance over between variance, by analysis of variance.

    groups: n, total, squares (of p_doc) per group; centre: the mean that the group is drawn towards.
    """
    mean = F.col("total") / F.col("n")
    r = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
        F.sum(F.col("n") * (mean - centre) ** 2).alias("between"), F.sum(F.col("squares") - F.col("n") * mean**2).alias("within"),
    ).first()
    if not r["n"] or r["groups"] < 2 or r["n"] <= r["groups"]:
        return 10.0
    within = max(r["within"] / (r["n"] - r["groups"]), 1e-9)
    size = (r["n"] - r["nn"] / r["n"]) / (r["groups"] - 1)
    tau = (r["between"] / (r["groups"] - 1) - within) / max(size, 1e-9)
    return float(min(max(within / tau, 1.0), 1e6)) if tau > 0 else 1e6


def site_quality(evidence: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Posterior quality of documents (doc_id, host, path, p_doc) within their hosts and paths.

    A path's posterior is its documents' mean drawn towards its host's, a host's towards the global mean; how strongly
    comes from the variances between and within groups. A document is judged by its own odds times the odds of its
    path's posterior without it (nor is it in the host's mean beneath), relative to the global odds: a host's only
    document is judged by its own evidence. Adds host_posterior, path_posterior (both with all their documents), score and
    predicted. Sums per (host, path) are combined before their shuffle and written once; a large host's documents meet
    only its few path rows. evidence is read twice and should be a written table.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("total"), F.sum(F.col("p_doc") ** 2).alias("squares"))
    paths = written(paths, "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    m0 = min(max((whole["total"] or 0.0) / max(1, whole["n"] or 0), 1e-4), 1 - 1e-4)
    k_host = _strength(hosts, F.lit(m0))
    same = F.col("p.host").eqNullSafe(F.col("h.host"))
    joined = paths.alias("p").join(hosts.alias("h"), same, "left").select("p.host", "p.path", "p.n", "p.total", "p.squares", F.col("h.n").alias("host_n"), F.col("h.total").alias("host_total"))
    joined = joined.withColumn("host_posterior", (F.col("host_total") + k_host * m0) / (F.col("host_n") + k_host))
    k_path = _strength(joined, F.col("host_posterior"))
    e, s = evidence.alias("e"), joined.alias("s")
    rows = e.join(s, F.col("e.host").eqNullSafe(F.col("s.host")) & F.col("e.path").eqNullSafe(F.col("s.path")), "left")
    logit = lambda p: F.log(p / (1 - p))
    bound = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = (F.col("s.total") + k_path * F.col("host_posterior")) / (F.col("s.n") + k_path)
    host_others = (F.col("host_total") - F.col("p_doc") + k_host * m0) / (F.col("host_n") - 1 + k_host)
    others = (F.col("s.total") - F.col("p_doc") + k_path * host_others) / (F.col("s.n") - 1 + k_path)
    z = logit(bound(F.col("p_doc"))) + logit(bound(others)) - logit(F.lit(m0))
    out = rows.select("e.doc_id", "e.host", "e.path", "p_doc", "host_posterior", posterior.alias("path_posterior"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score_quality(docs: DataFrame, evidence: Evidence, host: Column, path: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Quality of every document: a row per input row with doc_id, host, path, p_doc, host_posterior, path_posterior, score, predicted.

    host and path are any column expressions over docs. The key is a whole number (cast to long) and may be null. Null
    hosts are one host, null paths one path of it. Null and empty texts have features of an empty text; long texts are
    described whole. Repeated rows count as often as they occur; a score at the threshold is predicted 1. Only key,
    text, host and path are read, so names of other columns can't clash. An empty table gives no rows.
    """
    return site_quality(written(document_evidence(docs, evidence, key, text, host, path), "evidence"), threshold)
