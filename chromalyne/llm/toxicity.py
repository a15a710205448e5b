"""Toxic span tagging with a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import Words, carried_row, crc_rest, fitted, map_arrow, slices, training_rows, with_row

SLICE_BYTES = 2 << 20
PREFIXES = (None, 3, 4, 5, 6, 7)
BITS = 20
CHUNK = 256
#: Texts whose words are looked up at once in training.
PIECE = 200
SCHEMA = "doc_id long, score double, n_toxic_words long, expected_toxic_words double, spans array<struct<start: long, end: long, score: double>>"


def features(words: Words) -> np.ndarray:
    """Of each word: slots of its whole and of its beginnings, words x len(PREFIXES). ASCII capitals are folded by Words."""
    out = np.empty((len(words.starts), len(PREFIXES)), np.int32)
    for k, prefix in enumerate(PREFIXES):
        h = words.hashes(prefix) + np.uint64(k)
        out[:, k] = ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


def label_tokens(slots: np.ndarray, row: np.ndarray, toxic: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Token labels from document labels.

    A slot is a marker if toxic documents have it at ten times the clean ones' rate or more, and that is no chance: the
    log likelihood ratio of its document counts is 12 or more. `kept` leaves one of each group of near copies. Toxic
    documents that no marker explains add the slots that explain most of them, as long as a clean slot would hardly be
    in so many toxic documents alone (chance below exp(-8) each) and they explain 0.5 % of all. Words of toxic
    documents with a marker are labelled 1, all others 0.
    """
    size = 1 << BITS
    first = np.searchsorted(row, np.arange(len(toxic) + 1))
    seen = lambda i: np.unique(slots[first[i] : first[i + 1]])
    pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for i in np.flatnonzero(kept).tolist():
        (pos if toxic[i] else neg)[seen(i)] += 1
    n_pos, n_neg = max(1, int((toxic & kept).sum())), max(1, int((~toxic & kept).sum()))
    share = n_pos / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(pos > 0, pos * np.log(pos / (pos + neg) / share), 0.0) + np.where(neg > 0, neg * np.log(neg / (pos + neg) / (1 - share)), 0.0)
    rare = (neg + 0.5) / n_neg < pos / n_pos / 10
    marker = (ratio >= 12) & rare
    least = max(8 / -math.log(share), 0.005 * n_pos)
    left = np.flatnonzero(toxic & kept).tolist()
    while left := [i for i in left if not marker[slots[first[i] : first[i + 1]]].any()]:
        gain = np.zeros(size, np.int32)
        for i in left:
            gain[seen(i)] += 1
        gain *= rare | (neg == 0)
        if gain.max() < least:
            break
        marker |= gain == gain.max()
    return (marker[slots].any(1) & toxic[row]).astype(np.int8)


def chunked(first: np.ndarray, counts: np.ndarray, warm: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (time x chunks, -1 outside the document) of stretches of `size` words with `warm` more on both sides, and which of them are a chunk's own."""
    per = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), per)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * size
    t = np.arange(-warm, size + warm)[:, None] + at[None, :]
    inside = (t >= 0) & (t < counts[doc][None, :])
    own = inside.copy()
    own[:warm] = False
    own[warm + size :] = False
    return np.where(inside, t + first[:-1][doc][None, :], -1), own


def marginals(unary: np.ndarray, first: np.ndarray, counts: np.ndarray, start: float, trans: np.ndarray) -> np.ndarray:
    """P(label 1) of every word, documents side by side.

    With two labels, forward and backward messages are one ratio each, and one step contracts the log ratio by
    tanh(d / 4), d the log odds ratio of the transitions (Birkhoff). Chunks therefore start `warm` words early from any
    ratio and are exact to 1e-9 when they begin; a chunk at a document's border starts exactly. Transitions so strong
    that the longest document is no warm-up make every chunk begin at its document's border. Chunks are never shorter
    than their warm-up, so at most three times the words are held.
    """
    if not len(unary):
        return np.zeros(0)
    odds = abs(trans[0, 0] + trans[1, 1] - trans[0, 1] - trans[1, 0])
    rate, longest = math.tanh(odds / 4), int(counts.max())
    warm = 1 if rate < 1e-9 else longest if rate >= 1 else min(longest, math.ceil(math.log(1e-9) / math.log(rate)))
    where, own = chunked(first, counts, warm, max(CHUNK, warm))
    steps = len(where)
    e = np.exp(np.clip(unary, -30, 30))[where]  # -1 reads the last word, masked below
    a00, a01, a10, a11 = np.exp(trans).ravel()
    there = where >= 0
    ahead = np.empty(where.shape)
    r = np.zeros(where.shape[1])
    for t in range(steps):
        begins = there[t] if t == 0 else there[t] & ~there[t - 1]
        moved = (a01 + r * a11) / (a00 + r * a10)
        r = np.where(begins, math.exp(start), moved) * e[t]
        ahead[t] = r
    b = np.ones(where.shape[1])
    out = np.empty(len(unary))
    for t in range(steps - 1, -1, -1):
        ends = there[t] if t == steps - 1 else there[t] & ~there[t + 1]
        b = np.where(ends, 1.0, b)
        mine = own[t]
        ratio = ahead[t][mine] * b[mine]
        out[where[t][mine]] = ratio / (1.0 + ratio)
        step = e[t] * b
        b = (a10 + a11 * step) / (a00 + a01 * step)
    return out


@dataclass
class Tagger:
    weights: np.ndarray  # of every slot, float32
    bias: float
    start: float
    trans: np.ndarray
    scale: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def unary(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(1, dtype=np.float64) + self.bias

    def tag(self, words: Words) -> np.ndarray:
        return marginals(self.unary(features(words)), words.first, words.counts, self.start, self.trans)

    def score(self, expected: np.ndarray, density: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(a * np.log1p(expected) + b * density + c, -30, 30)))


def _messages(e: np.ndarray, live: np.ndarray, start: float, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Forward-backward on sequences side by side (time x sequences), all beginning at 0: P(1), expected transitions (2 x 2)."""
    steps, n = e.shape
    alpha = np.empty((steps, 2, n))
    alpha[0] = np.stack([np.ones(n), math.exp(start) * e[0]])
    alpha[0] /= alpha[0].sum(0)
    for t in range(1, steps):
        x = np.stack([alpha[t - 1][0] * a[0, 0] + alpha[t - 1][1] * a[1, 0], (alpha[t - 1][0] * a[0, 1] + alpha[t - 1][1] * a[1, 1]) * e[t]])
        alpha[t] = x / x.sum(0)
    beta = np.ones((2, n))
    p = np.zeros((steps, n))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        on = live[t]
        both = alpha[t] * beta
        both /= both.sum(0)
        p[t] = np.where(on, both[1], 0.0)
        if t:
            out = np.stack([beta[0], beta[1] * e[t]])
            joint = alpha[t - 1][:, None, :] * a[:, :, None] * out[None, :, :]
            joint /= joint.sum((0, 1))
            pairs += joint[:, :, on].sum(2)
            back = np.stack([a[0, 0] * out[0] + a[0, 1] * out[1], a[1, 0] * out[0] + a[1, 1] * out[1]])
            beta = np.where(on, back / back.sum(0), 1.0)
    return p, pairs


def train(texts: list[str], toxic: np.ndarray, prior: tuple[float, float], epochs: int = 4, least_steps: int = 300, length: int = 64, plain: int = 3, seed: int = 0) -> Tagger:
    """Fit tagger and document scale on labelled texts.

    The chain is trained on sequences of `length` words by gradient ascent of the conditional likelihood with AdaGrad: all
    with a labelled token, and `plain` times as many others (and 200), drawn at random, for `epochs` epochs and
    least_steps steps. prior: rates of clean and toxic labels in the whole table; the document scale weights the classes
    of the sample by them.
    """
    tagger = Tagger(np.zeros(1 << BITS, np.float32), -4.0, 0.0, np.zeros((2, 2)))
    if len(texts) == 0 or not toxic.any() or toxic.all():
        tagger.scale = (0.0, 0.0, math.log(max(prior[1], 1e-3) / max(prior[0], 1e-3)))
        return tagger
    found = []
    for i in range(0, len(texts), PIECE):
        words = Words(pa.array(texts[i : i + PIECE], pa.large_string()), lower=True)
        found.append((features(words), words.hashes(), words.counts))
    slots, whole, counts = (np.concatenate(x) for x in zip(*found))
    row, first_word = np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)])
    del found, words
    least: dict[int, int] = {}
    kept = np.zeros(len(texts), bool)
    for i in range(len(texts)):
        own = whole[first_word[i] : first_word[i + 1]]
        mark = int(own.min()) if len(own) < 40 else int((own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:]).min()) if len(own) else -1
        kept[i] = least.setdefault(mark, i) == i
    labels = label_tokens(slots, row, toxic, kept)
    starts, sizes = [], []
    for first, count in zip(first_word.tolist(), counts.tolist()):
        for at in range(0, count, length):
            starts.append(first + at), sizes.append(min(length, count - at))
    starts, sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
    marked = np.add.reduceat(labels.astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
    rng = np.random.default_rng(seed)
    chosen = np.concatenate([np.flatnonzero(marked), rng.permutation(np.flatnonzero(~marked))[: plain * int(marked.sum()) + 200]])
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    other, o2 = np.array([-4.0, 0.0, 0.0, 0.0, 0.0]), np.full(5, 1.0)
    for _ in range(max(epochs, -(-least_steps * 256 // max(1, len(chosen))))):
        order = rng.permutation(chosen)
        for i in range(0, len(order), 256):
            some = order[i : i + 256]
            t = np.arange(length)[:, None]
            live = t < sizes[some][None, :]
            at = np.minimum(starts[some][None, :] + t, len(labels) - 1)
            f = slots[at]
            u = w[f].sum(2) + other[0]
            trans = np.array([[0.0, other[2]], [other[3], other[4]]])
            p, pairs = _messages(np.exp(np.clip(u, -30, 30)), live, other[1], np.exp(trans))
            y = np.where(live, labels[at], 0)
            error = np.where(live, y - p, 0.0)
            gw = np.bincount(f.ravel(), np.repeat(error.ravel(), f.shape[2]), minlength=1 << BITS) - 1e-4 * w
            g2 += gw * gw
            w += 0.2 * gw / np.sqrt(g2)
            on = live[1:]
            seen = np.array([[((y[:-1] == j) & (y[1:] == k) & on).sum() for k in (0, 1)] for j in (0, 1)])
            go = np.array([error.sum(), error[0].sum(), *(seen - pairs).ravel()[1:]]) - 1e-2 * other
            o2 += go * go
            other += 0.2 * go / np.sqrt(o2)
    tagger = Tagger(w.astype(np.float32), float(other[0]), float(other[1]), np.array([[0.0, other[2]], [other[3], other[4]]]))
    del slots, row, whole, labels
    found = []
    for i in range(0, len(texts), PIECE):
        part = Words(pa.array(texts[i : i + PIECE], pa.large_string()), lower=True)
        found.append(document_evidence(tagger.tag(part), part))
    tagger.scale = _scale(tuple(np.concatenate(x) for x in zip(*found)), toxic, prior)
    return tagger


def document_evidence(p: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Expected toxic words of each document, and log(1 + those per 200 words): one marked word weighs more in a short
    text. Marginals below 0.01 are noise of many clean words and count as 0."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.01, p, 0.0))])
    expected = np.maximum(0.0, sums[words.first[1:]] - sums[words.first[:-1]])
    return expected, np.log1p(200.0 * expected / np.maximum(words.counts, 1))


def _scale(x: tuple[np.ndarray, np.ndarray], toxic: np.ndarray, prior: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic regression of the document label on log(1 + expected) and the density, by Newton steps with a
    small penalty; on the first alone where a slope would be negative, so more evidence never lowers a score."""
    weight = np.where(toxic, prior[1] / max(1, toxic.sum()), prior[0] / max(1, (~toxic).sum())) * len(toxic) / sum(prior)

    def fitted(*columns: np.ndarray) -> np.ndarray:
        f = np.column_stack([*columns, np.ones(len(toxic))])
        penalty = np.array([1e-2] * len(columns) + [1e-6])
        beta = np.zeros(f.shape[1])
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-f @ beta))
            hess = (f * (weight * p * (1 - p))[:, None]).T @ f + np.diag(penalty)
            step = np.linalg.solve(hess, f.T @ (weight * (toxic - p)) - penalty * beta)
            beta = beta + np.clip(step, -2, 2)
            if abs(step).max() < 1e-6:
                break
        return beta

    a, b, c = fitted(np.log1p(x[0]), x[1])
    if a < 0 or b < 0:
        (a, c), b = fitted(np.log1p(x[0])), 0.0
    return float(a), float(b), float(c)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", a_class: int = 3000, most_bytes: int = 50_000) -> Tagger:
    """A Tagger from labelled documents whose key is not held out: at most a_class of each label, texts of at most most_bytes.

    Held out are keys whose CRC-32 as text leaves 1 modulo 3. Class rates come from all labels that are not. One task
    holds the sample and fits; the driver gets the Tagger alone.
    """
    marks = labels.where((crc_rest(key, 3) != 1) & F.col(label).isin(0, 1)).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y")).dropDuplicates(["__id"])
    rates = {r["__y"]: r["n"] for r in marks.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(marks, "__id")
    sample = training_rows(rows, "__y", a_class, most_bytes, "__id", "__text", texts=docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")))
    total = max(1, sum(rates.values()))
    prior = (rates.get(0, 0) / total, rates.get(1, 0) / total)

    def fit(held: list[tuple]) -> Tagger:
        return train([r[2] for r in held], np.array([r[0] == 1 for r in held], bool), prior)

    return train([], np.zeros(0, bool), prior) if sample is None else fitted(sample, ["by", "place", "text"], fit)


def _tagged(model, carried: bool):
    def run(batch: pa.RecordBatch):
        tagger = model.value
        for part in slices(batch, "text", SLICE_BYTES):
            words = Words(part.column("text"), lower=True)
            p = tagger.tag(words)
            expected, density = document_evidence(p, words)
            score = tagger.score(expected, density)
            hot = np.flatnonzero(p >= 0.5)
            spans: list[list[dict]] = [[] for _ in score]
            if len(hot):
                row = words.row_of()[hot]
                for own in np.split(np.arange(len(hot)), np.flatnonzero((np.diff(hot) > 1) | (np.diff(row) > 0)) + 1):
                    i, j, d = hot[own[0]], hot[own[-1]], row[own[0]]
                    at = int(words.ends[d])
                    spans[d].append({"start": int(words.starts[i]) - at, "end": int(words.stops[j]) - at, "score": float(p[i : j + 1].mean())})
            counts = np.bincount(words.row_of()[hot], minlength=len(score)) if len(hot) else np.zeros(len(score), np.int64)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            columns = [part.column("doc_id"), pa.array(score), pa.array(counts.astype(np.int64)), pa.array(expected), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns + ([part.column("row")] if carried else []), ["doc_id", "score", "n_toxic_words", "expected_toxic_words", "spans"] + ["row"] * carried)

    return run


def tag_toxicity(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Score every whole text and give its offending spans.

    Returns a row per input row: doc_id, score (0 to 1), n_toxic_words (marginal of 0.5 or more), expected_toxic_words
    and spans (byte offsets in the UTF-8 text, end exclusive, mean marginal). The key is a whole number (cast to long);
    rows with a null key are tagged like others, repeated rows alike. A marginal of exactly 0.5 is in a span. Null and
    empty texts have no words and get the score of a text without evidence. Long texts are tagged whole, in chunks with
    exact borders. The model (one float32 per slot, 4 MB) is broadcast. Only the key and text are read; with `carry`, all input columns come back as a
    struct column `row`, where names can't clash. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carried_row(docs, carry))
    return map_arrow(own, _tagged(model, carry), with_row(SCHEMA, own))
