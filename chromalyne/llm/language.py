"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import crc_rest, fitted, map_arrow, slices, training_rows, utf8

SLICE_BYTES = 2 << 20
ORDERS = (2, 3, 4)
BITS = 18
#: Bytes of the short pieces of calibration texts that set the rejection beside the texts themselves.
PIECE = 48
UNKNOWN = "und"


def _folded() -> np.ndarray:
    """Bytes as the subwords see them: ASCII capitals folded; everything ASCII that is no letter is a border, 32."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    other = [b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]
    out[other] = 32
    return out


_FOLD = _folded()


def subwords(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order n the slots of the n bytes from every place (-1 if they leave the row or begin with two borders), and the rows' offsets."""
    block, ends = utf8(column)
    block = _FOLD[block]
    room = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(block))
    out = []
    for n in ORDERS:
        code = np.zeros(len(block), np.uint32)
        for i in range(n):
            code[: len(block) - i] |= block[i:].astype(np.uint32) << np.uint32(8 * i)
        slot = ((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        blank = room < n
        if len(block) > 1:
            blank[:-1] |= (block[:-1] == 32) & (block[1:] == 32)
        slot = slot.astype(np.int32)
        slot[blank] = -1
        out.append(slot)
    return out, ends


@dataclass
class Model:
    """The embeddings times the softmax weights, one row of scores per slot (the softmax is linear in the average; slots no
    training text has are 0), which slots training texts have, and what calibration found."""

    languages: list[str]
    scores: np.ndarray  # 2**BITS x languages, float32
    bias: np.ndarray
    seen: np.ndarray  # 2**BITS, bool
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def measure(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits (rows x languages) from all subwords of every whole text, and the share of its longest subwords that training texts have."""
        slots, ends = subwords(column)
        rows = len(ends) - 1
        total, count, known, longest = np.zeros((rows, len(self.languages))), np.zeros(rows), np.zeros(rows), np.zeros(rows)
        some = np.flatnonzero(np.diff(ends) > 0)
        if len(some):
            table = np.vstack([self.scores, np.zeros((1, len(self.languages)), np.float32)])  # slot -1 reads the zero row
            at = ends[:-1][some]
            for slot in slots:
                for k in range(len(self.languages)):
                    total[some, k] += np.add.reduceat(table[:, k][slot], at, dtype=np.float64)
                count[some] += np.add.reduceat((slot >= 0).astype(np.int64), at)
            known[some] = np.add.reduceat((np.append(self.seen, False)[slots[-1]]).astype(np.int64), at)
            longest[some] = np.add.reduceat((slots[-1] >= 0).astype(np.int64), at)
        return total / np.maximum(count, 1)[:, None] + self.bias, known / np.maximum(longest, 1)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated class probabilities, rows x languages, and the known shares."""
        logits, known = self.measure(column)
        return softmax(logits, self.temperature), known

    def rejects(self, score: np.ndarray, known: np.ndarray) -> np.ndarray:
        return (score < self.least_score) | (known < self.least_known)


def softmax(logits: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def temperature_for(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which the mean score is the accuracy that n texts bear out, (right + 1) / (n + 2).

    A mean score falls as the temperature rises, so it is found by halving. Texts that are all right don't draw it to 0,
    as the least log loss would.
    """
    goal = ((logits.argmax(1) == y).sum() + 1) / (len(y) + 2)
    low, high = 1e-4, 1e4
    for _ in range(60):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if softmax(logits, mid).max(1).mean() > goal else (low, mid)
    return float((low * high) ** 0.5)


def train(texts: list[str], langs: list[str], held: np.ndarray, dim: int = 16, epochs: int = 12, rate: float = 0.5, refused: float = 0.005, seed: int = 0) -> Model:
    """Embeddings and softmax by stochastic gradient descent on texts that are not `held`; those set temperature and rejection.

    least_score and least_known are the `refused` quantiles of the held texts' scores and known shares; for the shares a
    piece of PIECE bytes from the middle of each text counts beside the text, so that short texts of a learned language
    are not refused. About that share of texts of learned languages is refused by each; texts of others mostly fall
    below least_known, as their longest subwords are new.
    """
    languages = sorted(set(langs))
    if not languages:
        return Model([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), np.zeros(1 << BITS, bool))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in langs])
    fit, test = np.flatnonzero(~held), np.flatnonzero(held)
    bags = {}
    for i in fit.tolist():
        slots, _ = subwords(pa.array([texts[i]], pa.large_string()))
        flat = np.concatenate(slots)
        ids, n = np.unique(flat[flat >= 0], return_counts=True)
        bags[i] = (ids, (n / max(1, n.sum())).astype(np.float32))
    emb = rng.normal(0, 1.0 / dim, (1 << BITS, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    total, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit).tolist():
            ids, share = bags[i]
            if len(ids):
                rows = emb[ids]
                x = share @ rows
                z = x @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1.0
                lr = rate * (1.0 - done / total)
                back = w @ p
                w -= lr * np.outer(x, p)
                b -= 0.1 * lr * p
                rows -= np.outer(share, (lr * 20.0) * back)
                emb[ids] = rows
            done += 1
    seen = np.zeros(1 << BITS, bool)
    for ids, _ in bags.values():
        seen[ids] = True
    model = Model(languages, np.where(seen[:, None], emb @ w, 0).astype(np.float32), b.astype(np.float64), seen)
    if len(test):
        logits, known = model.measure(pa.array([texts[i] for i in test], pa.large_string()))
        model.temperature = temperature_for(logits, y[test])
        model.least_score = float(np.quantile(softmax(logits, model.temperature).max(1), refused))
        middle = lambda raw: raw[max(0, len(raw) - PIECE) // 2 :][:PIECE].decode(errors="ignore")
        _, short = model.measure(pa.array([middle(texts[i].encode()) for i in test], pa.large_string()))
        model.least_known = float(np.quantile(np.concatenate([known, short[short > 0]]), refused))
    return model


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", a_class: int = 800, most_bytes: int = 20_000, most_languages: int = 100) -> Model:
    """A Model from the text and non-null lang of documents whose key is not held out: at most a_class of each of the
    most_languages most frequent languages (ties: the smaller name), texts of at most most_bytes; a fifth of them calibrates.

    Held out are keys whose CRC-32 as text is a multiple of 5; a null key counts as empty text. One task holds the
    sample and fits; the driver gets the Model alone.
    """
    rows = docs.where((crc_rest(key, 5) != 0) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    sample = training_rows(rows, "__lang", a_class, most_bytes, "__id", "__text", most_languages)
    if sample is None:
        return train([], [], np.zeros(0, bool))

    def fit(held: list[tuple]) -> Model:
        return train([r[2] for r in held], [r[0] for r in held], np.arange(len(held)) % 5 == 4)

    return fitted(sample, ["by", "place", "text"], fit)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every whole text.

    Returns a row per input row: doc_id, lang_pred, score (calibrated probability, 0 to 1), known (share of the text's
    longest subwords that training texts have) and rejected. The key is a whole number (cast to long); rows with a null
    key are judged like others, repeated rows alike. Null texts and texts without a letter are `und` with score 0 and
    rejected. Other texts always get a learned language, of equally probable ones the smallest name; `rejected` tells
    that score or known is below what calibration allows. Long texts are read whole. Only key and text are read, so
    values of columns like lang can't reach a prediction and names can't clash. The model (a float32 per slot and
    language, 1 MB a language) is broadcast. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batch: pa.RecordBatch):
        model = shared.value
        names = np.array(model.languages, object)
        for part in slices(batch, "text", SLICE_BYTES):
            p, known = model.predict(part.column("text"))
            letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(1)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            pred = np.where(letters, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(known), pa.array(~letters | model.rejects(score, known))], ["doc_id", "lang_pred", "score", "known", "rejected"])

    return map_arrow(own, run, "doc_id long, lang_pred string, score double, known double, rejected boolean")
