"""The six colour distances as Column expressions and, bit for bit alike, as numpy functions.

Channels are whole numbers. Results are FLOAT and are narrowed exactly where the definition narrows them: square roots,
powers and quotients run in double. Up to 258 channels of 0..255 all sums are whole numbers below 2**24, which floats
hold exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Channels = Sequence[Column] | Column
#: Up to so many channels an expression is written out channel by channel, which stays in generated code.
UNROLLED = 16
MAX_EXACT = 258
MINKOWSKI_P = 1.5


def exponent(p: float) -> float:
    """The outer exponent 1 / p in single precision."""
    if not p > 0:
        raise ValueError("the Minkowski parameter must be positive")
    return float(np.float32(1) / np.float32(p))


def _plus(terms: list[Column]) -> Column:
    return functools.reduce(lambda x, y: x + y, terms)


def _pairs(a: Channels, b: Channels, term: Callable[[Column, Column], Column], fold: str) -> Column:
    """sum or max over channels of term(a_i, b_i) in 64 bits: written out for lists of columns, higher-order for array columns."""
    wide = lambda x, y: term(x.cast("bigint"), y.cast("bigint"))
    if isinstance(a, Column):
        values = F.zip_with(a, b, wide)
        return F.array_max(values) if fold == "max" else F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v)
    terms = [wide(x, y) for x, y in zip(a, b, strict=True)]
    if fold == "max":
        return F.greatest(*terms) if len(terms) > 1 else terms[0]
    return _plus(terms)


def squared_int(a: Channels, b: Channels) -> Column:
    """The squared Euclidean distance as a whole number."""
    return _pairs(a, b, lambda x, y: (x - y) * (x - y), "sum")


def squared_euclidean(a: Channels, b: Channels, p: float = 0.0) -> Column:
    return squared_int(a, b).cast("float")


def euclidean(a: Channels, b: Channels, p: float = 0.0) -> Column:
    return F.sqrt(squared_int(a, b)).cast("float")


def manhattan(a: Channels, b: Channels, p: float = 0.0) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y), "sum").cast("float")


def chebyshev(a: Channels, b: Channels, p: float = 0.0) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y), "max").cast("float")


def minkowski(a: Channels, b: Channels, p: float = MINKOWSKI_P) -> Column:
    """Sums in single precision, channel after channel."""
    out, inner = exponent(p), float(np.float32(p))
    zero = F.lit(0.0).cast("float")
    add = lambda s, d: (s + F.pow(d.cast("double"), F.lit(inner))).cast("float")
    if isinstance(a, Column):
        total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), zero, add)
    else:
        total = functools.reduce(add, [F.abs(x - y) for x, y in zip(a, b, strict=True)], zero)
    return F.pow(total.cast("double"), F.lit(out)).cast("float")


def cosine(a: Channels, b: Channels, p: float = 0.0) -> Column:
    """1 less the cosine; 1 where a side is the zero vector, even against itself."""
    dot, na, nb = (_pairs(x, y, lambda u, v: u * v, "sum") for x, y in ((a, b), (a, a), (b, b)))
    value = (F.lit(1.0) - dot / (F.sqrt(na) * F.sqrt(nb))).cast("float")
    return F.when((na == 0) | (nb == 0), F.lit(1.0).cast("float")).otherwise(value)


METRICS: dict[str, Callable[..., Column]] = {
    "squared_euclidean": squared_euclidean,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "minkowski": minkowski,
    "cosine": cosine,
}


def register(name: str, columns: Callable[..., Column], arrays: Callable[..., np.ndarray] | None = None) -> None:
    """Add a metric: columns(a, b, p) builds its Column; arrays(a, b, p) is its numpy form, which driver-side and
    per-frame fits need. The Column form may wrap a pandas UDF."""
    METRICS[name] = columns
    if arrays is not None:
        ARRAYS[name] = arrays


def metric(name: str) -> Callable[..., Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def order_key(name: str, a: Channels, b: Channels, p: float, channels: int) -> Column:
    """Orders like the metric, with the same ties, and costs less where that can be: Euclidean distances up to 64
    channels order like their squares, whole-number metrics need no float."""
    if name in ("squared_euclidean", "euclidean") and channels <= (64 if name == "euclidean" else MAX_EXACT):
        return squared_int(a, b)
    if name == "manhattan" and channels <= MAX_EXACT:
        return _pairs(a, b, lambda x, y: F.abs(x - y), "sum")
    if name == "chebyshev":
        return _pairs(a, b, lambda x, y: F.abs(x - y), "max")
    return metric(name)(a, b, p)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b.astype(np.int64)
    return (d * d).sum(-1)


def _np_minkowski(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    d = np.abs(a.astype(np.int64) - b.astype(np.int64)).astype(np.float64)
    total = np.zeros(d.shape[:-1], np.float32)
    for i in range(d.shape[-1]):
        total = (total.astype(np.float64) + np.power(d[..., i], float(np.float32(p)))).astype(np.float32)
    return np.power(total.astype(np.float64), exponent(p)).astype(np.float32)


def _np_cosine(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    a, b = a.astype(np.int64), b.astype(np.int64)
    dot, na, nb = (a * b).sum(-1), (a * a).sum(-1), (b * b).sum(-1)
    with np.errstate(all="ignore"):
        value = 1.0 - dot / (np.sqrt(na.astype(np.float64)) * np.sqrt(nb.astype(np.float64)))
    return np.where((na == 0) | (nb == 0), 1.0, value).astype(np.float32)


#: Numpy forms: (..., channels) against (..., channels) to (...).
ARRAYS: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {
    "squared_euclidean": lambda a, b, p: _squares(a, b).astype(np.float32),
    "euclidean": lambda a, b, p: np.sqrt(_squares(a, b).astype(np.float64)).astype(np.float32),
    "manhattan": lambda a, b, p: np.abs(a.astype(np.int64) - b.astype(np.int64)).sum(-1).astype(np.float32),
    "chebyshev": lambda a, b, p: np.abs(a.astype(np.int64) - b.astype(np.int64)).max(-1).astype(np.float32),
    "minkowski": _np_minkowski,
    "cosine": _np_cosine,
}


def single_mean(total: Column, count: Column) -> Column:
    """float(total) / float(count) divided in single precision and cut towards zero, as an int.

    A plain cast chain is not enough: the optimizer merges bigint to float to double into one cast and so loses the
    rounding. greatest() with a float below all others keeps each operand a float of its own.
    """
    least = F.lit(float("-inf")).cast("float")
    quotient = F.greatest(total.cast("float"), least) / F.greatest(count.cast("float"), least)
    return quotient.cast("float").cast("int")


def single_mean_array(totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same for k x d totals and k counts above 0."""
    return np.trunc(totals.astype(np.float32) / counts.astype(np.float32)[:, None]).astype(np.int64)
