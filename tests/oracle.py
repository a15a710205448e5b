"""An independent Lloyd, distances and silhouette on plain lists, for comparison."""

from __future__ import annotations

import math

import numpy as np

F32 = np.float32


def distance(name, a, b, p=1.5):
    diffs = [abs(int(x) - int(y)) for x, y in zip(a, b)]
    if name == "squared_euclidean":
        return F32(sum(d * d for d in diffs))
    if name == "euclidean":
        return F32(math.sqrt(sum(d * d for d in diffs)))
    if name == "manhattan":
        return F32(sum(diffs))
    if name == "chebyshev":
        return F32(max(diffs))
    if name == "minkowski":
        s = F32(0)
        for d in diffs:
            s = F32(float(s) + math.pow(d, p))
        return F32(math.pow(float(s), float(F32(1) / F32(p))))
    dot, na, nb = (sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in ((a, b), (a, a), (b, b)))
    return F32(1.0) if not na or not nb else F32(1.0 - dot / (math.sqrt(na) * math.sqrt(nb)))


def label(point, prototypes, name, p=1.5):
    best = 0
    for i in range(1, len(prototypes)):
        if distance(name, point, prototypes[i], p) < distance(name, point, prototypes[best], p):
            best = i
    return best


def lloyd(points, prototypes, name="euclidean", error=1.0, most=100, every=1):
    """(prototypes, prototypes of the last labels, iterations)"""
    for it in range(1, most + 1):
        old = [list(q) for q in prototypes]
        labels = [label(x, old, name) for x in points]
        prototypes = []
        for c, q in enumerate(old):
            own = [x for x, y in zip(points, labels) if y == c]
            prototypes.append([int(F32(sum(v)) / F32(len(own))) for v in zip(*own)] if own else q)
        if it % every == 0 and all(distance("squared_euclidean", x, y) <= error for x, y in zip(prototypes, old)):
            break
    return prototypes, old, it


def silhouette(points, labels, name="euclidean"):
    values = []
    for i, (x, own) in enumerate(zip(points, labels)):
        if labels.count(own) <= 1:
            continue
        means = {}
        for c in set(labels):
            d = [float(distance(name, x, y)) for j, (y, z) in enumerate(zip(points, labels)) if z == c and j != i]
            means[c] = sum(d) / len(d) if d else 0.0
        a, others = means.pop(own), list(means.values())
        if others and (a > 0 or min(others) > 0):
            values.append((min(others) - a) / max(a, min(others)))
    return sum(values) / len(values) if values else 0.0
