"""Pieces of DuckDB SQL that replay the operators independently: distances, assignment, the Lloyd loop as a recursive query."""

from __future__ import annotations

from collections.abc import Sequence

C = ("c0", "c1", "c2")


def total(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def distance(metric: str, a: Sequence[str], b: Sequence[str]) -> str:
    """FLOAT (whole numbers for whole-number metrics, cast) of two lists of integer expressions; narrows where the operator does."""
    diff = [f"abs({x} - {y})" for x, y in zip(a, b)]
    square = total([f"({x} - {y})*({x} - {y})" for x, y in zip(a, b)])
    if metric == "squared_euclidean":
        return f"({square})::float"
    if metric == "euclidean":
        return f"sqrt({square}::double)::float"
    if metric == "manhattan":
        return f"{total(diff)}::float"
    if metric == "chebyshev":
        return f"greatest({', '.join(diff)})::float"
    if metric == "minkowski":
        s = "0::float"
        for d in diff:
            s = f"({s}::double + pow(({d})::double, 1.5))::float"
        return f"pow({s}::double, 0.6666666865348816)::float"
    if metric == "cosine":
        dot, na, nb = (total([f"{x}*{y}" for x, y in zip(p, q)]) for p, q in ((a, b), (a, a), (b, b)))
        return f"(case when {na} = 0 or {nb} = 0 then 1::float else (1 - {dot}/(sqrt({na}::double)*sqrt({nb}::double)))::float end)"
    raise ValueError(metric)


def nearest(metric: str, cells: Sequence[Sequence[str]], own: Sequence[str] = C) -> str:
    """The first of the nearest prototypes, given as expressions per prototype and channel."""
    d = [distance(metric, own, q) for q in cells]
    if len(d) == 1:
        return "0"
    return f"(list_position([{', '.join(d)}], least({', '.join(d)})) - 1)::int"


def literal_cells(prototypes: Sequence[Sequence[int]]) -> list[list[str]]:
    return [[str(x) for x in q] for q in prototypes]


def state_cells(k: int, name: str = "p", d: int = 3) -> list[list[str]]:
    return [[f"{name}[{j + 1}][{i + 1}]" for i in range(d)] for j in range(k)]


def mean(s: str, n: str) -> str:
    return f"floor(({s})::bigint::float / ({n})::bigint::float)::int"


def prototypes_literal(prototypes: Sequence[Sequence[int]]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x}::int" for x in q) + "]" for q in prototypes) + "]"


def lloyd(name: str, k: int, init: str, metric: str = "euclidean", check_every: int = 1, hist: str = "h", limit: int = 100, keys: Sequence[str] = ()) -> str:
    """Recursive CTEs <name>_all (keys..., it, p, old, done) and <name>, its last rows. init: SQL for rows (keys..., p)."""
    ks = "".join(f"{x}, " for x in keys)
    on = " and ".join(f"s.{x} = {hist}.{x}" for x in keys) or "true"
    cells = state_cells(k)
    new = []
    for j in range(k):
        values = [f"case when coalesce(sum(n) filter (cid = {j}), 0) = 0 then any_value({cells[j][i]}) else {mean(f'sum({c}*n) filter (cid = {j})', f'sum(n) filter (cid = {j})')} end" for i, c in enumerate(C)]
        new.append("[" + ", ".join(values) + "]")
    shift = "greatest(" + ", ".join([total([f"(q[{j + 1}][{i + 1}] - p[{j + 1}][{i + 1}])*(q[{j + 1}][{i + 1}] - p[{j + 1}][{i + 1}])" for i in range(3)]) for j in range(k)] + ["0"]) + ")"
    sk = "".join(f"s.{x}, " for x in keys)
    gk = "".join(f"{x}, " for x in keys)
    return f"""{name}_all as (
  select {ks}0 it, p, p old, false done from ({init}) i
  union all
  select {ks}it + 1, q, p, ((it + 1) % {check_every} = 0 and {shift} <= 1) or it + 1 >= {limit} from (
    select {gk}it, p, [{', '.join(new)}] q from (
      select {sk}s.it, s.p, c0, c1, c2, n, {nearest(metric, cells)} cid from {name}_all s join {hist} on {on} where not s.done) x
    group by {gk}it, p) y),
{name} as (select * from {name}_all where done)"""


def spread(name: str, k: int, keys: Sequence[str] = (), column: str = "p") -> str:
    """Rows (keys..., cid, c0, c1, c2) of a lloyd CTE."""
    ks = "".join(f"{x}, " for x in keys)
    return " union all ".join(f"select {ks}it, {j} cid, {column}[{j + 1}][1] c0, {column}[{j + 1}][2] c1, {column}[{j + 1}][3] c2 from {name}" for j in range(k))


def elbow(metric: str, cells: Sequence[Sequence[str]], colours: Sequence[Sequence[str]], weight: str = "n") -> str:
    """The elbow error of rows of channels: labels by `cells`, colours by `colours`."""
    pick = [f"list_value({', '.join(q[i] for q in colours)})[{nearest(metric, cells)} + 1]" for i in range(3)]
    return f"sum(pow(trunc({distance('euclidean', C, pick)}), 2)*{weight})"
