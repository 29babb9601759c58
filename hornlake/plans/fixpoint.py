"""Semi-naive least fixpoints for the recursive rules.

Each round joins, per rule and recursive body position, the last delta with the
full relations, and keeps what is new by an anti join. A round's delta is written
to the shared folder: plans stay small, and a lost executor repeats one round at
most. Every ``CUT`` rounds the parts of a relation become one table. A plain
transitive rule doubles path lengths instead of adding one edge a round.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.registry import Registry
from ..model import Atom, Rule, Var
from ..storage import materialize
from .evaluate import derive

ROUNDS, ROWS = 1000, 1_000_000
CUT = 6


@dataclass
class Status:
    """``complete`` is False if a bound stopped the loop; what was found still holds."""

    complete: bool = True
    rounds: int = 0
    rows: dict[str, int] = field(default_factory=dict)
    reason: str = ""


def is_transitive(rules: list[Rule], predicate: str) -> bool:
    """Whether all recursion through ``predicate`` is p(x,z) :- p(x,y), p(y,z)."""
    found = False
    for r in rules:
        own = [n for n in r.body if isinstance(n, Atom) and n.predicate == predicate]
        if not own:
            continue
        if len(r.body) != 2 or len(own) != 2 or r.head.predicate != predicate or len(r.head.args) != 2:
            return False
        (a, b), (c, d), (x, z) = own[0].args, own[1].args, r.head.args
        if not (all(isinstance(t, Var) for t in (a, b, c, d)) and b == c and (x, z) == (a, d) and len({a, b, d}) == 3):
            return False
        found = True
    return found


def fixpoint(
    spark: SparkSession,
    rules: list[Rule],
    relations: Mapping[str, DataFrame],
    registry: Registry,
    params: Mapping[str, object] | None = None,
    seeds: Mapping[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    rows: int | None = ROWS,
    naive: bool = False,
) -> tuple[dict[str, DataFrame], Status]:
    """The least model of ``rules`` over ``relations``; ``rows`` bounds each derived relation.

    ``seeds``: rows to start from, for relations that are complete but for what follows from these.
    """
    heads = sorted({r.head.predicate for r in rules})
    status = Status()
    total: dict[str, DataFrame] = {}
    delta: dict[str, DataFrame] = {}

    def united(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out.distinct()

    def recursive(r: Rule) -> bool:
        return any(isinstance(n, Atom) and n.predicate in heads for n in r.body)

    for p in heads:
        start = [derive(spark, r, relations, registry, params) for r in rules if r.head.predicate == p and not recursive(r)] if seeds is None else []
        own = relations.get(p)
        given = [seeds[p]] if seeds and p in seeds else []
        if not start and own is None and not given:
            continue
        new = united([*start, *given, *([own] if own is not None and seeds is None else [])])
        if seeds is not None and own is not None:
            new = new.join(own, new.columns, "left_anti") if given else own.limit(0)
        delta[p] = materialize(new, "delta")
        total[p] = united([own, delta[p]]) if seeds is not None and own is not None else delta[p]
    live = {p: d for p, d in delta.items() if not d.isEmpty()}
    while live:
        status.rounds += 1
        if status.rounds > rounds:
            status.complete, status.reason = False, f"more than {rounds} rounds"
            break
        found: dict[str, list[DataFrame]] = {}
        for r in filter(recursive, rules):
            at = [k for k, n in enumerate(r.body) if isinstance(n, Atom) and n.predicate in heads]
            if any(r.body[k].predicate not in total for k in at):
                continue
            p = r.head.predicate
            if naive:
                found.setdefault(p, []).append(derive(spark, r, {**relations, **total}, registry, params))
                continue
            if is_transitive(rules, p) and p in live:  # delta with delta covers old with old: lengths double
                at = at[:1]
            for k in at:
                if r.body[k].predicate not in live:
                    continue
                marked = replace(r.body[k], predicate="__delta")
                body = (*r.body[:k], marked, *r.body[k + 1 :])
                found.setdefault(p, []).append(derive(spark, replace(r, body=body), {**relations, **total, "__delta": live[r.body[k].predicate]}, registry, params))
        live = {}
        for p, frames in found.items():
            new = united(frames)
            if p in total:
                new = new.join(total[p], new.columns, "left_anti")
            new = materialize(new, "delta")
            if not new.isEmpty():
                live[p] = new
        for p, new in live.items():
            total[p] = total[p].union(new) if p in total else new
            if status.rounds % CUT == 0:
                total[p] = materialize(total[p], "total")
            if rows is not None and total[p].count() > rows:
                status.complete, status.reason = False, f"more than {rows} rows"
        if not status.complete:
            break
    return total, status
