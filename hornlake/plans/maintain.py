"""Maintenance of a closure: incremental insertion, delete and rederive, or afresh.

Deletion overestimates with the old rules what may lose its support, takes it
out, then rederives with the new rules what still holds. It is used where no
terms were merged or could be, and no witnesses exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EQ, NEQ, TOP, Rule, Witness
from ..ontology.compiler import Ontology
from ..storage import materialize
from .closure import SCHEMA, SEED, Closure, Reckoner, facts_frame
from .equality import literal_edges


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, [F.col("x.p") == F.col("y.p"), F.col("x.s") == F.col("y.s"), F.col("x.o").eqNullSafe(F.col("y.o"))], "left_anti")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, [F.col("x.p") == F.col("y.p"), F.col("x.s") == F.col("y.s"), F.col("x.o").eqNullSafe(F.col("y.o"))], "left_semi")


def can_rederive(rules: list[Rule], closure: Closure, facts: DataFrame) -> bool:
    plain = all(r.head is None or (r.head.predicate != EQ and not any(isinstance(t, Witness) for t in r.head.args)) for r in rules)
    return closure.complete and not closure.merged and plain and facts.filter(F.col("p") == EQ).isEmpty() and literal_edges(facts).isEmpty()


def _grow(engine: Reckoner, total: DataFrame, delta: DataFrame) -> tuple[DataFrame, int]:
    """Semi-naive rounds from ``delta``, which is in ``total`` already."""
    rounds = 0
    while True:
        live = {r["p"] for r in delta.select("p").distinct().collect()}
        made = engine.round(total, delta, live) if live else None
        if made is None:
            return total, rounds
        delta = materialize(_minus(engine.expand(made).distinct(), total), "grown")
        if delta.isEmpty():
            return total, rounds
        rounds += 1
        total = materialize(total.union(delta), "closure")


def maintain(spark: SparkSession, old: Ontology, new: Ontology, closure: Closure, **limits) -> tuple[Closure, str]:
    """The closure of ``new`` from that of ``old``, and how it was reached."""
    engine = Reckoner(spark, new, **limits)
    gone, came = old.facts - new.facts, new.facts - old.facts
    lost = [r for r in old.rules if r not in set(new.rules)]
    found = [r for r in new.rules if r not in set(old.rules)]
    if not (gone or came or lost or found):
        return closure, "unchanged"
    asserted = facts_frame(spark, new.facts)
    if not can_rederive([*old.rules, *new.rules], closure, asserted.union(closure.facts)):
        return engine.closure(asserted), "rematerialize"

    def based(e: Reckoner, facts: DataFrame) -> DataFrame:
        extra = facts_frame(spark, {(TOP, t, None) for t in {SEED, *e.constants}}) if e.uses_top else spark.createDataFrame([], SCHEMA)
        flip = facts.filter(F.col("p") == NEQ).select("p", F.col("o").alias("s"), F.col("s").alias("o"))
        return facts.union(flip).union(extra)

    base = materialize(based(engine, asserted).distinct(), "base")
    total = closure.facts
    if not gone and not lost:
        method = "incremental-rules" if found else "incremental-insert"
        if found:  # new rules see everything once
            made = engine.round(total.union(base), base, set(), rules=[r for r in engine.rules if r in set(found)], full=True)
            start = engine.expand(total.union(base) if made is None else total.union(base).union(made))
        else:
            start = engine.expand(base)
        delta = materialize(_minus(start.distinct(), total), "inserted")
        total = materialize(total.union(delta), "closure")
    else:
        method = "dred-rules" if lost or found else "dred"
        before = Reckoner(spark, old, **limits)
        seeds = [based(before, facts_frame(spark, gone))] if gone else []
        heads = [r for r in before.rules if r in set(lost)]
        if heads:
            seeds.append(before.round(total, total, set(), rules=heads, full=True))
        if lost:  # single-atom chains and the domain: whatever no rule gives any more
            seeds.append(_minus(before.expand(total).distinct(), engine.expand(total).distinct()))
            seeds.append(before.expand(total.limit(0)))
            chains = set(before.singles) - set(engine.singles)
            for b, h, i, j in sorted(chains, key=str):
                rows = total.filter(F.col("p") == b)
                column = lambda k: F.lit(None).cast("string") if k is None else F.col("so"[k])
                seeds.append(rows.select(F.lit(h).alias("p"), column(i).alias("s"), column(j).alias("o")))
        if before.uses_top:
            now = base.select(F.explode(F.array("s", "o")).alias("s")).filter("s is not null")
            seeds.append(total.filter(F.col("p") == TOP).join(now, "s", "left_anti").select("p", "s", "o"))
        suspects = seeds[0]
        for s in seeds[1:]:
            suspects = suspects.union(s)
        over = delta = materialize(_both(_minus(before.expand(suspects).distinct(), base), total), "suspects")
        while not delta.isEmpty():
            live = {r["p"] for r in delta.select("p").distinct().collect()}
            made = before.round(total, delta, live)
            if made is None:
                break
            delta = materialize(_minus(_both(_minus(before.expand(made).distinct(), base), total), over), "suspects")
            over = materialize(over.union(delta), "suspects")
        rest = materialize(_minus(total, over), "rest")
        # what the rest and the facts still give, at once and in rounds
        made = engine.round(rest.union(base), rest, set(), full=True)
        start = rest.union(base) if made is None else rest.union(base).union(made)
        delta = materialize(_minus(engine.expand(start).distinct(), rest), "rederived")
        total = materialize(rest.union(delta), "closure")
    total, rounds = _grow(engine, total, delta)
    out = Closure(total, closure.aliases, [], True, rounds)
    out.violations = engine.violated(total)
    return out, method
