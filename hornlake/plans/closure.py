"""Closure of an ontology's facts as one DataFrame (p, s, o), o null for classes.

Rules with one body atom (taxonomies, inverses, domains, ranges) are closed on the
driver beforehand and applied by a single join, so that hierarchies need no
rounds. Rules with several atoms run semi-naively over filtered views of the
facts; each round is written to the shared folder, so plans stay small and a lost
executor repeats one round at most. Equality merges terms by their smallest representative and restarts with
everything as delta; terms that share a functional key are each made equal to the smallest of them. Bounds make the closure incomplete, never silently short.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import builtin
from ..model import EQ, NEQ, TOP, Atom, Const, Rule, Var, Witness, variables
from ..ontology.compiler import Ontology
from ..sources.rdf import XSD
from ..storage import materialize
from .evaluate import Body

ROUNDS, FACTS, DEPTH = 1000, 1_000_000, 32
CUT = 5
SCHEMA = "p string, s string, o string"
#: Single-atom rules told to all tasks; more than that go through an ordinary join.
TOLD = 200_000
SEED = "_:hornlake-domain"


@dataclass
class Closure:
    facts: DataFrame
    aliases: DataFrame  # node, rep: every merged term but representatives themselves
    violations: list[tuple[str, dict]] = field(default_factory=list)
    complete: bool = True
    rounds: int = 0
    merged: bool = False
    reason: str = ""


def facts_frame(spark: SparkSession, facts) -> DataFrame:
    return spark.createDataFrame(sorted(facts, key=str), SCHEMA)


def single_atom_closure(rules: list[Rule]) -> list[tuple[str, str, int, int | None]]:
    """(body predicate, head predicate, column for s, column for o or None) of all chains of such rules."""
    steps: dict[str, set[tuple]] = {}
    for r in rules:
        a, h = r.body[0], r.head
        place = {t: k for k, t in enumerate(a.args)}
        steps.setdefault((a.predicate, len(a.args)), set()).add((h.predicate, *(place[t] for t in h.args)))
    out: set[tuple] = set()
    for start in steps:
        seen = set()
        todo = [(start[0], *range(start[1]))]
        while todo:
            p, *columns = todo.pop()
            for q, *picked in steps.get((p, len(columns)), ()):
                new = (q, *(columns[k] for k in picked))
                if new not in seen:
                    seen.add(new)
                    todo.append(new)
        out |= {(start[0], q, c[0], c[1] if len(c) > 1 else None) for q, *c in seen}
    return sorted(out, key=str)


def is_single(r: Rule) -> bool:
    return r.head is not None and len(r.body) == 1 and r.body[0].predicate not in (EQ, NEQ, TOP) and r.head.predicate not in (EQ, NEQ) and len(set(r.body[0].args)) == len(r.body[0].args) and all(isinstance(t, Var) for t in (*r.body[0].args, *r.head.args))


def shared_key(r: Rule) -> tuple[Atom, int, list[Atom]] | None:
    """(atom, column of the key, tests of the key) if the rule says that all that share a key are equal: EQ(x, y) from p(x, k), p(y, k) and classes of k."""
    if r.head is None or r.head.predicate != EQ:
        return None
    pairs, tests = [a for a in r.body if len(a.args) == 2], [a for a in r.body if len(a.args) == 1]
    if len(pairs) != 2 or len(pairs) + len(tests) != len(r.body) or pairs[0].predicate != pairs[1].predicate or any(x.predicate in (EQ, NEQ) for x in r.body):
        return None
    a, b = (atom.args for atom in pairs)
    if not all(isinstance(t, Var) for t in (*a, *b)) or len({*a, *b}) != 3:
        return None
    return next(((pairs[0], k, tests) for k in (0, 1) if a[k] == b[k] and {*r.head.args} == {a[1 - k], b[1 - k]} and all(t.args[0] == a[k] for t in tests)), None)


class Views(dict):
    """Relations by predicate, as filters of the facts."""

    def __init__(self, facts: DataFrame, arity: dict[str, int]):
        super().__init__()
        self.facts, self.arity = facts, arity

    def __missing__(self, p: str) -> DataFrame:
        rows = self.facts.filter(F.col("p") == p)
        columns = [F.col("s").alias("c0"), F.col("o").alias("c1")][: self.arity.get(p, 1)]
        return self.setdefault(p, rows.select(*columns))

    def get(self, p, default=None):
        return self[p] if p in self.arity else default


#: Numeric datatypes whose values are compared, fixed values.
NUMBERS = ("integer", "decimal", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")


def literal_key(term: str) -> Column:
    """A key for literals in column ``term`` whose values are known: equal keys mean equal values; else null."""
    kind = F.regexp_extract(term, r'"\^\^<([^<>]*)>$', 1)
    lexical = F.regexp_extract(term, r'(?s)^"(.*)"', 1)
    number = lexical.try_cast("decimal(38,18)").cast("string")
    return (
        F.when(~F.col(term).startswith('"'), None)
        .when(kind.isin(*(f"{XSD}{t}" for t in NUMBERS)), F.concat(F.lit("n"), number))
        .when(kind == f"{XSD}boolean", F.concat(F.lit("b"), F.when(lexical.isin("true", "1"), "1").when(lexical.isin("false", "0"), "0")))
        .when(F.col(term).rlike(r'"@[A-Za-z0-9-]+$'), F.concat(F.lit("l"), lexical, F.lower(F.regexp_extract(term, r'(@[A-Za-z0-9-]+)$', 1))))
        .when(kind.isin("", f"{XSD}string"), F.concat(F.lit("s"), lexical))
    )


class Reckoner:
    """Runs one ontology's rules over its facts."""

    def __init__(self, spark: SparkSession, ontology: Ontology, rounds: int = ROUNDS, facts: int | None = FACTS, depth: int = DEPTH):
        """``facts``: None is no bound."""
        self.spark, self.limits = spark, (rounds, facts, depth)
        self.registry = builtin()
        rules = ontology.rules
        self.rules = [r for r in rules if r.head is not None and not is_single(r)]
        self.constraints = [r for r in rules if r.head is None]
        self.singles = single_atom_closure([r for r in rules if is_single(r)])
        self.uses_top = any(a.predicate == TOP for r in rules for a in r.body)
        self.arity = {EQ: 2, NEQ: 2, TOP: 1}
        for r in rules:
            for a in [*r.body, *([r.head] if r.head else [])]:
                self.arity[a.predicate] = len(a.args)
        for p, _, o in ontology.facts:
            self.arity[p] = 1 if o is None else 2
        self.equal = any(r.head and r.head.predicate == EQ for r in rules)
        self.constants = {t.value for r in rules for a in [*r.body, *([r.head] if r.head else [])] for t in a.args if isinstance(t, Const)}
        table = self.spark.createDataFrame(self.singles, "b string, h string, i int, j int") if self.singles else None
        self.table = F.broadcast(table) if table is not None and len(self.singles) <= TOLD else table

    def expand(self, delta: DataFrame) -> DataFrame:
        """The delta with all that single-atom rules and the domain make of it."""
        out = delta
        if self.table is not None:
            made = delta.join(self.table, delta["p"] == F.col("b"))
            pick = lambda k: F.when(F.col(k) == 0, F.col("s")).when(F.col(k) == 1, F.col("o"))
            out = out.union(made.select(F.col("h").alias("p"), pick("i").alias("s"), pick("j").alias("o")))
        if self.uses_top:
            terms = out.filter(F.col("p") != NEQ).select(F.explode(F.array("s", "o")).alias("s")).filter("s is not null")
            out = out.union(terms.select(F.lit(TOP), "s", F.lit(None).cast("string")))
        return out

    @staticmethod
    def _star(shared: tuple[Atom, int, list[Atom]], views) -> DataFrame:
        """Each term that shares a key with others, and the smallest of them."""
        atom, key, tests = shared
        rows = views[atom.predicate].select(F.col(f"c{key}").alias("k"), F.col(f"c{1 - key}").alias("s"))
        for t in tests:
            rows = rows.join(views[t.predicate].select(F.col("c0").alias("k")), "k", "left_semi")
        low = rows.groupBy("k").agg(F.min("s").alias("o"), F.max("s").alias("high")).filter("o <> high").select("k", "o")
        return rows.join(low, "k").filter("s <> o").select(F.lit(EQ).alias("p"), "s", "o")

    def _derived(self, rule: Rule, views) -> DataFrame:
        body = Body(self.spark, views, self.registry)
        for a in self._ordered(rule):
            body.atom(a)
        rows = body.head(rule.head)
        second = F.col("c1") if len(rule.head.args) > 1 else F.lit(None).cast("string")
        return rows.select(F.lit(rule.head.predicate).alias("p"), F.col("c0").alias("s"), second.alias("o"))

    @staticmethod
    def _ordered(rule: Rule) -> list[Atom]:
        """EQ, NEQ and atoms over witnesses after what binds them; others so that each joins what came before, if it can."""
        todo, done, bound = list(rule.body), [], set()
        names = lambda a: variables(*a.args)
        late = lambda a: a.predicate in (EQ, NEQ) or any(isinstance(t, Witness) for t in a.args)
        while todo:
            pick = next((a for a in todo if late(a) and names(a) <= bound), None) or next((a for a in todo if not late(a) and (not bound or names(a) & bound or not names(a))), None) or next((a for a in todo if not late(a)), todo[0])
            todo.remove(pick)
            done.append(pick)
            bound |= names(pick)
        return done

    def round(self, total: DataFrame, delta: DataFrame, live: set[str], rules: list[Rule] | None = None, full: bool = False) -> DataFrame | None:
        """What several-atom rules derive with at least one body atom in the delta (all of it, if ``full``)."""
        views, news = Views(total, self.arity), Views(delta, self.arity)
        frames = []
        for r in self.rules if rules is None else rules:
            if (shared := shared_key(r)) is not None:
                if full or any(a.predicate in live for a in r.body):
                    frames.append(self._star(shared, views))
                continue
            if full or not r.body:
                frames.append(self._derived(r, views))
                continue
            for k, a in enumerate(r.body):
                if a.predicate in live and a.predicate != EQ:
                    marked = replace(a, predicate="__delta")
                    mixed = Views(total, self.arity)
                    mixed["__delta"] = news[a.predicate]
                    mixed.arity = self.arity
                    frames.append(self._derived(replace(r, body=(*r.body[:k], marked, *r.body[k + 1 :])), mixed))
        if not frames:
            return None
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def heads(self) -> list[str]:
        """Predicates of all that rules can derive."""
        found = {r.head.predicate for r in self.rules} | {EQ, NEQ, TOP}
        return sorted(found | {h for b, h, *_ in self.singles if b in found})

    def _depth(self, delta: DataFrame) -> int:
        deep = lambda c: F.coalesce(F.size(F.split(F.col(c), r"sk:")) - 1, F.lit(0))
        return delta.agg(F.max(F.greatest(deep("s"), deep("o")))).first()[0] or 0

    def closure(self, facts: DataFrame) -> Closure:
        """The least model over asserted facts (p, s, o)."""
        from ..plans.equality import literal_edges, merge, rewrite

        rounds, most, depth = self.limits
        out = Closure(facts, self.spark.createDataFrame([], "node string, rep string"))
        base = facts
        if self.uses_top:
            extra = [(TOP, t, None) for t in sorted({SEED, *self.constants})]
            base = base.union(self.spark.createDataFrame(extra, SCHEMA))
        flip = base.filter(F.col("p") == NEQ).select("p", F.col("o").alias("s"), F.col("s").alias("o"))
        total = delta = materialize(self.expand(base.union(flip)).distinct(), "facts")
        whole = True  # all is delta: a rule is run once, not once for each of its atoms
        known: set[str] = set()
        heads = self.heads()
        eq_edges = literal_edges(delta)
        while True:
            live = {r["p"] for r in delta.select("p").distinct().collect()}
            if EQ in live or (out.rounds == 0 and not eq_edges.isEmpty()):
                edges = total.filter(F.col("p") == EQ).select(F.col("s").alias("u"), F.col("o").alias("v")).union(eq_edges)
                old = out.aliases.select(F.col("node").alias("u"), F.col("rep").alias("v"))
                out.aliases, clash = merge(edges.union(old), total)
                out.merged = out.merged or not out.aliases.isEmpty()
                if clash:
                    out.violations.append(("distinct literals are equal", {"terms": clash}))
                total = delta = materialize(self.expand(rewrite(total.filter(F.col("p") != EQ), out.aliases)).distinct(), "merged")
                whole = True
                live = {r["p"] for r in delta.select("p").distinct().collect()}
            if not live:
                break
            out.rounds += 1
            if out.rounds > rounds:
                out.complete, out.reason = False, f"more than {rounds} rounds"
                break
            known |= live
            able = [r for r in self.rules if all(a.predicate in known or a.predicate in (EQ, NEQ) for a in r.body)]
            made = self.round(total, delta, live, able, full=whole)
            whole = False
            if made is None:
                break
            turned = made.filter(F.col("p") == NEQ).select("p", F.col("o").alias("s"), F.col("s").alias("o")) if any(r.head.predicate == NEQ for r in self.rules) else None
            made = rewrite(made.union(turned) if turned is not None else made, out.aliases) if out.merged else (made.union(turned) if turned is not None else made)
            made = made.filter(~((F.col("p") == EQ) & F.col("s").eqNullSafe(F.col("o"))))
            same = [F.col("n.p") == F.col("t.p"), F.col("n.s") == F.col("t.s"), F.col("n.o").eqNullSafe(F.col("t.o"))]
            fresh = self.expand(made).distinct().alias("n").join(total.filter(F.col("p").isin(*heads)).alias("t"), same, "left_anti")
            delta = materialize(fresh, "round")
            if delta.isEmpty():
                break
            if any(isinstance(t, Witness) for r in self.rules for t in r.head.args) and self._depth(delta) > depth:
                out.complete, out.reason = False, f"witnesses deeper than {depth}"
                break
            total = total.union(delta)
            if out.rounds % CUT == 0:
                total = materialize(total, "closure")
            if most is not None and total.count() > most:
                out.complete, out.reason = False, f"more than {most} facts"
                break
        out.facts = total.filter(F.col("p") != EQ)  # written already
        out.violations += self.violated(out.facts)
        return out

    def violation_rows(self, facts: DataFrame) -> DataFrame:
        """(label, bindings) of every instance of every constraint, and of terms both equal and different."""
        views = Views(facts, self.arity)
        clash = facts.filter((F.col("p") == NEQ) & (F.col("s") == F.col("o")))
        out = clash.select(F.lit("equal and different").alias("label"), F.create_map(F.lit("term"), "s").alias("bindings"))
        for r in self.constraints:
            body = Body(self.spark, views, self.registry)
            for a in self._ordered(r):
                body.atom(a)
            found = body.guarded()
            pairs = [x for c in found.columns if not c.startswith("__") for x in (F.lit(c), F.col(c))]
            out = out.union(found.select(F.lit(r.label), F.create_map(*pairs)))
        return out

    def violated(self, facts: DataFrame) -> list[tuple[str, dict]]:
        """Labels of constraints with an instance, one binding each, and clashes of difference."""
        low = self.violation_rows(facts).groupBy("label").agg(F.any_value("bindings").alias("bindings"))
        return sorted(((r["label"], r["bindings"]) for r in low.collect()), key=str) if self.constraints or self._different(facts) else []

    @staticmethod
    def _different(facts: DataFrame) -> bool:
        return not facts.filter(F.col("p") == NEQ).isEmpty()


__all__ = ["Closure", "Reckoner", "facts_frame"]
