"""Evaluates rule programs and publishes complete answers with their changes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import DomainError, EngineError, RetryError, ValidationError, raised_by
from ..functions import builtin
from ..functions.registry import Registry
from ..model import EQ, NEQ, TOP, Atom, Minimum, Program, Var
from ..storage import materialize
from .evaluate import compared, derive, reject_nulls, relation
from .fixpoint import fixpoint
from .parser import parse
from .planner import Plan, plan


TYPE_IRI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass
class Result:
    """Full relations, and what came and went since the last complete answer."""

    relations: dict[str, DataFrame]
    additions: dict[str, DataFrame] = field(default_factory=dict)
    retractions: dict[str, DataFrame] = field(default_factory=dict)
    revision: int = 0

    def rows(self, predicate: str) -> set[tuple]:
        return {tuple(r) for r in self.relations[predicate].collect()}


def solve(spark: SparkSession, prepared: Plan, inputs: Mapping[str, DataFrame], registry: Registry, params: Mapping[str, object] | None = None, rows: int | None = None) -> dict[str, DataFrame]:
    """All derived relations: a lazy plan per predicate, a fixpoint loop where it is recursive.

    ``rows`` bounds each recursive relation; without it only rounds are bounded.
    """
    found: dict[str, DataFrame] = dict(inputs)
    derived: dict[str, DataFrame] = {}
    for rules in prepared.strata:
        todo = list(rules)
        while todo:
            heads = {r.head.predicate for r in todo}
            waits = lambda p: {q for r in todo if r.head.predicate == p for n in r.body for q in _reads(n)} & heads  # noqa: B023,E731
            ready = sorted(p for p in heads if p not in prepared.recursive and not waits(p))
            if ready:
                for p in ready:
                    own = [r for r in todo if r.head.predicate == p]
                    pairs = compared(spark, own[0], found, registry) if len(own) == 1 else None
                    if pairs is not None:
                        derived[p] = found[p] = pairs
                        continue
                    frames = [derive(spark, r, found, registry, params) for r in own]
                    out = frames[0]
                    for f in frames[1:]:
                        out = out.union(f)
                    derived[p] = found[p] = out.distinct()
                todo = [r for r in todo if r.head.predicate not in ready]
                continue
            loop = _component(todo, prepared.recursive)
            total, status = fixpoint(spark, [r for r in todo if r.head.predicate in loop], found, registry, params, rows=rows)
            if not status.complete:
                raise DomainError("RESOURCE_LIMIT", status.reason)
            for p, df in total.items():
                derived[p] = found[p] = df
            todo = [r for r in todo if r.head.predicate not in loop]
    return derived


def _reads(node) -> list[str]:
    from ..model import predicates

    return predicates(node)


def _component(rules, recursive: frozenset[str]) -> set[str]:
    """A recursive component that waits for no other predicate of ``rules``."""
    heads = {r.head.predicate for r in rules}
    edges = {p: {q for r in rules if r.head.predicate == p for n in r.body for q in _reads(n)} & heads for p in heads}

    def reach(p: str) -> set[str]:
        seen, todo = set(), [p]
        while todo:
            for q in edges[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return seen

    closed = {p: reach(p) for p in heads}
    return min(({p} | closed[p] for p in heads if p in recursive and all(p in closed[q] for q in closed[p])), key=len)


class QueryRuntime:
    """A program with inputs; ``evaluate`` publishes all or nothing."""

    def __init__(self, spark: SparkSession, program: str | Program, registry: Registry | None = None, source: str = "<rules>", rows: int | None = None):
        self.spark, self.registry, self.rows = spark, registry or builtin(), rows
        self.program = parse(program, source) if isinstance(program, str) else program
        self.last: Result | None = None
        self.revision = 0
        self._running = False

    def plan(self, inputs: Mapping[str, DataFrame]) -> Plan:
        return plan(self.program, self.registry, {p: len(df.columns) for p, df in inputs.items()})

    def _closure(self, reasoner, relations: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Relations of the ontology that the program reads and nothing else gives."""
        if reasoner is None:
            return {}
        reasoner._guard()
        heads = {r.head.predicate for r in self.program.rules}
        found: dict[str, DataFrame] = {}
        for r in self.program.rules:
            for n in r.body:
                atom = n if isinstance(n, Atom) else n.source if isinstance(n, Minimum) else None
                if atom is None or atom.predicate in (EQ, NEQ, TOP) or atom.predicate in heads or atom.predicate in relations:
                    continue
                if atom.predicate == TYPE_IRI:
                    found[TYPE_IRI] = reasoner.type_view()
                elif len(atom.args) == 1:
                    found[atom.predicate] = reasoner.class_relation(atom.predicate)
                elif len(atom.args) == 2:
                    found[atom.predicate] = reasoner.property_relation(atom.predicate)
        return found

    def evaluate(self, relations: Mapping[str, DataFrame], params: Mapping[str, object] | None = None, revisions=None, publish: bool = True, reasoner=None, scope: tuple[str, str] | None = None) -> Result:
        """``revisions``: a callable naming the sources' state, compared before and after.

        Without ``publish`` the relations stay lazy and no change is told. A
        ``reasoner`` gives the classes and properties that the program names, and
        rdf:type over all classes. ``scope`` (name, revision) sets ?scope and ?revision.
        """
        params = dict(params or {})
        if scope:
            params |= {"scope": f"<{scope[0]}>", "revision": scope[1]}
        if self._running:
            raise EngineError("evaluation is already under way")
        self._running = True
        try:
            inputs = {p: reject_nulls(relation(df)) for p, df in {**self._closure(reasoner, relations), **relations}.items()}
            prepared = self.plan(inputs)
            missing = {g for r in self.program.rules for g in r.given} - set(params)
            if missing:
                raise ValidationError(f"missing parameters: {', '.join(sorted(missing))}")
            for r in self.program.rules:
                for n in r.body:
                    for p in _reads(n):
                        if p not in (EQ, NEQ, TOP) and p not in inputs and not any(x.head.predicate == p for x in self.program.rules):
                            raise ValidationError(f"unknown relation {p}", n.at)
            before = revisions() if revisions else None
            found = solve(self.spark, prepared, inputs, self.registry, params, self.rows)
            if not publish:
                return Result(found)
            found = {p: materialize(df, "answer") for p, df in found.items()}
            if revisions and revisions() != before:
                raise RetryError("a source moved while the query ran")
            old = self.last.relations if self.last else {}
            empty = lambda df: df.limit(0)
            both = set(found) | set(old)
            minus = lambda a, b: a if b is None else a.join(b, a.columns, "left_anti") if a.columns else a
            added = {p: minus(found[p], old.get(p)) if p in found else empty(old[p]) for p in both}
            gone = {p: minus(old[p], found.get(p)) if p in old else empty(found[p]) for p in both}
            self.revision += 1
            self.last = Result(found, added, gone, self.revision)
            return self.last
        except EngineError:
            raise
        except Exception as e:
            known = raised_by(e)
            if known:
                raise known from e
            raise
        finally:
            self._running = False


def run(spark: SparkSession, text: str, relations: Mapping[str, DataFrame], answer: str, params: Mapping[str, object] | None = None, registry: Registry | None = None) -> DataFrame:
    """The lazy relation ``answer`` of a program, with columns named as in its first rule's head."""
    runtime = QueryRuntime(spark, text, registry)
    found = runtime.evaluate(relations, params, publish=False).relations
    name = answer if answer in found else f"urn:dlp:query:{answer}"
    head = next(r.head for r in runtime.program.rules if r.head.predicate == name)
    names = [t.name if isinstance(t, Var) else f"c{k}" for k, t in enumerate(head.args)]
    if not names:
        return found[name]
    return found[name].toDF(*(n if names.index(n) == k else f"{n}_{k}" for k, n in enumerate(names)))
