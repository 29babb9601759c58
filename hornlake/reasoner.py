"""Questions about an ontology's closure: instances, values, entailment, subsumption, updates.

Negative answers need a complete closure; an inconsistent one answers nothing
but its consistency. Names are IRIs (with or without angle brackets) or terms in
N-Triples form; class arguments may be blank nodes described by extra triples.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import IncompleteError, InconsistentError
from .model import EQ, NEQ, TOP
from .ontology.compiler import Ontology, compile_graph, iri
from .ontology.syntax import parse_ontology
from .plans.closure import Closure, Reckoner, facts_frame, is_single, single_atom_closure
from .plans.maintain import maintain
from .sources.rdf import OWL, RDFS, TYPE, Triple, read_graph

THING = f"<{OWL}Thing>"


def term(x: str) -> str:
    """A bare IRI in angle brackets; terms as they are."""
    return x if x[:1] in '<"_' or x.startswith("sk:") else f"<{x}>"


class Reasoner:
    def __init__(self, spark: SparkSession, triples: Iterable[Triple], profile: str = "L3", base: DataFrame | None = None, **limits):
        """``triples``: the ontology, with facts if they are few; ``base``: a table of facts (p, s, o) of any size, o null for class membership."""
        self.spark, self.profile, self.base, self.limits = spark, profile, base, limits
        self.triples = list(dict.fromkeys(triples))
        self.ontology: Ontology = compile_graph(self.triples, profile)
        self.closure: Closure = self._close(self.ontology)
        self.method = "materialize"
        self._probes: dict = {}

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, format: str | None = None, **options) -> "Reasoner":
        return cls(spark, read_graph(path, format), **options)

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, **options) -> "Reasoner":
        return cls(spark, parse_ontology(text), **options)

    def _close(self, ontology: Ontology) -> Closure:
        facts = facts_frame(self.spark, ontology.facts)
        if self.base is not None:
            facts = facts.unionByName(self.base)  # the closure makes them distinct
        return Reckoner(self.spark, ontology, **self.limits).closure(facts)

    # status

    @property
    def complete(self) -> bool:
        return self.closure.complete

    @property
    def consistency(self) -> str:
        return "inconsistent" if self.closure.violations else "consistent" if self.complete else "unknown"

    @property
    def stats(self) -> dict:
        return {"profile": self.profile, "consistency": self.consistency, "complete": self.complete, "triples": len(self.triples), "rules": len(self.ontology.rules), "asserted_facts": len(self.ontology.facts), "materialized_facts": self.closure.facts.count(), "rounds": self.closure.rounds, "violations": self.closure.violations, "method": self.method}

    def _guard(self, exhaustive: bool = True) -> None:
        if self.closure.violations:
            raise InconsistentError("the ontology is inconsistent; its answers mean nothing")
        if exhaustive and not self.complete:
            raise IncompleteError(self.closure.reason)

    # relations

    def _rep(self, x: str) -> str:
        row = self.closure.aliases.filter(F.col("node") == x).first()
        return row["rep"] if row else x

    def _shown(self, df: DataFrame, columns: list[str], witnesses: bool = False) -> DataFrame:
        """All names of merged terms, of distinct rows; witnesses and hidden terms only on demand."""
        for c in columns:
            if self.closure.merged:
                others = self.closure.aliases.select(F.col("rep").alias(c), F.col("node").alias("__alias"))
                df = df.unionByName(df.join(others, c).drop(c).withColumnRenamed("__alias", c))
            hidden = F.col(c).startswith("sk:") | F.col(c).startswith("_:hornlake")
            df = df if witnesses else df.filter(~hidden)
        return df.distinct() if self.closure.merged else df  # facts are distinct

    def class_relation(self, concept: str, witnesses: bool = False) -> DataFrame:
        """(x): members of a named class."""
        name = TOP if term(concept) == THING else iri(term(concept))
        found = self._shown(self.closure.facts.filter((F.col("p") == name) & F.col("o").isNull()).select(F.col("s").alias("x")), ["x"], witnesses)
        return found.filter(~F.col("x").startswith('"'))

    def property_relation(self, prop: str, witnesses: bool = False) -> DataFrame:
        """(x, y): pairs of a property."""
        rows = self.closure.facts.filter((F.col("p") == iri(term(prop))) & F.col("o").isNotNull())
        return self._shown(rows.select(F.col("s").alias("x"), F.col("o").alias("y")), ["x", "y"], witnesses).select("x", "y")

    def type_view(self) -> DataFrame:
        """(x, c) for every class that is no helper."""
        rows = self.closure.facts.filter("o is null and p not like 'urn:hornlake:%' and p not like 'urn:dlp:internal:%'")
        return self._shown(rows.select(F.col("s").alias("x"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("c")), ["x"]).select("x", "c")

    # questions

    def _probe(self, extra: Iterable[Triple], named: Iterable[str] = ()) -> "Reasoner":
        """The same ontology with more triples, kept apart."""
        extra = [*extra, *((n, TYPE, f"<{OWL}NamedIndividual>") for n in named)]
        key = tuple(extra)
        if key not in self._probes:
            self._probes[key] = Reasoner(self.spark, [*self.triples, *extra], self.profile, self.base, **self.limits)
        return self._probes[key]

    def _known(self, *xs: str) -> "Reasoner":
        """Fresh names extend the domain, in a reasoner of their own."""
        if not Reckoner(self.spark, self.ontology).uses_top:
            return self
        facts = self.closure.facts
        missing = [x for x in xs if x[:1] in "<_" and facts.filter((F.col("s") == self._rep(x)) | (F.col("o") == self._rep(x))).isEmpty()]
        return self._probe((), missing) if missing else self

    def instances(self, concept: str, described: Iterable[Triple] = (), witnesses: bool = False) -> set[str]:
        """Members of a class, or of the expression ``described`` at the blank node ``concept``."""
        self._guard()
        if concept.startswith("_:"):
            marker = "<urn:hornlake:query:marker>"
            probe = self._probe([*described, (concept, f"<{RDFS}subClassOf>", marker)])
            return probe.instances(marker, witnesses=witnesses)
        return {r["x"] for r in self.class_relation(concept, witnesses).collect()}

    def types(self, individual: str) -> set[str]:
        self._guard()
        x = term(individual)
        at = self._known(x)
        rows = at.closure.facts.filter((F.col("s") == at._rep(x)) & F.col("o").isNull() & ((F.col("p") == TOP) | ~(F.col("p").startswith("urn:hornlake:") | F.col("p").startswith("urn:dlp:internal:")))).select("p").collect()
        return {THING if r["p"] == TOP else f"<{r['p']}>" for r in rows}

    def property_values(self, subject: str, prop: str, witnesses: bool = False) -> set[str]:
        self._guard()
        x = term(subject)
        at = self._known(x)
        rows = at.closure.facts.filter((F.col("p") == iri(term(prop))) & (F.col("s") == at._rep(x)) & F.col("o").isNotNull())
        return {r["y"] for r in at._shown(rows.select(F.col("o").alias("y")), ["y"], witnesses).collect()}

    def property_pairs(self, prop: str, witnesses: bool = False) -> set[tuple[str, str]]:
        self._guard()
        return {(r["x"], r["y"]) for r in self.property_relation(prop, witnesses).collect()}

    def entails(self, s: str, p: str, o: str) -> bool:
        self._guard(exhaustive=False)
        s, p, o = term(s), term(p), term(o)
        if p == TYPE and o == THING:
            return True
        at = self._known(s, *(() if p == TYPE else (o,)))
        a, b = at._rep(s), at._rep(o)
        if p == f"<{OWL}sameAs>":
            answer = a == b
        elif p == f"<{OWL}differentFrom>":
            answer = not at.closure.facts.filter((F.col("p") == NEQ) & (F.col("s") == a) & (F.col("o") == b)).isEmpty()
        elif p == TYPE:
            answer = not at.closure.facts.filter((F.col("p") == iri(o)) & (F.col("s") == a) & F.col("o").isNull()).isEmpty()
        else:
            answer = not at.closure.facts.filter((F.col("p") == iri(p)) & (F.col("s") == a) & (F.col("o") == b)).isEmpty()
        if not answer:
            at._guard()
        return answer

    def _schema(self) -> set[tuple]:
        return set(single_atom_closure([r for r in self.ontology.rules if is_single(r)]))

    def _told(self, *rule) -> bool:
        """Whether chains of single-atom rules alone say so, whatever the facts; no closure is needed then."""
        self._guard()
        return rule in self._schema()

    def subsumes(self, sup: str, sub: str) -> bool:
        """Whether every member of ``sub`` is one of ``sup``: by the schema, else by a fresh member."""
        self._guard()
        a, b = term(sup), term(sub)
        if a == b or a == THING or (iri(b), iri(a), 0, None) in self._schema():
            return True
        fresh = "<urn:hornlake:probe:member>"
        probe = self._probe([(fresh, TYPE, b)])
        return bool(probe.closure.violations) or probe.entails(fresh, TYPE, a)

    def equivalent_classes(self, a: str, b: str) -> bool:
        return self.subsumes(a, b) and self.subsumes(b, a)

    def _pair_probe(self, facts: list[tuple[str, str, str]], s: str, p: str, o: str) -> bool:
        self._guard()
        probe = self._probe(facts)
        return bool(probe.closure.violations) or probe.entails(s, p, o)

    _A, _B, _C = (f"<urn:hornlake:probe:{x}>" for x in "abc")

    def subproperty(self, sup: str, sub: str) -> bool:
        p, q = term(sup), term(sub)
        return p == q or self._told(iri(q), iri(p), 0, 1) or self._pair_probe([(self._A, q, self._B)], self._A, p, self._B)

    property_subsumes = subproperty

    def equivalent_properties(self, a: str, b: str) -> bool:
        return self.subproperty(a, b) and self.subproperty(b, a)

    def inverse_properties(self, a: str, b: str) -> bool:
        p, q = term(a), term(b)
        return all(self._told(iri(x), iri(y), 1, 0) or self._pair_probe([(self._A, x, self._B)], self._B, y, self._A) for x, y in ((p, q), (q, p)))

    def is_symmetric(self, prop: str) -> bool:
        p = term(prop)
        return self._told(iri(p), iri(p), 1, 0) or self._pair_probe([(self._A, p, self._B)], self._B, prop, self._A)

    def is_transitive(self, prop: str) -> bool:
        p = term(prop)
        return self._pair_probe([(self._A, p, self._B), (self._B, p, self._C)], self._A, p, self._C)

    def has_domain(self, prop: str, concept: str) -> bool:
        p = term(prop)
        return self._told(iri(p), iri(term(concept)), 0, None) or self._pair_probe([(self._A, p, self._B)], self._A, TYPE, concept)

    def has_range(self, prop: str, concept: str) -> bool:
        p = term(prop)
        return self._told(iri(p), iri(term(concept)), 1, None) or self._pair_probe([(self._A, p, self._B)], self._B, TYPE, concept)

    def is_satisfiable(self, concept: str) -> bool:
        self._guard()
        probe = self._probe([("<urn:hornlake:probe:member>", TYPE, term(concept))])
        if probe.closure.violations:
            return False
        probe._guard()
        return True

    # changes and output

    def update(self, add: Iterable[Triple] = (), remove: Iterable[Triple] = ()) -> str:
        """Adds and removes triples (additions win) and maintains the closure; the method used is returned."""
        if self.base is not None:
            raise ValueError("a table of facts is replaced, not updated: make a new reasoner")
        add, gone = list(add), set(remove) - set(add)
        triples = [t for t in dict.fromkeys([*self.triples, *add]) if t not in gone]
        new = compile_graph(triples, self.profile)  # before anything changes
        closure, method = maintain(self.spark, self.ontology, new, self.closure, **self.limits)
        self.triples, self.ontology, self.closure, self.method = triples, new, closure, method
        self._probes.clear()
        return method

    def to_triples(self, witnesses: bool = False) -> DataFrame:
        """(s, p, o): the closure with aliases written out."""
        types = self.type_view().select(F.col("x").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))
        rows = self.closure.facts.filter(F.col("o").isNotNull() & ~F.col("p").isin(EQ, NEQ))
        pairs = self._shown(rows, ["s", "o"], witnesses).select("s", F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), "o")
        same = self.closure.aliases.select(F.col("node").alias("s"), F.lit(f"<{OWL}sameAs>").alias("p"), F.col("rep").alias("o"))
        out = types.union(pairs).union(same)
        both = self.closure.merged or not rows.filter(F.col("p") == iri(TYPE)).isEmpty()  # else all three are distinct, and differ in p
        return out.distinct() if both else out
