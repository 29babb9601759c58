import random

import pytest
from pyspark.sql import functions as F

from hornlake.errors import IncompleteError, InconsistentError, ParseError
from hornlake.ontology.compiler import ProfileError, compile_graph
from hornlake.ontology.syntax import parse_ontology
from hornlake.plans.closure import Reckoner
from hornlake.queries import _ontology
from hornlake.reasoner import Reasoner
from hornlake.sources.packages import PackageError, compile_package, dumps, loads
from hornlake.sources.rdf import TYPE, parse_rdfxml, parse_turtle, read_ntriples, to_ntriples, to_turtle, write_ntriples

EX = "urn:x:"
x = lambda n: f"<{EX}{n}>"
THING = "<http://www.w3.org/2002/07/owl#Thing>"


def doc(body):
    return f"Namespace(ex = <{EX}>)\nOntology({body})"


FAMILY = doc("""
    SubClassOf(ex:Musician ex:Person) SubClassOf(ex:Composer ex:Musician)
    Class(ex:Parent complete intersectionOf(ex:Person restriction(ex:hasChild someValuesFrom(ex:Person))))
    ObjectProperty(ex:hasChild super(ex:ancestorOf) inverseOf(ex:hasParent) domain(ex:Person) range(ex:Person))
    ObjectProperty(ex:ancestorOf Transitive) ObjectProperty(ex:key InverseFunctional) ObjectProperty(ex:near Symmetric)
    DisjointClasses(ex:Person ex:Work)
    Individual(ex:a type(ex:Composer) value(ex:hasChild ex:b) value(ex:key ex:k1))
    Individual(ex:a2 value(ex:key ex:k1)) Individual(ex:b value(ex:hasChild ex:c) value(ex:near ex:c))
""")


@pytest.fixture(scope="module")
def family(spark):
    return Reasoner.from_text(spark, FAMILY)


def test_verbs(family):
    r = family
    assert (r.consistency, r.complete) == ("consistent", True)
    assert r.instances("urn:x:Parent") == {x("a"), x("a2"), x("b")}
    assert r.types(x("a2")) >= {x("Composer"), x("Person"), x("Parent")}
    assert r.property_values(x("a2"), x("ancestorOf")) == {x("b"), x("c")}
    assert (x("c"), x("b")) in r.property_pairs(x("hasParent")) and (x("c"), x("b")) in r.property_pairs(x("near"))
    assert r.entails(x("a"), "http://www.w3.org/2002/07/owl#sameAs", x("a2"))
    assert r.entails(x("c"), TYPE, x("Person")) and not r.entails(x("c"), TYPE, x("Parent"))
    assert r.subsumes(x("Person"), x("Composer")) and not r.subsumes(x("Composer"), x("Person"))
    assert r.subsumes(x("Person"), x("Parent")) and r.subproperty(x("ancestorOf"), x("hasChild"))
    assert r.is_transitive(x("ancestorOf")) and not r.is_transitive(x("hasChild"))
    assert r.is_symmetric(x("near")) and r.inverse_properties(x("hasChild"), x("hasParent"))
    assert r.has_domain(x("hasChild"), x("Person")) and r.has_range(x("hasChild"), x("Person")) and not r.has_range(x("near"), x("Person"))
    assert r.is_satisfiable(x("Composer"))
    described = parse_turtle(f"_:q <http://www.w3.org/2002/07/owl#onProperty> {x('hasChild')} ; <http://www.w3.org/2002/07/owl#hasValue> {x('c')} .")
    assert r.instances("_:q", described) == {x("b")}
    assert r.stats["rules"] == len(r.ontology.rules)


def test_constraints_and_differences(spark):
    bad = Reasoner.from_text(spark, doc("DisjointClasses(ex:A ex:B) Individual(ex:i type(ex:A) type(ex:B))"))
    assert bad.consistency == "inconsistent"
    with pytest.raises(InconsistentError):
        bad.instances(x("A"))
    clash = Reasoner.from_text(spark, doc("SameIndividual(ex:a ex:b) DifferentIndividuals(ex:a ex:b)"))
    assert clash.consistency == "inconsistent"
    two = Reasoner.from_text(spark, doc('ObjectProperty(ex:p Functional) Individual(ex:a value(ex:p "1"^^xsd:integer) value(ex:p "2"^^xsd:integer))'))
    assert two.consistency == "inconsistent"
    one = Reasoner.from_text(spark, doc('ObjectProperty(ex:p Functional) Individual(ex:a value(ex:p "1"^^xsd:integer) value(ex:p "01"^^xsd:integer))'))
    assert one.consistency == "consistent"
    assert not Reasoner.from_text(spark, doc("Class(ex:M partial complementOf(ex:W)) Class(ex:X partial ex:M ex:W)")).is_satisfiable(x("X"))


def test_witnesses_and_bounds(spark):
    r = Reasoner.from_text(spark, doc("SubClassOf(ex:Parent restriction(ex:hasChild someValuesFrom(ex:Person))) Individual(ex:a type(ex:Parent))"))
    assert r.instances(x("Person")) == set() and len(r.instances(x("Person"), witnesses=True)) == 1
    endless = Reasoner.from_text(spark, doc("SubClassOf(ex:P restriction(ex:q someValuesFrom(ex:P))) Individual(ex:a type(ex:P))"), depth=3)
    assert not endless.complete and endless.consistency == "unknown"
    assert endless.entails(x("a"), TYPE, x("P"))
    with pytest.raises(IncompleteError):
        endless.entails(x("a"), TYPE, x("Q"))


def test_shared_keys_grow_with_their_rows(spark):
    """60 copies are 3,540 ordered pairs; the bound leaves room for a star."""
    facts = spark.createDataFrame([("urn:x:key", f"<urn:d:{k:02}>", f"<urn:k:{k // 60}>") for k in range(61)], "p string, s string, o string")
    for text, turned in (("ObjectProperty(ex:key InverseFunctional)", facts), ("ObjectProperty(ex:key Functional)", facts.select("p", F.col("o").alias("s"), F.col("s").alias("o")))):
        found = Reckoner(spark, compile_graph(parse_ontology(doc(text))), facts=500).closure(turned)
        assert found.complete
        assert {tuple(r) for r in found.aliases.collect()} == {(f"<urn:d:{k:02}>", "<urn:d:00>") for k in range(1, 60)}


def test_queries_refuse_incomplete_closures(spark, monkeypatch):
    monkeypatch.setattr(Reckoner.__init__, "__defaults__", (1000, 1_000_000, 2))
    facts = spark.createDataFrame([("urn:x:P", "<urn:x:a>", None)], "p string, s string, o string")
    with pytest.raises(IncompleteError):
        _ontology(spark, facts, "SubClassOf(ex:P restriction(ex:q someValuesFrom(ex:P)))")


def test_constructors(spark):
    r = Reasoner.from_text(
        spark,
        doc("""
        SubClassOf(unionOf(ex:A ex:B) ex:AB) SubClassOf(oneOf(ex:i ex:j) ex:Listed) EnumeratedClass(ex:Only ex:k)
        SubClassOf(ex:A restriction(ex:p allValuesFrom(ex:C))) SubClassOf(ex:A restriction(ex:q value(ex:v)))
        SubClassOf(restriction(ex:p minCardinality(1)) ex:HasP) SubClassOf(ex:F restriction(ex:f maxCardinality(1)))
        Class(ex:D partial localrange(ex:r ex:E)) Class(ex:G partial localdomain(ex:s ex:H)) SubClassOf(owl:Thing ex:Any)
        EquivalentProperties(ex:p ex:p2) SubClassOf(ex:N intersectionOf(ex:N1 ex:N2))
        Individual(ex:i type(ex:A) value(ex:p ex:o)) Individual(ex:m type(ex:Only)) Individual(ex:fa type(ex:F) value(ex:f ex:x1) value(ex:f ex:x2))
        Individual(ex:d type(ex:D) value(ex:r ex:e)) Individual(ex:t value(ex:s ex:g)) Individual(ex:g type(ex:G)) Individual(ex:n type(ex:N))
        """),
    )
    assert r.instances(x("AB")) == {x("i")} and r.instances(x("Listed")) == {x("i"), x("j")} and x("o") in r.instances(x("C"))
    assert r.property_values(x("i"), x("q")) == {x("v")} and r.instances(x("HasP")) == {x("i")} and (x("i"), x("o")) in r.property_pairs(x("p2"))
    same = "http://www.w3.org/2002/07/owl#sameAs"
    assert r.entails(x("x1"), same, x("x2")) and r.entails(x("m"), same, x("k"))
    assert r.instances(x("E")) == {x("e")} and r.instances(x("H")) == {x("t")} and r.instances(x("N2")) == {x("n")}
    assert x("g") in r.instances(x("Any")) and r.entails(x("new"), TYPE, x("Any")) and r.entails(x("new"), TYPE, THING)


def test_rejections():
    for body, profile in (
        ("SubClassOf(ex:A unionOf(ex:B ex:C))", "L3"), ("SubClassOf(restriction(ex:p allValuesFrom(ex:A)) ex:B)", "L3"), ("SubClassOf(ex:A restriction(ex:p maxCardinality(2)))", "L3"),
        ("SubClassOf(ex:A restriction(ex:p someValuesFrom(ex:B)))", "L2"), ("DisjointClasses(ex:A ex:B)", "L1"), ("ObjectProperty(ex:p Functional)", "L0"),
    ):
        with pytest.raises(ProfileError):
            compile_graph(parse_ontology(doc(body)), profile)
    for text in ("Ontology(", "Namespace(a = <x:>) Ontology(Class(a:B sometimes))", "Ontology(Class(b:C partial))", "Ontology(Foo())"):
        with pytest.raises(ParseError):
            parse_ontology(text)


def fresh(spark, triples):
    return Reasoner(spark, triples).closure


@pytest.mark.parametrize("seed", range(2))
def test_updates_equal_a_fresh_closure(spark, seed):
    rng = random.Random(seed)
    base = parse_ontology(doc("ObjectProperty(ex:e Transitive super(ex:f)) SubClassOf(ex:A ex:B) SubClassOf(intersectionOf(ex:B restriction(ex:e someValuesFrom(ex:A))) ex:C)"))
    n = lambda: x(f"n{rng.randrange(6)}")
    some = lambda: (n(), x("e"), n()) if rng.random() < 0.7 else (n(), TYPE, x("A"))
    facts = list({some() for _ in range(8)})
    r = Reasoner(spark, [*base, *facts])
    methods = []
    for k in range(3):
        gone = rng.sample(facts, 2) if k != 1 else []
        come = [some()]
        if k == 2:
            gone, come = [t for t in base if "subPropertyOf" in t[1]], come
        methods.append(r.update(come, gone))
        facts = [t for t in dict.fromkeys([*facts, *come]) if t not in set(gone) - set(come)]
        expected = fresh(spark, r.triples)
        assert {tuple(v) for v in r.closure.facts.collect()} == {tuple(v) for v in expected.facts.collect()}
    assert methods[0] in ("dred", "unchanged") and methods[1] in ("incremental-insert", "unchanged") and methods[2] == "dred-rules"


def test_new_rules_and_rematerialisation(spark):
    r = Reasoner.from_text(spark, doc("Individual(ex:a value(ex:p ex:b))"))
    sub = "<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>"
    assert r.update([(x("p"), sub, x("q"))]) == "incremental-rules" and r.property_pairs(x("q")) == {(x("a"), x("b"))}
    assert r.update([(x("a"), "<http://www.w3.org/2002/07/owl#sameAs>", x("c"))]) == "rematerialize"
    assert r.property_pairs(x("q")) == {(x("a"), x("b")), (x("c"), x("b"))}


def test_rdf_formats(spark, tmp_path):
    ttl = '@prefix e: <urn:x:> . e:a a e:C ; e:p "v"@EN, 3, 2.5, true, [ e:q (e:l1 e:l2) ] . e:b e:p "x\\ny"^^e:t .'
    triples = parse_turtle(ttl)
    assert (x("a"), x("p"), '"v"@en') in triples and len(triples) == 12
    assert set(parse_turtle(to_turtle(triples))) == set(triples) == set(parse_turtle(to_ntriples(triples)))
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:x:"><e:C rdf:about="urn:x:a"><e:p rdf:resource="urn:x:b"/><e:q>t</e:q></e:C></rdf:RDF>'
    assert set(parse_rdfxml(xml)) == {(x("a"), TYPE, x("C")), (x("a"), x("p"), x("b")), (x("a"), x("q"), '"t"')}
    with pytest.raises(ParseError):
        parse_turtle("<a> <b> ")
    path = str(tmp_path / "t")
    write_ntriples(spark.createDataFrame(triples, "s string, p string, o string"), path)
    assert {tuple(r) for r in read_ntriples(spark, path).collect()} == set(triples)
    (tmp_path / "bad.nt").write_text("<a> b .\n")
    with pytest.raises(Exception, match="no triple"):
        read_ntriples(spark, str(tmp_path / "bad.nt")).collect()


def test_output_and_packages(spark, family, tmp_path):
    rows = {tuple(r) for r in family.to_triples().collect()}
    assert (x("a2"), x("hasChild"), x("b")) in rows and (x("c"), TYPE, x("Person")) in rows
    package = compile_package(parse_ontology(FAMILY), "L3", "version 1 prefix n: <urn:dlp:numeric:> a(?x) :- b(?x), filter n:lessThan(?x, 3).")
    data = dumps(package)
    again = loads(data)
    assert again.ontology.rules == package.ontology.rules and again.ontology.facts == package.ontology.facts
    with pytest.raises(PackageError):
        loads(data[:-1])
    from hornlake.cli import main

    (tmp_path / "f.dlp").write_text(FAMILY)
    assert main(["rules", str(tmp_path / "f.dlp")]) == 0
    assert main(["instances", str(tmp_path / "f.dlp"), "urn:x:Parent"]) == 0
    assert main(["materialize", str(tmp_path / "f.dlp"), "-o", str(tmp_path / "o.nt")]) == 0
    assert set(parse_turtle((tmp_path / "o.nt").read_text())) == rows
    assert main(["validate", str(tmp_path / "none.dlp")]) == 1
    (tmp_path / "bad.dlp").write_text(doc("DisjointClasses(ex:A ex:B) Individual(ex:i type(ex:A) type(ex:B))"))
    assert main(["validate", str(tmp_path / "bad.dlp")]) == 2


def test_rules_over_an_ontology(spark):
    from hornlake.errors import DomainError
    from hornlake.functions.decode import decode, encode, typed
    from hornlake.plans.runtime import QueryRuntime

    date = lambda d: f'"{d}"^^xsd:date'
    r = Reasoner.from_text(
        spark,
        doc(f"""ObjectProperty(ex:hasSon super(ex:hasChild)) SubClassOf(ex:Father ex:Parent)
        Individual(ex:f type(ex:Father) value(ex:hasSon ex:c1) value(ex:hasSon ex:c2) value(ex:born {date('1685-03-31')}))
        Individual(ex:c1 value(ex:born {date('1708-12-27')})) Individual(ex:c2 value(ex:born {date('1710-11-22')}))
        Individual(ex:m type(ex:Parent) value(ex:hasChild ex:c1) value(ex:born {date('1684-10-20')}))"""),
    )
    text = f"""version 1
    prefix ex: <{EX}> prefix time: <urn:dlp:temporal:> prefix policy: <urn:dlp:calendar-policy:>
    dated(?p, ?c, ?d) given (?scope, ?revision) :- ex:hasChild(?p, ?c), accepted(?c, ?d).
    first(?p, ?m) given (?scope, ?revision) :- MIN ?d GROUP_BY ?p FROM dated(?p, ?c, ?d) AS ?m.
    firstborn(?p, ?c) given (?scope, ?revision) :- first(?p, ?d), dated(?p, ?c, ?d).
    age(?p, ?y) given (?scope, ?revision) :- rdf:type(?p, ex:Parent), first(?p, ?d), accepted(?p, ?b), bind time:completedYears(?b, ?d, policy:march1) as ?y.
    """
    accepted = typed(r.property_relation(x("born")), {"y": "date"})
    runtime = QueryRuntime(spark, text)
    result = runtime.evaluate({"urn:dlp:query:accepted": accepted}, reasoner=r, scope=("urn:s", "1"))
    assert result.rows("urn:dlp:query:age") == {(x("f"), 23), (x("m"), 24)}
    assert result.rows("urn:dlp:query:firstborn") == {(x("f"), x("c1")), (x("m"), x("c1"))}
    r.update([(x("f"), x("hasSon"), x("c0")), (x("c0"), x("born"), f'"1707-01-01"^^<http://www.w3.org/2001/XMLSchema#date>')])
    accepted = typed(r.property_relation(x("born")), {"y": "date"})
    result = runtime.evaluate({"urn:dlp:query:accepted": accepted}, reasoner=r, scope=("urn:s", "2"))
    changed = lambda which: {tuple(v) for v in getattr(result, which)["urn:dlp:query:age"].collect()}
    assert changed("additions") == {(x("f"), 21)} and changed("retractions") == {(x("f"), 23)}

    xsd = "http://www.w3.org/2001/XMLSchema#"
    rows = [(f'"2.50"^^<{xsd}decimal>', "decimal"), (f'"007"^^<{xsd}integer>', "integer"), (f'"2024-01-01T00:00:00.5+01:00"^^<{xsd}dateTime>', "instant")]
    for literal, kind in rows:
        df = spark.createDataFrame([(literal,)], "t string").select(encode(decode(F.col("t"), kind)[0], kind).alias("v"))
        assert df.first().v in (f'"2.5"^^<{xsd}decimal>', f'"7"^^<{xsd}integer>', f'"2023-12-31T23:00:00.500000Z"^^<{xsd}dateTime>')
    for bad in ('"2024-1-1"^^<' + xsd + "date>", "<urn:x:a>", '"2024-02-30"^^<' + xsd + "date>"):
        with pytest.raises(Exception, match="(TYPE|DOMAIN)_ERROR"):
            typed(spark.createDataFrame([(bad,)], "t string"), {"t": "date"}).collect()
    with pytest.raises(DomainError):
        decode(None, "colour")


def test_shared_keys_with_tests_of_the_key_make_stars(spark):
    from hornlake.ontology.compiler import compile_graph
    from hornlake.plans.closure import Reckoner, shared_key
    from hornlake.ontology.syntax import parse_ontology

    compiled = compile_graph(parse_ontology("Namespace(ex = <urn:x:>) Ontology(SubClassOf(ex:Single restriction(ex:has maxCardinality(1))))"))
    rule = next(r for r in compiled.rules if r.head is not None)
    assert shared_key(rule) is not None
    facts = [("urn:x:has", f"<urn:c:{c}>", f"<urn:o:{c}{k}>") for c in "abc" for k in range(9)] + [("urn:x:Single", "<urn:c:a>", None), ("urn:x:Single", "<urn:c:c>", None)]
    reckoner = Reckoner(spark, compiled, facts=None)
    table = spark.createDataFrame(facts + facts, "p string, s string, o string")
    edges = reckoner.round(table.distinct(), table.distinct(), {"urn:x:has", "urn:x:Single"}, full=True)
    assert sorted((r.s, r.o) for r in edges.collect()) == [(f"<urn:o:{c}{k}>", f"<urn:o:{c}0>") for c in "ac" for k in range(1, 9)]
    found = reckoner.closure(table)
    assert {(r.node, r.rep) for r in found.aliases.collect()} == {(f"<urn:o:{c}{k}>", f"<urn:o:{c}0>") for c in "ac" for k in range(1, 9)}
    assert found.facts.count() == found.facts.distinct().count() == 2 + 2 + 9


def test_first_round_runs_a_rule_once(spark, monkeypatch):
    from hornlake.ontology.compiler import compile_graph
    from hornlake.plans.closure import Reckoner
    from hornlake.ontology.syntax import parse_ontology

    compiled = compile_graph(parse_ontology("Namespace(ex = <urn:x:>) Ontology(Class(ex:Pressed complete intersectionOf(ex:Customer restriction(ex:hasOrder someValuesFrom(ex:Urgent)))))"))
    runs, derived = [], Reckoner._derived
    monkeypatch.setattr(Reckoner, "_derived", lambda self, rule, views: runs.append(len(rule.body)) or derived(self, rule, views))
    facts = [("urn:x:Customer", "<a>", None), ("urn:x:hasOrder", "<a>", "<o>"), ("urn:x:Urgent", "<o>", None), ("urn:x:Customer", "<b>", None)]
    found = Reckoner(spark, compiled, facts=None).closure(spark.createDataFrame(facts, "p string, s string, o string")).facts
    assert runs[0] == 3 and runs[1] != 3  # the three joined atoms once, though all three are new
    assert [r.s for r in found.filter("p = 'urn:x:Pressed'").collect()] == ["<a>"]


def test_triples_of_unmerged_closures_need_no_distinct(spark):
    text = "Namespace(ex = <urn:x:>) Ontology(SubClassOf(ex:A ex:B) Individual(ex:i type(ex:A) value(ex:p ex:j)))"
    triples = Reasoner.from_text(spark, text).to_triples()
    plan = triples._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    rows = [tuple(r) for r in triples.collect()]
    assert len(rows) == len(set(rows)) and ("<urn:x:i>", "<urn:x:p>", "<urn:x:j>") in rows
    merged = Reasoner.from_text(spark, text[:-1] + " SameIndividual(ex:i ex:k))").to_triples()
    again = [tuple(r) for r in merged.collect()]
    assert len(again) == len(set(again)) and {("<urn:x:i>", "<urn:x:p>", "<urn:x:j>"), ("<urn:x:k>", "<urn:x:p>", "<urn:x:j>")} <= set(again)
