"""Registered queries that apply one ontology construct each to whole tables, and the reasoner's verbs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .model import EQ
from .queries import _customers, _numbered, _ontology, _read, frame

_ID = r"<urn:[a-z]+:0*(\d+)>"


def _id(column: str):
    return F.regexp_extract(column, _ID, 1).cast("long")


def _members(name: str, text: str, concept: str, kind: str, sql: str) -> None:
    """Registers the members of a derived class over customers and orders. kind: c or o, whose numbers are returned as id."""

    @frame(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _ontology(spark, _customers(spark, sf_dir), text).facts
        return found.filter(f"p = 'urn:x:{concept}' and o is null and s like '<urn:{kind}:%'").select(_numbered(kind, "s").alias("id")).distinct()


def _pairs(name: str, text: str, prop: str, sql: str) -> None:
    """Registers the pairs of a derived property over customers and orders, as texts."""

    @frame(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _ontology(spark, _customers(spark, sf_dir), text).facts
        return found.filter(f"p = 'urn:x:{prop}' and o is not null").select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()


def _broken(name: str, text: str) -> None:
    """Registers the orders that break a constraint between the urgent and the filled."""

    @frame(name, "select distinct o_orderkey as id from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .ontology.compiler import compile_graph
        from .ontology.syntax import parse_ontology
        from .plans.closure import Reckoner

        compiled = compile_graph(parse_ontology(f"Namespace(ex = <urn:x:>) Ontology({text})"))
        reckoner = Reckoner(spark, compiled, facts=None)
        rows = reckoner.violation_rows(reckoner.closure(_customers(spark, sf_dir)).facts)
        return rows.select(_numbered("o", "bindings.x0").alias("id")).distinct()


_URGENT, _FILLED = "select distinct o_orderkey as id from orders where o_orderpriority = '1-URGENT'", "select distinct o_orderkey as id from orders where o_orderstatus = 'F'"
_BUYERS = "select distinct o_custkey as id from orders"
_ORDER_PAIRS = "select distinct concat('<urn:c:', o_custkey, '>') x, concat('<urn:o:', o_orderkey, '>') y from orders"

_members("ontology_equivalent_classes", "EquivalentClasses(ex:Urgent ex:Hot)", "Hot", "o", _URGENT)
_members("ontology_conjunction", "SubClassOf(intersectionOf(ex:Urgent ex:Filled) ex:Both)", "Both", "o", f"{_URGENT} intersect {_FILLED}")
_members("ontology_intersection_superclass", "SubClassOf(ex:Urgent intersectionOf(ex:Fast ex:Loud))", "Loud", "o", _URGENT)
_members("ontology_min_cardinality", "SubClassOf(restriction(ex:hasOrder minCardinality(1)) ex:Buyer)", "Buyer", "c", _BUYERS)
_members("ontology_local_range", "Class(ex:Customer partial localrange(ex:hasOrder ex:Bought))", "Bought", "o", "select distinct o_orderkey as id from orders where o_custkey in (select c_custkey from customer)")
_members("ontology_local_domain", "Class(ex:Filled partial localdomain(ex:hasOrder ex:Served))", "Served", "c", "select distinct o_custkey as id from orders where o_orderstatus = 'F'")
_members("ontology_thing", "SubClassOf(owl:Thing ex:Any)", "Any", "o", "select distinct o_orderkey as id from orders")
_members("ontology_thing_subjects", "SubClassOf(owl:Thing ex:Any)", "Any", "c", "select c_custkey as id from customer union select o_custkey from orders")
_members("ontology_chain_of_definitions", "SubClassOf(ex:Urgent ex:Hot) SubClassOf(restriction(ex:hasOrder someValuesFrom(ex:Hot)) ex:Pressed) SubClassOf(ex:Pressed ex:Watched)", "Watched", "c", "select distinct o_custkey as id from orders where o_orderpriority = '1-URGENT'")
_pairs("ontology_equivalent_properties", "EquivalentProperties(ex:hasOrder ex:placed)", "placed", _ORDER_PAIRS)
_pairs("ontology_symmetric", "ObjectProperty(ex:hasOrder Symmetric)", "hasOrder", f"{_ORDER_PAIRS} union select distinct concat('<urn:o:', o_orderkey, '>'), concat('<urn:c:', o_custkey, '>') from orders")
_pairs("ontology_inverse", "ObjectProperty(ex:hasOrder inverseOf(ex:orderOf))", "orderOf", "select distinct concat('<urn:o:', o_orderkey, '>') x, concat('<urn:c:', o_custkey, '>') y from orders")
_pairs("ontology_value_superclass", "SubClassOf(ex:Urgent restriction(ex:needs value(ex:speed)))", "needs", "select distinct concat('<urn:o:', o_orderkey, '>') x, '<urn:x:speed>' y from orders where o_orderpriority = '1-URGENT'")
_pairs("ontology_subproperty_chain", "ObjectProperty(ex:hasOrder super(ex:owns)) ObjectProperty(ex:owns super(ex:touches))", "touches", _ORDER_PAIRS)
_broken("ontology_complement", "Class(ex:Urgent partial complementOf(ex:Filled))")
_broken("ontology_nothing", "SubClassOf(intersectionOf(ex:Urgent ex:Filled) owl:Nothing)")
_broken("ontology_inherited_disjointness", "DisjointClasses(ex:Urgent ex:Old) SubClassOf(ex:Filled ex:Old)")


@frame("ontology_one_of", "select distinct n_nationkey as id from nation where n_regionkey in (0, 3)")
def ontology_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that lie in one of two named regions."""
    facts = _read(spark, sf_dir, "nation").selectExpr("'urn:x:in' p", "concat('<urn:n:', n_nationkey, '>') s", "concat('<urn:x:r', n_regionkey, '>') o")
    found = _ontology(spark, facts, "SubClassOf(oneOf(ex:r0 ex:r3) ex:Near) SubClassOf(restriction(ex:in someValuesFrom(ex:Near)) ex:Close)").facts
    return found.filter("p = 'urn:x:Close'").select(_numbered("n", "s").alias("id")).distinct()


def _merged(found, kept: DataFrame) -> DataFrame:
    """(id, representative) of ``kept`` (s), merged or not."""
    merged = found.aliases.select(F.col("node").alias("s"), "rep")
    return kept.distinct().join(merged, "s", "left").select(_id("s").alias("id"), _id(F.coalesce("rep", "s")).alias("representative")).distinct()


@frame("ontology_functional", "select distinct doc_id id, min(doc_id) over (partition by source) representative from documents where source is not null")
def ontology_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A functional property's values are one: the first documents of a source stand for the others."""
    facts = _read(spark, sf_dir, "documents").filter("source is not null").selectExpr("'urn:x:first' p", "concat('<urn:source:', source, '>') s", "concat('<urn:doc:', lpad(doc_id, 12, '0'), '>') o")
    found = _ontology(spark, facts, "ObjectProperty(ex:first Functional)")
    return _merged(found, facts.select(F.col("o").alias("s")))


@frame("ontology_max_cardinality", "select distinct o_orderkey id, case when c_mktsegment = 'BUILDING' then min(o_orderkey) over (partition by o_custkey) else o_orderkey end representative from orders join customer on c_custkey = o_custkey")
def ontology_max_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a class with at most one value: their values are one, those of others aren't."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    has = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).selectExpr("'urn:x:has' p", "concat('<urn:c:', c_custkey, '>') s", "concat('<urn:o:', lpad(o_orderkey, 12, '0'), '>') o")
    facts = has.union(customers.filter("c_mktsegment = 'BUILDING'").selectExpr("'urn:x:Single'", "concat('<urn:c:', c_custkey, '>')", "cast(null as string)"))
    found = _ontology(spark, facts, "SubClassOf(ex:Single restriction(ex:has maxCardinality(1)))")
    return _merged(found, has.select(F.col("o").alias("s")))


@frame(
    "same_individuals",
    """with d as (select distinct doc_id, doc_id // 7 run, lang from documents where lang is not null)
    select doc_id id, min(doc_id) over (partition by run, lang) representative from d""",
)
def same_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of stated equalities, each document with the next of its run and language."""
    from pyspark.sql import Window

    docs = _read(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", F.floor(F.col("doc_id") / 7).alias("run"), "lang").distinct()
    name = lambda c: F.concat(F.lit("<urn:doc:"), F.lpad(F.col(c).cast("string"), 12, "0"), F.lit(">"))
    after = docs.withColumn("next", F.lead("doc_id").over(Window.partitionBy("run", "lang").orderBy("doc_id")))
    facts = after.filter("next is not null").select(F.lit(EQ).alias("p"), name("doc_id").alias("s"), name("next").alias("o"))
    typed = docs.select(F.lit("urn:x:Doc").alias("p"), name("doc_id").alias("s"), F.lit(None).cast("string").alias("o"))
    return _merged(_ontology(spark, facts.union(typed), "SubClassOf(ex:Doc ex:Text)"), typed.select("s"))


@frame("congruence_of_merged", "select distinct min(doc_id) over (partition by source) id, lang from documents where source is not null and lang is not null")
def congruence_of_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a merged document is said of its representative."""
    docs = _read(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    doc = "concat('<urn:doc:', lpad(doc_id, 12, '0'), '>')"
    facts = docs.selectExpr("'urn:x:first' p", "concat('<urn:source:', source, '>') s", f"{doc} o").union(docs.selectExpr("'urn:x:speaks'", doc, "concat('<urn:lang:', lang, '>')"))
    found = _ontology(spark, facts, "ObjectProperty(ex:first Functional)").facts
    return found.filter("p = 'urn:x:speaks'").select(_id("s").alias("id"), F.regexp_extract("o", "<urn:lang:(.*)>", 1).alias("lang")).distinct()


@frame("ntriples_round_trip", f"{_ORDER_PAIRS}")
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as N-Triples files and read again."""
    from .sources.rdf import read_ntriples, write_ntriples
    from .storage import shared_dir

    path = f"{shared_dir(spark)}/hornlake/triples-{uuid.uuid4().hex}"
    rows = _read(spark, sf_dir, "orders").selectExpr("concat('<urn:c:', o_custkey, '>') s", "'<urn:x:hasOrder>' p", "concat('<urn:o:', o_orderkey, '>') o").distinct()
    write_ntriples(rows, path)
    return read_ntriples(spark, path).select(F.col("s").alias("x"), F.col("o").alias("y"))


_FAMILY = """Namespace(ex = <urn:x:>) Ontology(
SubClassOf(ex:Composer ex:Musician) SubClassOf(ex:Musician ex:Person) EquivalentClasses(ex:Person ex:Human) DisjointClasses(ex:Person ex:Work)
Class(ex:Parent complete intersectionOf(ex:Person restriction(ex:hasChild someValuesFrom(ex:Person))))
ObjectProperty(ex:hasChild super(ex:ancestorOf) inverseOf(ex:hasParent) domain(ex:Person) range(ex:Person))
ObjectProperty(ex:ancestorOf Transitive) ObjectProperty(ex:near Symmetric) EquivalentProperties(ex:near ex:close)
SubClassOf(ex:Odd intersectionOf(ex:Person ex:Work)))"""
#: verb, arguments, and what holds of that ontology
_VERBS = [
    ("subsumes", "Person Composer", True), ("subsumes", "Composer Person", False), ("subsumes", "Person Parent", True), ("equivalent_classes", "Person Human", True), ("equivalent_classes", "Person Musician", False),
    ("subproperty", "ancestorOf hasChild", True), ("subproperty", "hasChild ancestorOf", False), ("equivalent_properties", "near close", True), ("equivalent_properties", "near hasChild", False),
    ("inverse_properties", "hasChild hasParent", True), ("inverse_properties", "hasChild near", False), ("is_symmetric", "near", True), ("is_symmetric", "hasChild", False), ("is_transitive", "ancestorOf", True), ("is_transitive", "hasChild", False),
    ("has_domain", "hasChild Person", True), ("has_range", "hasChild Person", True), ("has_range", "near Person", False), ("is_satisfiable", "Composer", True), ("is_satisfiable", "Odd", False),
]


@frame("reasoner_schema", "select * from (values " + ", ".join(f"('{v}', '{a}', {str(h).lower()})" for v, a, h in _VERBS) + ") t(verb, arguments, holds)")
def reasoner_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasoner's questions about classes and properties, of a fixed ontology; no table is read."""
    from .reasoner import Reasoner

    r = Reasoner.from_text(spark, _FAMILY)
    return spark.createDataFrame([(v, a, getattr(r, v)(*(f"<urn:x:{x}>" for x in a.split()))) for v, a, _ in _VERBS], "verb string, arguments string, holds boolean")


def _over_orders(spark: SparkSession, sf_dir: str):
    from .reasoner import Reasoner

    text = "Namespace(ex = <urn:x:>) Ontology(SubClassOf(ex:Customer ex:Party) ObjectProperty(ex:hasOrder inverseOf(ex:orderOf) range(ex:Order)) SubClassOf(ex:Urgent ex:Order))"
    return Reasoner.from_text(spark, text, base=_customers(spark, sf_dir))


@frame("reasoner_instances", "select c_custkey as id from customer")
def reasoner_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_orders(spark, sf_dir).class_relation("urn:x:Party").select(_numbered("c", "x").alias("id"))


@frame("reasoner_property_pairs", "select distinct concat('<urn:o:', o_orderkey, '>') x, concat('<urn:c:', o_custkey, '>') y from orders")
def reasoner_property_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_orders(spark, sf_dir).property_relation("urn:x:orderOf")


@frame(
    "reasoner_types",
    """select concat('<urn:c:', c_custkey, '>') x, unnest(['<urn:x:Customer>', '<urn:x:Party>']) c from customer union
    select concat('<urn:o:', o_orderkey, '>'), '<urn:x:Order>' from orders union select concat('<urn:o:', o_orderkey, '>'), '<urn:x:Urgent>' from orders where o_orderpriority = '1-URGENT'
    union select concat('<urn:o:', o_orderkey, '>'), '<urn:x:Filled>' from orders where o_orderstatus = 'F'""",
)
def reasoner_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_orders(spark, sf_dir).type_view()


@frame("reasoner_triples", "select 'type' p, count(*) n from (select c_custkey, unnest([1, 2]) from customer union all select distinct o_orderkey, 3 from orders union all select distinct o_orderkey, 4 from orders where o_orderpriority = '1-URGENT' union all select distinct o_orderkey, 5 from orders where o_orderstatus = 'F') union all select unnest(['hasOrder', 'orderOf', 'status']), count(distinct o_orderkey) from orders")
def reasoner_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole closure as triples, counted by property."""
    triples = _over_orders(spark, sf_dir).to_triples()
    return triples.groupBy(F.regexp_extract("p", "[#:]([A-Za-z]+)>$", 1).alias("p")).agg(F.count("*").alias("n"))
