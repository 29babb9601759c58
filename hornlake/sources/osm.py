"""OpenStreetMap XML (v0.6): snapshots, changes, validation, projection to relations.

Elements are rows of ELEMENT. XML is read with Spark's reader, one row an
element; the projection is a union of exploded arrays and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import DomainError
from ..operators.graphs import affected

ELEMENT = "type string, id long, version long, lat double, lon double, nodes array<long>, members array<struct<type: string, ref: long, role: string>>, tags map<string, string>, timestamp string, changeset string"
NAMESPACE, DATA = "https://example.org/osm#", "https://example.org/osm/data/"
# fixed values: which ways are roads, which roles make a way part of a route, which tags are properties
ROAD_HIGHWAYS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road", "track",
)
ROAD_ROLES = ("", "forward", "backward", "north", "south", "east", "west")
KEY_PROPERTIES = {
    "highway": "highway", "name": "name", "ref": "ref", "oneway": "oneway", "maxspeed": "maxspeedRaw",
    "maxspeed:conditional": "maxspeedConditionalRaw", "lanes": "lanes", "surface": "surface", "access": "access",
    "bridge": "bridge", "tunnel": "tunnel", "junction": "junction", "traffic_sign": "trafficSignRaw",
    "type": "relationType", "route": "route",
}
_CHILD = "tag array<struct<_k: string, _v: string>>, nd array<struct<_ref: long>>, member array<struct<_type: string, _ref: long, _role: string>>"
_FIELDS = "_id: long, _version: long, _lat: double, _lon: double, _timestamp: string, _changeset: string, tag: array<struct<_k: string, _v: string>>, nd: array<struct<_ref: long>>, member: array<struct<_type: string, _ref: long, _role: string>>"
_ROW = f"_id long, _version long, _lat double, _lon double, _timestamp string, _changeset string, {_CHILD}"


def _elements(rows: DataFrame, kind: str) -> DataFrame:
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    return rows.select(
        F.lit(kind).alias("type"), F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
        F.transform(empty("nd", "array<struct<_ref: long>>"), lambda x: x["_ref"]).alias("nodes"),
        F.transform(empty("member", "array<struct<_type: string, _ref: long, _role: string>>"), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))).alias("members"),
        F.map_from_entries(F.transform(empty("tag", "array<struct<_k: string, _v: string>>"), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags"),
        F.col("_timestamp").alias("timestamp"), F.col("_changeset").alias("changeset"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an OSM XML snapshot. A document type declaration isn't resolved."""
    frames = [_elements(spark.read.format("xml").option("rowTag", kind).schema(_ROW).load(path), kind) for kind in ("node", "way", "relation")]
    return validate(reduce(DataFrame.union, frames))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """(action, element columns) of an osmChange document."""
    frames = []
    for action in ("create", "modify", "delete"):
        inner = ", ".join(f"{kind} array<struct<{_FIELDS}>>" for kind in ("node", "way", "relation"))
        block = spark.read.format("xml").option("rowTag", action).schema(inner).load(path)
        for kind in ("node", "way", "relation"):
            rows = block.select(F.explode(kind).alias("e")).select("e.*")
            frames.append(_elements(rows, kind).select(F.lit(action).alias("action"), "*"))
    return reduce(DataFrame.union, frames)


def validate(elements: DataFrame, deleted: bool = False) -> DataFrame:
    """The elements; raises, when it runs, on a bad id, version or coordinate, or a repeated element."""
    place = F.lit(True) if deleted else (F.col("type") != "node") | ((F.abs("lat") <= 90) & (F.abs("lon") <= 180))
    good = (F.col("id").isNotNull()) & (F.col("version") >= 1) & place
    raised = F.raise_error(F.concat(F.lit("@@DOMAIN_ERROR: bad element "), F.coalesce(F.col("type"), F.lit("?")), F.lit(" "), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit("@@"))).isNull()
    return elements.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(raised))


def references(elements: DataFrame) -> DataFrame:
    """(type, id, ref_type, ref): what ways and relations point to."""
    nodes = elements.select("type", "id", F.lit("node").alias("ref_type"), F.explode("nodes").alias("ref"))
    members = elements.select("type", "id", F.explode("members").alias("m")).select("type", "id", "m.type", "m.ref").toDF("type", "id", "ref_type", "ref")
    return nodes.union(members).distinct()


def unresolved(elements: DataFrame) -> DataFrame:
    keys = elements.select(F.col("type").alias("ref_type"), F.col("id").alias("ref"))
    return references(elements).join(keys, ["ref_type", "ref"], "left_anti")


def apply_changes(state: DataFrame, changes: DataFrame, tombstones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, tombstones (type, id, version)) after one transaction; raises and changes nothing if it is wrong.

    A create is a new element of version 1; modify and delete name the next
    version of one that exists; an element changes once; all references resolve.
    """
    spark = state.sparkSession
    gone = tombstones if tombstones is not None else spark.createDataFrame([], "type string, id long, version long")
    twice = changes.groupBy("type", "id").count().filter("count > 1").first()
    if twice:
        raise DomainError("DOMAIN_ERROR", f"{twice['type']} {twice['id']} changes twice")
    old = state.select("type", "id", F.col("version").alias("was"))
    dead = gone.select("type", "id", F.col("version").alias("died"))
    checked = changes.join(old, ["type", "id"], "left").join(dead, ["type", "id"], "left")
    new_ok = (F.col("action") == "create") & F.col("was").isNull() & F.col("died").isNull() & (F.col("version") == 1)
    next_ok = F.col("action").isin("modify", "delete") & (F.col("version") == F.col("was") + 1)
    stale = checked.filter(~F.coalesce(new_ok | next_ok, F.lit(False))).first()
    if stale:
        raise DomainError("DOMAIN_ERROR", f"stale {stale['action']} of {stale['type']} {stale['id']}")
    columns = state.columns
    kept = state.join(changes.select("type", "id"), ["type", "id"], "left_anti").select(*columns)
    new = kept.union(validate(changes.filter("action <> 'delete'").select(*columns)))
    missing = unresolved(new).first()
    if missing:
        raise DomainError("DOMAIN_ERROR", f"{missing['ref_type']} {missing['ref']} isn't there")
    return new, gone.union(changes.filter("action = 'delete'").select("type", "id", "version"))


def affected_elements(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """(type, id) of changed elements and all that refer to them, before or after."""
    name = lambda t, i: F.concat_ws("/", t, F.col(i).cast("string"))
    edges = references(old).union(references(new)).select(name("type", "id").alias("id"), name("ref_type", "ref").alias("needs")).distinct()
    found = affected(edges, changes.select(name("type", "id").alias("id")))
    return found.select(F.split("id", "/")[0].alias("type"), F.split("id", "/")[1].cast("long").alias("id"))


def _road(prefix: str = ""):
    tags = F.col(f"{prefix}tags")
    return F.coalesce((F.col(f"{prefix}type") == "way") & tags["highway"].isin(*ROAD_HIGHWAYS) & F.coalesce(tags["area"] != "yes", F.lit(True)), F.lit(False))


def project(elements: DataFrame, snapshot: str, once: bool = False) -> DataFrame:
    """(s, p, o) of a snapshot: elements, tags, way nodes, memberships, road segments and parts of routes.

    ``once``: no (type, id) is repeated, so only parts of routes can be, and just these are made distinct.
    """
    iri = lambda kind, i: F.concat(F.lit(f"<{DATA}"), kind, F.lit("/"), i.cast("string"), F.lit(">"))
    own = iri(F.col("type"), F.col("id"))
    prop = lambda n: F.lit(f"<{NAMESPACE}{n}>")
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    quoted = lambda c: F.regexp_extract(text(c), r'(?s)^\{"v":(.*)\}$', 1)
    number = lambda c, t: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{t}>'))
    rdf_type = F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")
    base = elements.withColumn("own", own).withColumn("at", F.concat(F.lit(DATA), F.col("type"), F.lit("/"), F.col("id").cast("string"), F.lit("/v"), F.col("version").cast("string")))
    base = base.withColumns({"road": _road(), "route": F.coalesce((F.col("type") == "relation") & (F.col("tags")["type"] == "route") & (F.col("tags")["route"] == "road"), F.lit(False))})
    row = lambda df, s, p, o: df.select(s.alias("s"), p.alias("p"), o.alias("o"))
    named = F.create_map(*(F.lit(x) for kv in KEY_PROPERTIES.items() for x in kv))
    tags = base.select("own", "at", F.posexplode(F.array_sort(F.map_entries("tags"))).alias("k", "t")).withColumn("tag", F.concat(F.lit("<"), F.col("at"), F.lit("/tag/"), F.col("k").cast("string"), F.lit(">")))
    nodes = base.filter("type = 'way'").select("own", "at", F.posexplode("nodes").alias("k", "ref")).withColumn("row", F.concat(F.lit("<"), F.col("at"), F.lit("/node/"), F.col("k").cast("string"), F.lit(">")))
    members = base.filter("type = 'relation'").select("own", "at", "route", F.posexplode("members").alias("k", "m")).withColumn("row", F.concat(F.lit("<"), F.col("at"), F.lit("/member/"), F.col("k").cast("string"), F.lit(">")))
    target = iri(F.col("m.type"), F.col("m.ref"))
    roads = base.filter("road").select(F.col("own").alias("target"))
    parts = members.filter(F.col("route") & F.col("m.role").isin(*ROAD_ROLES)).select("own", target.alias("target")).join(roads, "target", "left_semi")
    kind = F.create_map(*(F.lit(x) for x in ("node", f"<{NAMESPACE}Node>", "way", f"<{NAMESPACE}Way>", "relation", f"<{NAMESPACE}Relation>")))
    here = F.lit(f"<{DATA}snapshot/{snapshot}>")
    frames = [
        row(base, own, rdf_type, kind[F.col("type")]), row(base, own, prop("sourceSnapshot"), here),
        row(base, own, prop("osmId"), number(F.col("id"), "integer")), row(base, own, prop("version"), number(F.col("version"), "integer")),
        row(base.filter("type = 'node'"), own, prop("latitude"), number(F.col("lat").cast("decimal(12,9)"), "decimal")),
        row(base.filter("type = 'node'"), own, prop("longitude"), number(F.col("lon").cast("decimal(12,9)"), "decimal")),
        row(base.filter("road"), own, rdf_type, prop("RoadSegment")),
        row(tags.filter(named[F.col("t.key")].isNotNull()), F.col("own"), F.concat(F.lit(f"<{NAMESPACE}"), named[F.col("t.key")], F.lit(">")), quoted(F.col("t.value"))),
        row(tags, F.col("tag"), rdf_type, prop("Tag")), row(tags, F.col("tag"), prop("ownerElement"), F.col("own")),
        row(tags, F.col("tag"), prop("tagKey"), quoted(F.col("t.key"))), row(tags, F.col("tag"), prop("tagValue"), quoted(F.col("t.value"))),
        row(nodes, F.col("row"), rdf_type, prop("WayNode")), row(nodes, F.col("row"), prop("ownerWay"), F.col("own")),
        row(nodes, F.col("row"), prop("position"), number(F.col("k"), "integer")), row(nodes, F.col("row"), prop("memberNode"), iri(F.lit("node"), F.col("ref"))),
        row(members, F.col("row"), rdf_type, prop("RelationMembership")), row(members, F.col("row"), prop("ownerRelation"), F.col("own")),
        row(members, F.col("row"), prop("position"), number(F.col("k"), "integer")), row(members, F.col("row"), prop("memberElement"), target),
        row(members, F.col("row"), prop("role"), quoted(F.col("m.role"))),
    ]
    routes = row(parts, F.col("target"), prop("partOfRoad"), F.col("own"))
    return reduce(DataFrame.union, [*frames, routes.distinct()]) if once else reduce(DataFrame.union, [*frames, routes]).distinct()


PBF_AVAILABLE = False


def read_pbf(spark: SparkSession, path: str, decoder=None) -> DataFrame:
    """Elements of a PBF file through ``decoder(path)``, which yields element tuples; none is built in."""
    if decoder is None:
        raise DomainError("UNAVAILABLE", "no PBF decoder is configured")
    return validate(spark.createDataFrame(decoder(path), ELEMENT))


__all__ = ["ELEMENT", "affected_elements", "apply_changes", "project", "read_changes", "read_pbf", "read_snapshot", "references", "unresolved", "validate"]
