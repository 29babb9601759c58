import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from hornlake.errors import DomainError
from hornlake.functions.spatial import geodesic
from hornlake.operators.graphs import affected, route_status, shortest_distances
from hornlake.operators.joins import candidates, overlap_join, radius_join, stabbing_join
from hornlake.operators.planar import Shape, contains, covers, distance, ingest, intersects, planar_distance
from hornlake.sources import osm, providers
from hornlake.streaming.windows import EVENT, WindowStore, entries, history, latest, refuse_late, stream_changes, window_rows
from hornlake.views import POLICY, Publication, accepted_dates, accepted_locations, certified, evidence


def test_geodesic_known_values():
    near = geodesic([0], [0], [0.0001], [0])[0]
    assert abs(near - 11.131949079327358) < 1e-8
    pairs = [((0, 0, 179.5, 0.5), 19936288.578965), ((0, -30, 179.8, 29.9), 19989832.827610), ((0, 90, 0, -90), 20003931.458625), ((0, 0, 180, 0), 20003931.458625)]
    for (a, b, c, d), metres in pairs:
        assert abs(geodesic([a], [b], [c], [d])[0] - metres) < 1e-5
    assert geodesic([5], [5], [5], [5])[0] == 0
    assert abs(geodesic([179.9], [10], [-179.9], [10])[0] - geodesic([0.1], [10], [-0.1], [10])[0]) < 1e-6


def test_geodesic_measures_equal_pairs_once(monkeypatch):
    from hornlake.functions import spatial

    sizes, along = [], spatial._along
    monkeypatch.setattr(spatial, "_along", lambda alpha1, *rest: sizes.append(len(alpha1)) or along(alpha1, *rest))
    found = geodesic([7.0] * 500 + [1.0, 3.0], [50.0] * 500 + [2.0, 4.0], [7.5] * 500 + [1.0, 3.0], [50.5] * 500 + [2.0, 4.5])
    assert max(sizes) <= 2 and len(sizes) < 40
    assert len(set(found[:500])) == 1 and found[500] == 0 and abs(found[501] - 55290.19056612) < 1e-5
    assert geodesic([5], [5], [5], [5])[0] == 0 and math.isnan(geodesic([float("nan")], [0], [1], [1])[0])
    # near the equator the azimuth of equal latitudes is hardly fixed, the distance is
    low, mid, high = (geodesic([0], [-0.0004078160060458913], [118.31826434436954], [-0.0004078160060458913 + d])[0] for d in (-1e-7, 0, 1e-7))
    assert abs(low - mid) < 1e-6 and abs(high - mid) < 1e-6


def test_radius_join_measures_places_once(spark, monkeypatch):
    from hornlake.operators import joins

    @F.pandas_udf("double")
    def once(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        if pd.DataFrame([lon1, lat1, lon2, lat2]).T.duplicated().any():
            raise ValueError("a pair of places is measured twice")
        return pd.Series(geodesic(lon1, lat1, lon2, lat2))

    monkeypatch.setattr(joins, "geodesic_metres", once)
    p = spark.createDataFrame([(i, i % 3 / 1000, 0.0) for i in range(30)] + [(99, None, 1.0)], "i long, lon double, lat double")
    q = spark.createDataFrame([(j, j % 2 / 1000, 0.0) for j in range(20)], "j long, lon2 double, lat2 double")
    got = sorted((r.i, r.j) for r in radius_join(p, q, 120.0, ("lon", "lat"), ("lon2", "lat2")).collect())
    assert got == sorted((i, j) for i in range(30) for j in range(20) if abs(i % 3 - j % 2) <= 1)


def test_radius_join_is_exhaustive(spark):
    rng = random.Random(1)
    spots = [(i, rng.choice([-180.0, 179.99, 0.0]) + rng.random() * 0.01, rng.choice([0.0, 89.99, -60.0]) + rng.random() * 0.005) for i in range(60)]
    p = spark.createDataFrame(spots, "i long, lon double, lat double")
    q = p.toDF("j", "lon2", "lat2")
    got = {(r.i, r.j) for r in radius_join(p, q, 400.0, ("lon", "lat"), ("lon2", "lat2")).collect()}
    a = np.array(spots)
    expected = {(i, j) for i in range(60) for j in range(60) if geodesic([a[i, 1]], [a[i, 2]], [a[j, 1]], [a[j, 2]])[0] <= 400.0}
    assert got == expected
    assert expected <= {(r.i, r.j) for r in candidates(p, q, 400.0, ("lon", "lat"), ("lon2", "lat2")).collect()}


def test_interval_joins(spark):
    rng = random.Random(2)
    spans = [(i, s := rng.randrange(100), s + rng.randrange(1, 30)) for i in range(40)]
    iv = spark.createDataFrame(spans, "i long, s long, e long")
    probes = spark.createDataFrame([(k,) for k in range(0, 130, 7)], "t long")
    got = {(r.i, r.t) for r in stabbing_join(iv, probes, "s", "e", "t", 10).collect()}
    assert got == {(i, t) for i, s, e in spans for t in range(0, 130, 7) if s <= t < e}
    other = iv.select(F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.lit(1).alias("k"))
    rows = overlap_join(iv.withColumn("k", F.lit(1)), other, ["k"], ("s", "e"), ("s2", "e2"), 10).select("i", "j").collect()
    pairs = [(a, b) for a, s, e in spans for b, u, v in spans if s < v and u < e]
    assert sorted(map(tuple, rows)) == sorted(pairs)


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b", 30.0), ("b", "c", 40.0), ("a", "c", 100.0)], "src string, dst string, metres double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    q = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "z"), ("b", "b")], "src string, dst string")
    got = {(r.src, r.dst): (r.status, r.metres) for r in route_status(edges, nodes, q).collect()}
    assert got == {("a", "c"): ("ok", 70.0), ("c", "a"): ("no_route", None), ("a", "z"): ("out_of_region", None), ("b", "b"): ("ok", 0.0)}
    with pytest.raises(DomainError):
        route_status(edges, nodes, q, "fastest")
    assert shortest_distances(edges, nodes.filter("id = 'a'")).count() == 3
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("e", "d")], "id string, needs string")
    assert {r.id for r in affected(deps, spark.createDataFrame([("a",)], "id string")).collect()} == {"a", "b", "c"}


def test_planar(spark):
    square, point = Shape("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0),(4 4, 6 4, 6 6, 4 6, 4 4))"), Shape("POINT(5 5)")
    edge, far = Shape("POINT(0 5)"), Shape("LINESTRING(13 4, 13 6)")
    assert not covers(square, point) and not intersects(square, point) and distance(square, point) == 1.0
    assert covers(square, edge) and not contains(square, edge) and contains(square, Shape("POINT(2 2)"))
    assert distance(square, far) == 3.0 and intersects(square, Shape("LINESTRING(-1 5, 5 5)"))
    assert contains(square, Shape("LINESTRING(0 1, 5 1)")) and not covers(square, Shape("LINESTRING(1 5, 9 5)"))
    df = spark.createDataFrame([(1, "POINT(0 0)", "POINT(3 4)")], "id long, wkt string, b string")
    assert df.select(planar_distance("wkt", "b")).first()[0] == 5.0
    assert ingest(df, "EPSG:25832").first().metres_per_unit == 1.0
    with pytest.raises(DomainError):
        ingest(df, "EPSG:4326")
    for bad in ("POINT EMPTY", "POINT(1 2 3)", "POLYGON((0 0, 1 1, 2 2, 3 3))"):
        with pytest.raises(ValueError):
            Shape(bad)


S = 1_000_000


def event(i, t, inside, revision=1):
    return {"event_id": i, "event_time": t * S, "value": float(inside), "revision": revision}


def test_window_corrections():
    w = WindowStore(10 * S, 30 * S)
    for i, t, inside in (("a", 0, 0), ("b", 5, 1), ("c", 10, 1)):
        w.upsert(event(i, t, inside))
    w.advance(12 * S, 12 * S)
    holds = lambda e: e["value"] > 0
    ids = lambda rows: [e["event_id"] for e in rows]
    assert ids(w.rows()) == ["b", "c"] and ids(w.entry_rows(holds)) == ["b"]
    change = w.upsert(event("late", 3, 1))
    assert set(change["added"]) == {"late"} and ids(w.entry_rows(holds)) == ["late"]
    w.advance(15 * S, 15 * S)
    assert ids(w.rows()) == ["b", "c"] and w.entry_rows(holds) == []
    w.advance(30 * S, 30 * S)
    assert w.rows() == []
    with pytest.raises(DomainError):
        w.advance(20 * S, 20 * S)
    w.advance(50 * S, 50 * S)
    with pytest.raises(DomainError):
        w.upsert(event("old", 10, 1))
    assert w.upsert(event("c2", 45, 1))["added"] and not w.upsert(event("c2", 45, 1))["added"]
    with pytest.raises(DomainError):
        w.upsert(event("c2", 46, 1))
    saved = w.checkpoint()
    assert WindowStore.restore(saved, 10 * S, 30 * S).state == w.state
    for damage in (saved[:-2], b"0" + saved[1:]):
        with pytest.raises(DomainError):
            WindowStore.restore(damage, 10 * S, 30 * S)
    with pytest.raises(DomainError):
        WindowStore.restore(saved, 11 * S, 30 * S)
    assert w.remove("c2", 2)["removed"] and not w.remove("c2", 3)["removed"]
    with pytest.raises(DomainError):
        w.remove("never", 1)
    v = WindowStore(10, 0)
    v.upsert(event("x", 0, 0), "s", 5)
    with pytest.raises(DomainError):
        v.upsert(event("y", 0, 0), "s", 7)
    assert v.upsert(event("x", 0, 0), "s", 5) == {"added": {}, "removed": {}}


def test_window_frames(spark):
    rows = [("a", 0, "k", 0.0, 1), ("b", 5, "k", 1.0, 1), ("c", 10, "k", 1.0, 1), ("b", 5, "k", 0.0, 2)]
    e = latest(spark.createDataFrame(rows, EVENT))
    assert {r.event_id for r in window_rows(e, 10, 10).collect()} == {"a", "b"}
    assert {r.event_id for r in history(e, 12, 5).collect()} == {"b", "c"}
    assert {r.event_id for r in entries(e, 12, 10, F.col("value") > 0).collect()} == {"c"}
    with pytest.raises(Exception, match="older than the watermark"):
        refuse_late(e, 100, 20).collect()
    assert refuse_late(e, 20, 20).count() == 3


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda *v: json.dumps(dict(zip(("event_id", "event_time", "key", "value", "revision"), v, strict=True)))
    (source / "1.json").write_text("\n".join([row("a", 0, "k", 0.0, 1), row("b", 5, "k", 1.0, 1)]))
    events = spark.readStream.schema(EVENT).json(str(source))
    out = str(tmp_path / "out")

    def run():
        writer = stream_changes(events, 10, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        assert writer.trigger(availableNow=True).start().awaitTermination(120)
        return {(r.op, r.event_id) for r in spark.read.parquet(out).collect()}

    assert run() == {("add", "a"), ("add", "b")}
    (source / "2.json").write_text("\n".join([row("c", 12, "k", 1.0, 1), row("z", 1, "k", 1.0, 1)]))
    assert run() >= {("add", "c"), ("remove", "a"), ("error", "z")}
    (source / "3.json").write_text(row("y", 2, "k", 1.0, 1))
    assert ("error", "y") in run()


OSM_XML = """<osm version="0.6"><node id="1" version="1" lat="0.0" lon="0.0"/><node id="2" version="1" lat="1.0" lon="1.0"><tag k="name" v="x &quot;y&quot;"/></node>
<way id="5" version="1"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way>
<relation id="9" version="1"><member type="way" ref="5" role="forward"/><tag k="type" v="route"/><tag k="route" v="road"/></relation></osm>"""
OSC_XML = """<osmChange version="0.6"><modify><node id="1" version="2" lat="0.5" lon="0.0"/></modify><create><node id="3" version="1" lat="2" lon="2"/></create></osmChange>"""


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM_XML)
    (tmp_path / "c.osc").write_text(OSC_XML)
    state = osm.read_snapshot(spark, str(tmp_path / "a.osm"))
    assert state.count() == 4 and osm.unresolved(state).isEmpty()
    triples = {tuple(r) for r in osm.project(state, "s1").collect()}
    way, route = "<https://example.org/osm/data/way/5>", "<https://example.org/osm/data/relation/9>"
    assert (way, "<https://example.org/osm#partOfRoad>", route) in triples and (way, "<https://example.org/osm#highway>", '"primary"') in triples
    assert any(o == '"x \\"y\\""' for _, _, o in triples)
    changes = osm.read_changes(spark, str(tmp_path / "c.osc"))
    new, gone = osm.apply_changes(state, changes)
    assert {(r.id, r.version) for r in new.filter("type = 'node'").collect()} == {(1, 2), (2, 1), (3, 1)} and gone.isEmpty()
    assert {(r.type, r.id) for r in osm.affected_elements(state, new, changes).collect()} == {("node", 1), ("way", 5), ("relation", 9), ("node", 3)}
    with pytest.raises(DomainError):
        osm.apply_changes(new, changes)
    with pytest.raises(DomainError):
        osm.apply_changes(state, changes.filter("action = 'modify'").withColumn("action", F.lit("delete")))
    with pytest.raises(DomainError):
        osm.read_pbf(spark, "x.pbf")


def test_providers(spark):
    fake = providers.FakeProvider({("len", "a"): 1.5}, {"near": [(1, 2)]})
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    out = providers.evaluate(rows, fake, "len", ["x"], T.DoubleType())
    assert sorted((r.x, r.result.status, r.result.value) for r in out.collect()) == [("a", "ok", 1.5), ("a", "ok", 1.5), ("b", "no_match", None)]
    with pytest.raises(Exception, match="UNAVAILABLE"):
        out.select(providers.value(F.col("result"))).collect()
    for v in (None, True, 3, 1.25, "t", (1, ("x", False))):
        assert providers.decode(providers.encode(v)) == v
    assert providers.checked({"status": "ok"}) == ("protocol_error", None)
    assert providers.dispatch(fake, "batch", {"operation": "len", "rows": [providers.encode(("a",))]})["replies"][0]["status"] == "ok"
    with pytest.raises(DomainError):
        providers.encode(math.nan)
    replies = {"Ok": {"code": "Ok", "routes": [{"distance": 12.0}], "waypoints": []}, "No": {"code": "NoRoute"}}
    p = providers.osrm_lengths("http://host", 50, (0, 0, 10, 10), lambda url: replies["Ok" if "1,1;2,2" in url else "No"])
    assert [r["status"] for r in p.batch("x", [(1, 1, 2, 2), (3, 3, 4, 4), (99, 0, 1, 1)])] == ["ok", "no_route", "out_of_region"]


def test_views(spark):
    dates = spark.createDataFrame([("p", "1700-01-01"), ("c", "1720-05-05"), ("d", "1721-01-01"), ("d", "1722-01-01"), ("e", "1720-13-01")], "person string, value string")
    children = spark.createDataFrame([("p", "c"), ("q", "d"), ("q", "f"), ("p", "c")], "parent string, child string")
    ok, notes = accepted_dates(dates, children)
    assert {r.id for r in ok.collect()} == {"p", "c"}
    assert {(r.id, r.code) for r in notes.collect()} == {("d", "conflicting_dates"), ("e", "invalid_date"), ("f", "missing_date"), ("q", "missing_date")}
    proof = {r.parent: r.digest for r in evidence(children, dates).collect()}
    certs = spark.createDataFrame([("p", "s", "1", proof["p"], "us", POLICY), ("q", "s", "1", "old", "us", POLICY)], "parent string, scope string, revision string, digest string, issuer string, policy string")
    good, notes = certified(children, dates, certs, "s", "1", ["us"])
    assert [r.parent for r in good.collect()] == ["p"] and ("q", "stale_certificate") in {(r.id, r.code) for r in notes.collect()}
    signs = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "sign string")
    located = spark.createDataFrame([("s1", "n1"), ("s2", "n1"), ("s2", "n2"), ("s4", "n3")], "sign string, node string")
    spots = spark.createDataFrame([("n1", 1.0, 1.0), ("n2", 1.0, 1.0), ("n3", 95.0, 0.0)], "node string, lat double, lon double")
    ok, notes = accepted_locations(signs, located, spots)
    assert [tuple(r) for r in ok.collect()] == [("s1", "n1")]
    assert {(r.id, r.code) for r in notes.collect()} == {("s2", "conflicting_locations"), ("s3", "missing_location"), ("s4", "invalid_location")}
    p = Publication()
    p.publish(lambda: {"a": signs})
    with pytest.raises(ZeroDivisionError):
        p.publish(lambda: {"a": 1 / 0})
    assert p.version == 1


def test_window_keys_gaps_and_sources():
    from hornlake.streaming.windows import WindowStore

    event = lambda k, t: {"event_id": str(k), "event_time": t, "value": 1.0, "revision": 1}
    strict, loose = WindowStore(10), WindowStore(10, gaps=True)
    for store in (strict, loose):
        store.upsert(event(1, 5), "a", 1)
        store.advance(10, 0)
    with pytest.raises(DomainError):
        strict.upsert(event(2, 6), "a", 3)
    assert loose.upsert(event(2, 6), "a", 3)["added"].keys() == {"2"}
    assert loose.remove("2", 2, "a", 4)["removed"].keys() == {"2"} and loose.remove("2", 2, "a", 4) == {"added": {}, "removed": {}}
    assert loose.forget_key()["removed"].keys() == {"1"} and not loose.rows() and loose.upsert(event(1, 5), "a", 1) == {"added": {}, "removed": {}}
    for k in range(WindowStore.LIMITS["sources"] - 1):
        loose.upsert(event(10 + k, 5), f"s{k}", 1)
    with pytest.raises(DomainError):
        loose.upsert(event(999, 5), "one more", 1)


def test_point_candidates_hold_all_pairs(spark):
    import math
    import random

    from hornlake.operators.planar import ingest, radius_pairs

    rng = random.Random(2)
    spots = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(150)]
    frame = spark.createDataFrame([(k, f"POINT({x} {y})") for k, x, y in spots], "id long, wkt string")
    for crs, unit in (("EPSG:25832", 1.0), ("EPSG:2263", 0.3048006096012192)):
        places = ingest(frame, crs)
        found = {(r.id_a, r.id_b) for r in radius_pairs(places, places, 4.0).collect()}
        assert found == {(a, b) for a, x, y in spots for b, u, v in spots if math.hypot(x - u, y - v) * unit <= 4.0}


def test_disjoint_intervals_meet_a_probe_once(spark):
    from hornlake.operators.joins import disjoint

    rng = random.Random(3)
    rows = [(rng.randrange(6), s, s + rng.randrange(-1, 9)) for s in (rng.randrange(60) for _ in range(80))]
    rows += rows[:10] + [(7, 0, 50), (7, 3, 5), (7, 40, 60), (7, 60, 61)]
    cut = disjoint(spark.createDataFrame(rows, "k long, s long, e long"), ["k"], "s", "e")
    found = [(r.k, r.at) for r in stabbing_join(cut, spark.range(-2, 70).toDF("at"), "s", "e", "at", 7).collect()]
    assert sorted(found) == sorted({(k, at) for k, s, e in rows for at in range(s, e)})


def test_stabbing_query_shuffles_no_pairs(spark, tmp_path):
    from hornlake.queries import QUERIES

    spark.sql("select id o_orderkey, id o_custkey, timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(id % 40 as int)) o_orderdate from range(50)").union(spark.sql("select 3L, 3L, timestamp_ntz'1995-01-09'")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select timestamp_ntz'1995-01-20' + make_interval(0, 0, 0, cast(id % 9 as int)) l_shipdate from range(30)").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["stabbing_join"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found)) and (3, "1995-01-28") in found


def test_projection_of_elements_known_once(spark):
    elements = spark.createDataFrame([("node", 1, 1, 1.0, 2.0, [], [], {"name": "a", "x": "b"}, "", ""), ("way", 2, 1, None, None, [1, 1], [], {"highway": "road"}, "", ""), ("relation", 3, 1, None, None, [], [("way", 2, ""), ("way", 2, "")], {"type": "route", "route": "road"}, "", "")], osm.ELEMENT)
    every, quick = osm.project(elements, "s"), osm.project(elements, "s", once=True)
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, every.collect()))
    assert "Aggregate" not in quick.filter("p like '%latitude>'")._jdf.queryExecution().optimizedPlan().toString()
