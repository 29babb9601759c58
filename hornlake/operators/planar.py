"""Planar geometry: WKT points, lines and polygons in metres of a projected CRS."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import DomainError
from ..functions.registry import INTEGERS, URN, Operation, Result, Typed, fail, type_error

#: Metres a unit of known projected systems, fixed values.
CRS = {"EPSG:3857": 1.0, "EPSG:25832": 1.0, "EPSG:25833": 1.0, "EPSG:32632": 1.0, "EPSG:32633": 1.0, "EPSG:2263": 0.3048006096012192}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


class Shape:
    """Points, segments and rings of one geometry."""

    def __init__(self, wkt: str):
        m = re.fullmatch(r"\s*(POINT|LINESTRING|POLYGON)\s*\((.*)\)\s*", wkt, re.S | re.I)
        if not m:
            raise ValueError(f"unsupported geometry {wkt[:40]!r}")
        self.kind = m[1].upper()
        rings = re.findall(r"\(([^()]*)\)", m[2]) if self.kind == "POLYGON" else [m[2]]
        self.rings = []
        for ring in rings:
            points = []
            for part in ring.split(","):
                xy = re.fullmatch(rf"\s*({_NUMBER})\s+({_NUMBER})\s*", part)
                if not xy:
                    raise ValueError("a geometry needs two-dimensional coordinates")
                points.append((float(xy[1]), float(xy[2])))
            if not all(math.isfinite(v) for p in points for v in p):
                raise ValueError("coordinates must be finite")
            self.rings.append(points)
        if not self.rings or not all(self.rings):
            raise ValueError("an empty geometry")
        if self.kind == "POLYGON" and not all(len(r) >= 4 and r[0] == r[-1] for r in self.rings):
            raise ValueError("a ring must close")
        if self.kind == "LINESTRING" and len(self.rings[0]) < 2:
            raise ValueError("a line needs two points")
        self.segments = [(a, b) for r in self.rings for a, b in zip(r, r[1:], strict=False)] or [(self.rings[0][0],) * 2]

    def side(self, p) -> int:
        """1 inside, 0 on the boundary, -1 outside (lines and points have boundary only)."""
        if any(_point_segment(p, *s) == 0.0 for s in self.segments):
            return 0
        if self.kind != "POLYGON":
            return -1
        inside = False
        for (x1, y1), (x2, y2) in self.segments:
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                inside = not inside
        return 1 if inside else -1


def _point_segment(p, a, b) -> float:
    (px, py), (ax, ay), (bx, by) = p, a, b
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = 0.0 if length == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / length))
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def _cross(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _segments_meet(s, t) -> bool:
    (a, b), (c, d) = s, t
    if min(_point_segment(a, c, d), _point_segment(b, c, d), _point_segment(c, a, b), _point_segment(d, a, b)) == 0.0:
        return True
    return _cross(a, b, c) * _cross(a, b, d) < 0 and _cross(c, d, a) * _cross(c, d, b) < 0


def intersects(a: Shape, b: Shape) -> bool:
    return a.side(b.rings[0][0]) >= 0 or b.side(a.rings[0][0]) >= 0 or any(_segments_meet(s, t) for s in a.segments for t in b.segments)


def distance(a: Shape, b: Shape) -> float:
    if intersects(a, b):
        return 0.0
    return min(min(_point_segment(s[0], *t), _point_segment(s[1], *t), _point_segment(t[0], *s), _point_segment(t[1], *s)) for s in a.segments for t in b.segments)


def _pieces(s, other: Shape):
    """Midpoints and ends of a segment cut at the other's boundary."""
    (ax, ay), (bx, by) = s
    cuts = {0.0, 1.0}
    for c, d in other.segments:
        den = (bx - ax) * (d[1] - c[1]) - (by - ay) * (d[0] - c[0])
        if den:
            u = ((c[0] - ax) * (d[1] - c[1]) - (c[1] - ay) * (d[0] - c[0])) / den
            if 0 < u < 1:
                cuts.add(u)
    order = sorted(cuts)
    for t in [*order, *((x + y) / 2 for x, y in zip(order, order[1:], strict=False))]:
        yield (ax + t * (bx - ax), ay + t * (by - ay))


def covers(a: Shape, b: Shape) -> bool:
    """Every point of ``b`` lies in ``a`` or on its boundary."""
    if not all(a.side(p) >= 0 for s in b.segments for p in _pieces(s, a)):
        return False
    return not (b.kind == "POLYGON" and len(a.rings) > 1 and any(b.side(r[0]) > 0 for r in a.rings[1:]))


def contains(a: Shape, b: Shape) -> bool:
    """``a`` covers ``b`` and some point of ``b`` lies inside."""
    return covers(a, b) and (b.kind == "POLYGON" or any(a.side(p) > 0 for s in b.segments for p in _pieces(s, a)))


def _op(name: str, f, kind: T.DataType):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        shapes: dict[str, Shape] = {}
        get = lambda w: shapes.get(w) or shapes.setdefault(w, Shape(w))
        return pd.Series([f(get(x), get(y)) for x, y in zip(a, b, strict=True)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    run.__name__ = name
    return F.pandas_udf(run, kind)


planar_distance = _op("planar_distance", distance, T.DoubleType())
planar_contains = _op("planar_contains", contains, T.BooleanType())
planar_covers = _op("planar_covers", covers, T.BooleanType())
planar_intersects = _op("planar_intersects", intersects, T.BooleanType())


def planar_within(a: Column, b: Column, radius: Column) -> Column:
    return planar_distance(a, b) <= radius


def point_candidates(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """(id_a, wkt_a, id_b, wkt_b, unit): pairs of ingested points that may lie within ``metres``, a superset of those that do.

    Both sides come from one ``ingest``. Cells of the radius meet their neighbours in a join on
    the cell, so no side is broadcast and no pair of distant points arises. Geometries that are no points are left out.
    """
    if not (math.isfinite(metres) and metres > 0):
        raise ValueError("a radius must be finite and positive")
    at = lambda k: F.regexp_extract("wkt", r"^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", k).try_cast("double") * F.col("metres_per_unit")
    cells = lambda df: df.select("*", F.floor(at(1) / metres).alias("i"), F.floor(at(2) / metres).alias("j")).filter("i is not null and j is not null")
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    left = cells(a).select(F.col("id").alias("id_a"), F.col("wkt").alias("wkt_a"), F.col("metres_per_unit").alias("unit"), "i", "j")
    right = cells(b).withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
    right = right.select(F.col("id").alias("id_b"), F.col("wkt").alias("wkt_b"), (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    return left.join(right, ["i", "j"]).drop("i", "j")


def radius_pairs(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """(id_a, id_b, metres): pairs of points within ``metres``, boundary included; distances are scaled by the system's unit."""
    met = point_candidates(a, b, metres).withColumn("metres", planar_distance("wkt_a", "wkt_b") * F.col("unit"))
    return met.filter(F.col("metres") <= metres).select("id_a", "id_b", "metres")


def _wrong(wkt: pd.Series) -> pd.Series:
    """Why a text is no geometry of the subset; null if it is one."""

    def one(w):
        try:
            Shape(w)
        except (ValueError, TypeError) as e:
            return str(e)
        return None

    return wkt.map(one)


_wrong.__annotations__ = {"wkt": pd.Series, "return": pd.Series}
wrong_geometry = F.pandas_udf(_wrong, T.StringType())


def _is_geometry(x: Typed) -> bool:
    return isinstance(x.type, T.StructType) and x.type.fieldNames() == ["wkt", "crs"]


def _geometry(wkt: Typed, crs: Typed) -> Result:
    """A geometry of a known projected system, for the operations below."""
    if not all(isinstance(x.type, T.StringType) for x in (wkt, crs)):
        return type_error("spatial:geometry")
    unknown = F.when(~crs.col.isin(*CRS), F.concat(crs.col, F.lit(" is no known projected system")))
    why = F.coalesce(unknown, wrong_geometry(wkt.col))
    return Result(F.struct(wkt.col.alias("wkt"), crs.col.alias("crs")), F.concat(F.lit("DOMAIN_ERROR: "), why))


def _planar(name: str, value):
    """An operation on two geometries of one system; ``value`` takes their columns, the metres of a unit and what follows."""

    def build(a: Typed, b: Typed, *more: Typed) -> Result:
        numbers = (*INTEGERS, T.DecimalType, T.DoubleType)
        if not (_is_geometry(a) and _is_geometry(b) and all(isinstance(x.type, numbers) for x in more)):
            return type_error(f"spatial:{name}")
        unit = F.create_map(*(F.lit(x) for pair in CRS.items() for x in pair))[a.col["crs"]]
        extra = [x.col.cast("double") for x in more]
        bad = a.col["crs"] != b.col["crs"]
        for x in extra:
            bad = bad | F.isnan(x) | (x < 0)
        return Result(value(a.col["wkt"], b.col["wkt"], unit, *extra), fail(bad, "DOMAIN_ERROR", "geometries need one system, a radius mustn't be negative"))

    return build


OPERATIONS = [
    Operation(f"{URN}spatial:geometry", 2, _geometry),
    Operation(f"{URN}spatial:planarDistance", 2, _planar("planarDistance", lambda a, b, unit: planar_distance(a, b) * unit)),
    Operation(f"{URN}spatial:planarDwithin", 3, _planar("planarDwithin", lambda a, b, unit, r: planar_distance(a, b) * unit <= r), boolean=True),
    Operation(f"{URN}spatial:contains", 2, _planar("contains", lambda a, b, unit: planar_contains(a, b)), boolean=True),
    Operation(f"{URN}spatial:covers", 2, _planar("covers", lambda a, b, unit: planar_covers(a, b)), boolean=True),
    Operation(f"{URN}spatial:intersects", 2, _planar("intersects", lambda a, b, unit: planar_intersects(a, b)), boolean=True),
]


def ingest(geometries: DataFrame, crs: str) -> DataFrame:
    """(id, wkt, metres_per_unit); refuses geographic or unknown systems, and geometries outside the subset."""
    if crs not in CRS:
        raise DomainError("DOMAIN_ERROR", f"{crs} is no known projected system")

    rows = geometries.select("id", "wkt").withColumn("__wrong", wrong_geometry("wkt"))
    raised = F.raise_error(F.concat(F.lit("@@DOMAIN_ERROR: "), F.col("__wrong"), F.lit("@@"))).isNull()
    return rows.filter(F.when(F.col("__wrong").isNotNull(), raised).otherwise(True)).select("id", "wkt", F.lit(CRS[crs]).alias("metres_per_unit"))
