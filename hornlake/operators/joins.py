"""Range joins as equi-joins on cells, refined by the exact condition.

Neither compares all pairs: an interval is listed in the time buckets it meets,
a point in its grid cell, and a probe looks into the cells that can hold a match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spatial import geodesic_metres

EARTH = 6_356_752.0  # metres, the smallest radius: cells never come out too small


def _micros(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.unix_date(name).cast("long") * 86_400_000_000
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name).cast("long")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt over all shuffle partitions, which adaptive execution joins to a few if a table is small, however many rows a join makes of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stabbing_join(intervals: DataFrame, probes: DataFrame, start: str, end: str, at: str, width: int) -> DataFrame:
    """Interval rows with the probes in [start, end); column names must differ. ``width``: bucket microseconds.

    An interval is repeated once a bucket, so ``width`` should be near the usual length.
    """
    first, last = F.floor(_micros(intervals, start) / width), F.floor((_micros(intervals, end) - 1) / width)
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(first, last)))
    dealt = probes.withColumn("__bucket", F.floor(_micros(probes, at) / width))
    return spread.join(dealt, "__bucket").filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__bucket")


def disjoint(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """All that each key's [start, end) cover, as intervals that don't overlap, so that no probe is in two of a key."""
    from pyspark.sql import Window

    earlier = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    some = intervals.filter(F.col(start) < F.col(end))
    return some.withColumn(start, F.greatest(F.col(start), F.max(end).over(earlier))).filter(F.col(start) < F.col(end))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of overlapping intervals with equal ``keys``, each once: it is made in the bucket where the later one starts."""
    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        lo, hi = F.floor(_micros(df, s) / width), F.floor((_micros(df, e) - 1) / width)
        return df.filter(F.col(s) < F.col(e)).withColumn("__bucket", F.explode(F.sequence(lo, hi)))

    x, y = spread(left, *a), spread(right, *b)
    met = x.join(y, [*keys, "__bucket"]).filter((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    later = F.greatest(F.floor(_micros(met, a[0]) / width), F.floor(_micros(met, b[0]) / width))
    return met.filter(F.col("__bucket") == later).drop("__bucket")


def predecessor(events: DataFrame, key: str, time: str, identity: str) -> DataFrame:
    """As-of join of each event with the one before it of the same key, by (time, id): adds ``previous``."""
    from pyspark.sql import Window

    return events.withColumn("previous", F.lag(identity).over(Window.partitionBy(key).orderBy(time, identity)))


def ecef(df: DataFrame, lon: str, lat: str, prefix: str = "") -> DataFrame:
    """Adds earth-centred x, y, z of points on the ellipsoid."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    return df.withColumns({f"{prefix}x": n * F.cos(phi) * F.cos(lam), f"{prefix}y": n * F.cos(phi) * F.sin(lam), f"{prefix}z": n * (1 - e2) * F.sin(phi)})


def candidates(points: DataFrame, probes: DataFrame, radius: float, point: tuple[str, str], probe: tuple[str, str]) -> DataFrame:
    """Pairs whose straight-line box admits a distance of ``radius`` metres or less; a superset of the true pairs.

    A chord is never longer than the arc, so cells of edge ``radius`` in earth-centred
    space hold all partners within one cell of the probe's. Holds across the
    antimeridian and at the poles.
    """
    if not (math.isfinite(radius) and radius >= 0):
        raise ValueError("a radius must be finite and not negative")
    edge = max(radius, 1.0)
    p, q = ecef(points, *point, "__p"), ecef(probes, *probe, "__q")
    cell = lambda v: F.floor(F.col(v) / edge).cast("long")
    p = p.withColumns({f"__c{k}": cell(f"__p{k}") for k in "xyz"})
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    for k in "xyz":
        q = q.withColumn(f"__d{k}", F.explode(around)).withColumn(f"__c{k}", cell(f"__q{k}") + F.col(f"__d{k}")).drop(f"__d{k}")
    cells = [f"__c{k}" for k in "xyz"]
    met = spread(p, *cells).join(q, cells)  # small tables make many pairs
    slack = radius * (1 + 1e-9) + 1e-6
    for k in "xyz":
        met = met.filter(F.abs(F.col(f"__p{k}") - F.col(f"__q{k}")) <= slack)
    return met.drop(*(f"__{h}{k}" for h in "pqc" for k in "xyz"))


def radius_join(points: DataFrame, probes: DataFrame, radius: float, point: tuple[str, str], probe: tuple[str, str]) -> DataFrame:
    """Pairs within ``radius`` metres (inclusive) along the ellipsoid, with ``metres``, measured once for each pair of different places."""
    met = candidates(points.select(*point).distinct(), probes.select(*probe).distinct(), radius, point, probe)
    met = met.withColumn("metres", geodesic_metres(*(F.col(c) for c in (*point, *probe)))).filter(F.col("metres") <= radius)
    found = spread(points, *point).join(probes.join(met, list(probe)), list(point))
    return found.select(*points.columns, *probes.columns, "metres")
