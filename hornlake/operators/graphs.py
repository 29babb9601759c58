"""Iterative graph operators: directed shortest distances and dependency closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..errors import DomainError
from ..storage import materialize

ROUNDS = 1000
#: Rounds between rewrites of all distances.
PARTS = 8


def shortest_distances(edges: DataFrame, sources: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(source, node, metres) for all nodes reached from ``sources`` (id); edges: src, dst, metres.

    Bellman-Ford by frontiers: only nodes whose distance fell in the last round go on.
    """
    lowest = lambda parts: reduce(DataFrame.union, parts).groupBy("source", "node").agg(F.min("metres").alias("metres"))
    frontier = materialize(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("metres")).distinct(), "distances")
    parts = [frontier]  # what each round found; the least of them is the best so far
    for _ in range(rounds):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node"), (frontier["metres"] + edges["metres"]).alias("metres"))
        known = lowest(parts).withColumnRenamed("metres", "__old")
        better = lowest([step]).join(known, ["source", "node"], "left").filter("__old is null or metres < __old").drop("__old")
        frontier = materialize(better, "frontier")
        if frontier.isEmpty():
            return lowest(parts)
        parts.append(frontier)
        if len(parts) > PARTS:
            parts = [materialize(lowest(parts), "distances")]
    raise DomainError("RESOURCE_LIMIT", f"more than {rounds} rounds")


def route_status(edges: DataFrame, nodes: DataFrame, queries: DataFrame, profile: str = "shortest") -> DataFrame:
    """src, dst, status, metres for queries (src, dst): ok, no_route or out_of_region. nodes: id, the covered ones."""
    if profile != "shortest":
        raise DomainError("DOMAIN_ERROR", f"unknown profile {profile}")
    if not edges.filter("metres is null or isnan(metres) or metres < 0").isEmpty():
        raise DomainError("DOMAIN_ERROR", "an edge's length can't be negative")
    covered = nodes.select("id").distinct()
    inside = queries.join(covered.select(F.col("id").alias("src")), "src", "left_semi").join(covered.select(F.col("id").alias("dst")), "dst", "left_semi")
    reached = shortest_distances(edges, inside.select(F.col("src").alias("id")).distinct())
    found = queries.join(reached.select(F.col("source").alias("src"), F.col("node").alias("dst"), "metres"), ["src", "dst"], "left")
    known = found.join(inside.select("src", "dst", F.lit(True).alias("__in")).distinct(), ["src", "dst"], "left")
    status = F.when(F.col("__in").isNull(), "out_of_region").when(F.col("metres").isNull(), "no_route").otherwise("ok")
    return known.select("src", "dst", status.alias("status"), F.when(F.col("__in"), F.col("metres")).alias("metres"))


def affected(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): everything that depends on ``changed`` (id), directly or not. dependencies: id, needs."""
    total = frontier = materialize(changed.select("id").distinct(), "affected")
    while True:
        step = dependencies.join(frontier.select(F.col("id").alias("needs")), "needs").select("id").distinct()
        frontier = materialize(step.join(total, "id", "left_anti"), "affected")
        if frontier.isEmpty():
            return total
        total = materialize(total.union(frontier), "affected")
