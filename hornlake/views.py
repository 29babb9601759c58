"""Scoped views: one accepted value per subject, with diagnostics, before rules run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

POLICY = "accepted-date-v1"


def select_one(rows: DataFrame, subjects: DataFrame, value: Column, valid: Column, names: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    """(accepted (id, value), diagnostics (id, code)): exactly one distinct valid value each.

    rows: id and what ``value`` and ``valid`` read; subjects: id. ``names``: codes for none, invalid, several.
    """
    seen = rows.select("id", value.alias("v"), F.coalesce(valid, F.lit(False)).alias("good"))
    per = seen.groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min(F.col("good").cast("int")).alias("all_good"))
    judged = subjects.select("id").distinct().join(per, "id", "left")
    none, invalid, several = names
    code = F.when(F.col("all_good").isNull(), none).when(F.col("all_good") == 0, invalid).when(F.col("low") != F.col("high"), several)
    judged = judged.withColumn("code", code)
    return judged.filter("code is null").select("id", F.col("low").alias("value")), judged.filter("code is not null").select("id", "code")


def accepted_dates(dates: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One valid date per person of ``dates`` (person, value as text) or ``children`` (parent, child)."""
    people = dates.select(F.col("person").alias("id")).union(children.select("parent")).union(children.select("child"))
    day = F.when(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(value as date)"))
    return select_one(dates.withColumnRenamed("person", "id"), people, day, day.isNotNull(), ("missing_date", "invalid_date", "conflicting_dates"))


def evidence(children: DataFrame, dates: DataFrame) -> DataFrame:
    """(parent, digest): SHA-256 over a parent's children and all their dates, in order."""
    members = children.select("parent", F.col("child").alias("person"), F.lit("child").alias("role")).union(children.select("parent", "parent", F.lit("parent")).distinct())
    rows = members.join(dates, "person", "left").select("parent", F.concat_ws("|", "role", "person", F.coalesce("value", F.lit(""))).alias("row"))
    return rows.groupBy("parent").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("row")), "\n"), 256).alias("digest"))


def certified(children: DataFrame, dates: DataFrame, certificates: DataFrame, scope: str, revision: str, trusted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(certified (parent), diagnostics (id, code)) from certificates (parent, scope, revision, digest, issuer, policy)."""
    accepted, _ = accepted_dates(dates, children)
    everyone = children.select("parent", F.col("child").alias("id")).union(children.select("parent", "parent"))
    gaps = everyone.join(accepted, "id", "left_anti").select("parent").distinct().withColumn("gap", F.lit(True))
    seen = children.select("parent").distinct().join(certificates, "parent").join(evidence(children, dates).withColumnRenamed("digest", "now"), "parent").join(gaps, "parent", "left")
    fresh = (F.col("scope") == scope) & (F.col("revision") == revision) & (F.col("policy") == POLICY) & (F.col("digest") == F.col("now"))
    code = F.when(~F.col("issuer").isin(*trusted), "untrusted_certificate").when(~fresh, "stale_certificate").when(F.col("gap"), "invalid_complete_scope")
    judged = seen.withColumn("code", code)
    good = judged.filter("code is null").select("parent").distinct()
    rest = children.select("parent").distinct().join(good, "parent", "left_anti").select(F.col("parent").alias("id"), F.lit("scope_not_certified_complete").alias("code"))
    return good, judged.filter("code is not null").select(F.col("parent").alias("id"), "code").union(rest).distinct()


def accepted_locations(signs: DataFrame, located: DataFrame, coordinates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted (sign, node), diagnostics): one node with one coordinate pair each.

    signs: sign; located: sign, node; coordinates: node, lat, lon.
    """
    places = located.groupBy("sign").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node"))
    pairs = coordinates.groupBy("node").agg(F.count_distinct("lat").alias("lats"), F.count_distinct("lon").alias("lons"), F.min((F.abs("lat") <= 90) & (F.abs("lon") <= 180)).alias("inside"))
    judged = signs.select("sign").distinct().join(places, "sign", "left").join(pairs, "node", "left")
    bad = ~F.coalesce((F.col("lats") == 1) & (F.col("lons") == 1) & F.col("inside"), F.lit(False))
    code = F.when(F.col("n").isNull(), "missing_location").when(F.col("n") > 1, "conflicting_locations").when(bad, "invalid_location")
    judged = judged.withColumn("code", code)
    return judged.filter("code is null").select("sign", "node"), judged.filter("code is not null").select(F.col("sign").alias("id"), "code")


class Publication:
    """A pointer to the current version of several tables: all swap together or none does."""

    def __init__(self):
        self.version, self.tables = 0, {}

    def publish(self, build) -> int:
        """``build()`` gives the new tables by name; a failure leaves the old ones."""
        tables = dict(build())
        for df in tables.values():
            df.schema  # fails here rather than after the swap  # noqa: B018
        self.version, self.tables = self.version + 1, tables
        return self.version
