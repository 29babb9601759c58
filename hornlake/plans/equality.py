"""Equality: components of merged terms, representatives, congruence of witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialize
from .closure import literal_key


def rank(c: Column) -> Column:
    """Order for representatives: names, literals, blank nodes, witnesses; then shorter nesting, then text."""
    kind = F.when(c.startswith("<"), 0).when(c.startswith('"'), 1).when(c.startswith("sk:"), 3).otherwise(2)
    return F.struct(kind.alias("kind"), (F.size(F.split(c, "sk:")) - 1).alias("depth"), c.alias("term"))


def literal_edges(facts: DataFrame) -> DataFrame:
    """(u, v): literals of one value, each with the smallest."""
    terms = facts.select(F.explode(F.array("s", "o")).alias("term")).filter("term like '\"%'").distinct()
    keyed = terms.select("term", literal_key("term").alias("key")).filter("key is not null")
    low = keyed.groupBy("key").agg(F.min("term").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(low, "key").select(F.col("term").alias("u"), "v").filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, rep): alternating stars on the order of ``rank``, unless the edges are stars already."""
    low = lambda a, b: F.when(rank(F.col(a)) <= rank(F.col(b)), F.col(a)).otherwise(F.col(b))
    high = lambda a, b: F.when(rank(F.col(a)) <= rank(F.col(b)), F.col(b)).otherwise(F.col(a))
    now = materialize(edges.filter("u <> v").select(high("u", "v").alias("u"), low("u", "v").alias("v")).distinct(), "equal")
    stars = now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty() and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
    if stars:  # as made of shared keys: each node has one representative, which has none
        return now.select(F.col("u").alias("node"), F.col("v").alias("rep"))
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min(rank(F.col("v")))["term"].alias("m")).select("u", low("u", "m").alias("m"))
        large = both.filter(rank(F.col("v")) > rank(F.col("u"))).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min(rank(F.col("v")))["term"].alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = materialize(small.select(high("u", "v").alias("u"), low("u", "v").alias("v")).distinct(), "equal")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("rep"))  # as written
        state = new


def merge(edges: DataFrame, facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """The alias map of the edges, closed under congruence of witnesses, and literals that clash.

    Witnesses of one symbol whose arguments are merged are merged too.
    """
    aliases = components(edges)
    terms = facts.select(F.explode(F.array("s", "o")).alias("w")).filter("w like 'sk:%'").distinct()
    while True:
        symbol, arg = F.regexp_extract("w", r"(?s)^sk:([^(]*)\(", 1), F.regexp_extract("w", r"(?s)^sk:[^(]*\((.*)\)$", 1)
        made = terms.select("w", symbol.alias("f"), arg.alias("node")).join(aliases, "node", "left").select("w", "f", F.coalesce("rep", "node").alias("arg"))
        pairs = made.groupBy("f", "arg").agg(F.min("w").alias("v"), F.count("*").alias("n")).filter("n > 1").join(made, ["f", "arg"]).filter("w <> v").select(F.col("w").alias("u"), "v")
        known = aliases.select(F.col("node").alias("u"), F.col("rep").alias("v"))
        rep = lambda c, n: aliases.select(F.col("node").alias(c), F.col("rep").alias(n))
        open_ = pairs.join(rep("u", "ru"), "u", "left").join(rep("v", "rv"), "v", "left").filter(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
        if open_.isEmpty():
            break
        aliases = components(known.union(pairs))
    kinds = aliases.union(aliases.select("rep", "rep")).distinct().select("rep", F.col("node").alias("term")).filter("term like '\"%'")
    odd = kinds.withColumn("key", literal_key("term")).filter("key is not null").groupBy("rep").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").first()
    return aliases, [odd["a"], odd["b"]] if odd else []


def rewrite(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts with every term replaced by its representative."""
    for c in ("s", "o"):
        found = aliases.select(F.col("node").alias(c), F.col("rep").alias("__rep"))
        facts = facts.join(found, c, "left").withColumn(c, F.coalesce("__rep", c)).drop("__rep")
    return facts.select("p", "s", "o")
