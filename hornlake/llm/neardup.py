"""MinHash near-duplicates with odd sketches (operator 7).

Documents are sets of distinct five-word shingles (64-bit hashes). Rows with
one set form a class, kept once. A class has ``BANDS`` x ``ROWS`` MinHash
samples; the samples are also folded into a parity bitmap, the odd sketch,
whose XOR population count estimates high similarities. Then:

1. Star: in each band bucket every class pairs with the bucket's smallest id.
   Pairs pass the sketch, then the exact test on full sets. Components follow.
2. Buckets that still hold several components are open; their classes need
   comparing among themselves. Two sets that meet the threshold share a shingle
   among the first quarter of each, in any common order of shingles. The order
   taken puts first what only one component holds, then what few classes hold,
   so text that a bucket's classes merely have in common comes last and brings
   no two together. Classes with a key shingle in common form a group, and each
   pairs with the smallest id of its group, as in step 1.
3. Groups that still hold several components are compared in blocks of
   ``BLOCK`` x ``BLOCK`` narrow rows: different components, sizes, places of the
   key and sketches must allow the threshold; what passes is tested exactly.

So a bucket of near copies costs one pair a member, shared boilerplate costs a
row a class, no group is listed as pairs and none is capped. A pair at the
threshold shares no bucket with a chance of (1 - 0.75^ROWS)^BANDS = 6e-6. Hot
classes, buckets and shingles only meet joins that Spark can split, and
aggregates with partial sums.

Cases: rows of one doc_id are one document; a null text or one without words
has an empty set, no link and itself as component; rows with a null doc_id
take no part (component null, kept true); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, materialize, mix64, run_hashes, words_in
from .components import components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Pairs whose estimate is lower than this aren't tested; more than five deviations below the threshold.
ESTIMATE = 0.5
BLOCK = 256

_SAMPLES = BANDS * ROWS
_A = mix64(np.arange(1, _SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, _SAMPLES + 1001, dtype=np.uint64))
_WORDS = SKETCH_BITS // 64


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text, its sorted distinct shingle hashes; fewer words than a shingle make one."""
    words = words_in(texts, lower=True)
    runs = run_hashes(words.hashes, SHINGLE)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        else:
            yield run_hashes(words.hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.empty(0, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The samples' minima, as 32-bit values."""
    low = np.full(_SAMPLES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        part = _A[:, None] * shingles[at : at + 512]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low >> np.uint64(32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band; a row a document."""
    rows = samples.reshape(-1, BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), rows.shape[:2])
    for k in range(ROWS):
        total = mix64(total ^ rows[:, :, k])
    return total


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (position, minimum) pairs, as 64-bit words; a row a document."""
    samples = samples.reshape(-1, _SAMPLES)
    bit = mix64(samples ^ (np.arange(1, _SAMPLES + 1, dtype=np.uint64) << np.uint64(33))) % np.uint64(SKETCH_BITS)
    own = np.arange(len(samples))[:, None] * SKETCH_BITS
    parity = np.bincount((own + bit.astype(np.int64)).ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.uint64)


def most_different(estimate: float = ESTIMATE) -> int:
    """The largest XOR population count whose estimate, 1 + n/4k ln(1 - 2x/n), is as high."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp((estimate - 1) * 4 * _SAMPLES / SKETCH_BITS)))


def _lists(table: np.ndarray) -> pa.Array:
    """The rows of a table of 64-bit words as lists of long."""
    at = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(table.ravel().view(np.int64)))


def _signatures(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, sketch array<long>"

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n, digests, samples = [], [], []
            for shingles in shingle_sets(batch.column(1)):
                n.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                samples.append(minhash(shingles))
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            table = np.stack(samples)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), _lists(band_keys(table)), _lists(odd_sketch(table))], ["doc_id", "n_shingles", "s1", "s2", "keys", "sketch"])

        return step

    return map_arrow(docs, make, schema, text=1)


def _sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of the rows given; shingles as sorted (unsigned order) 64-bit words."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

        return step

    return map_arrow(docs, make, "node long, shingles array<long>", text=1)


def _may_link(n_a: Column, n_b: Column, shared: Column) -> Column:
    """Whether sets of these sizes with at most ``shared`` in common can meet the threshold."""
    return (100 + PERCENT) * shared >= PERCENT * (n_a + n_b)


def _linked(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Of (node, hub) those that meet the threshold, as edges (u, v), by their full sets."""
    common = F.size(F.array_intersect("a", "b"))
    edges = (
        pairs.join(sets.select("node", F.col("shingles").alias("a")), "node")
        .join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("b")), "hub")
        .filter(100 * common >= PERCENT * (F.size("a") + F.size("b") - common))
        .select(F.col("node").alias("u"), F.col("hub").alias("v"))
    )
    return materialize(edges, name)


def _close(pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Of (node, hub) those whose sizes and sketches allow the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    differ = sum((F.bit_count(F.col("sketch_node")[k].bitwiseXOR(F.col("sketch_hub")[k])) for k in range(_WORDS)), F.lit(0))
    close = pairs.join(side("node"), "node").join(side("hub"), "hub").filter((differ <= most_different()) & _may_link(F.col("n_node"), F.col("n_hub"), F.least("n_node", "n_hub")))
    return materialize(close.select("node", "hub"), name)  # no distinct after it: that would keep Spark from splitting a hot hub


def _open_nodes(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the classes in buckets that hold several components."""
    labelled = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return labelled.join(several, "key").select("node", "label").distinct()


def _prefix_keys(members: DataFrame) -> DataFrame:
    """(shingle, node, label, n, rest): the key shingles of each class, and how many of its shingles stand from there on.

    members: node, label, n, shingles.
    """
    each = members.select("node", "label", "n", F.explode("shingles").alias("shingle"))
    bridges = each.groupBy("shingle").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("shingle", "f")
    bridges = materialize(bridges, "bridges")
    own = each.join(bridges, "shingle").groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("own"))
    alone = F.col("n") - F.size("own")
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    keys = own.filter(alone < prefix).select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), (prefix - alone).cast("int"))).alias("at", "own"))
    return keys.select("own.shingle", "node", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))


def _block_pairs(still: DataFrame) -> DataFrame:
    """(node, hub): pairs of one group that may meet the threshold, compared block by block.

    still: shingle, node, label, n, rest, sketch, members (of its group). Block pair (i, j) meets in a join of the rows
    of block i, sent there on the left, with those of block j, sent there on the right.
    """
    blocks = F.ceil(F.col("members") / BLOCK)
    still = still.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    upto = lambda a, b: F.explode(F.sequence(a, b))
    left = still.withColumn("i", F.col("block")).withColumn("j", upto(F.col("block"), F.col("blocks") - 1)).alias("a")
    right = still.withColumn("j", F.col("block")).withColumn("i", upto(F.lit(0).cast("long"), F.col("block"))).alias("b")
    met = left.join(right, ["shingle", "i", "j"])
    differ = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(_WORDS)), F.lit(0))
    once = (F.col("i") < F.col("j")) | (F.col("a.node") < F.col("b.node"))
    met = met.filter(once & (F.col("a.label") != F.col("b.label")) & _may_link(F.col("a.n"), F.col("b.n"), F.least("a.rest", "b.rest")) & (differ <= most_different()))
    return met.select(F.greatest("a.node", "b.node").alias("node"), F.least("a.node", "b.node").alias("hub")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(_signatures(docs), "signatures")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = materialize(classes, "classes")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return materialize(_sets(docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")), name)

    # 1. stars of band buckets
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    pairs = buckets.join(heads.select("key", "hub"), "key").filter("node <> hub").select("node", "hub").distinct()
    close = _close(pairs, nodes, "pairs")
    wanted = close.select(F.col("node").alias("id")).union(close.select(F.col("hub").alias("id"))).distinct()
    edges = _linked(close, sets_of(wanted, "sets"), "edges")
    labels = materialize(components(edges, "round1"), "labels")

    # 2. stars of key shingles, among the classes of open buckets; buckets of two are settled
    members = materialize(_open_nodes(buckets.join(heads.filter("members > 2").select("key"), "key"), labels), "open")
    if not members.isEmpty():
        sets = sets_of(members.select(F.col("node").alias("id")), "open-sets")
        keys = materialize(_prefix_keys(members.join(sets, "node").withColumn("n", F.size("shingles").cast("long"))), "prefix-keys")
        heads = keys.groupBy("shingle").agg(F.min(F.struct("node", "label", "n", "rest")).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        heads = materialize(heads, "open-heads")  # Spark splits a hot shingle only in a join of two plain inputs
        met = keys.join(heads.select("shingle", "h"), "shingle").filter((F.col("label") != F.col("h.label")) & _may_link(F.col("n"), F.col("h.n"), F.least("rest", "h.rest")))
        edges = edges.union(_linked(_close(met.select("node", F.col("h.node").alias("hub")).distinct(), nodes, "open-pairs"), sets, "open-edges"))
        labels = materialize(components(edges, "round2"), "labels")

        # 3. blocks of what is still apart
        keys = keys.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
        apart = keys.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
        apart = materialize(apart, "apart-groups")
        still = materialize(keys.join(apart, "shingle").join(nodes.select("node", "sketch"), "node").select("shingle", "node", "label", "n", "rest", "sketch", "members"), "apart")
        if not still.isEmpty():
            edges = edges.union(_linked(materialize(_block_pairs(still), "block-pairs"), sets, "block-edges"))
            labels = components(edges, "round3")

    by_class = nodes.join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("s1")).alias("s1"), "s2").join(by_class, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
