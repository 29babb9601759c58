"""Canonical exact digests (operator 2), in DataFrame functions only.

A text's canonical form is its Unicode compatibility composition, case-folded,
composed again, with white space runs as one space and trimmed. Its
fingerprint is a wide xxhash: ``LANES`` 64-bit lanes with different seeds.
Equal fingerprints make a bucket; inside buckets the canonical bytes are
compared: grouping by hash and text (partially first, so that copies leave a
task as one row) tells how many texts a bucket has. Where there are several, all
but the text with the smallest digest (half a SHA-256) get theirs appended. So equal
canonical texts, and no others, have equal fingerprints. Edited texts, which
exist for comparison only, are told apart inside buckets by their digests.

An exact digest has no degrees: the likeness of two fingerprints is 1 or 0. A
document's hash and digest are taken once and go with it to its neighbour.

Cases: a null text counts as empty; rows with equal ids stand side by side in
text order; a null doc_id comes last in descending order; the only row is its
own next; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

LANES = 2
#: Documents of a bucket of consecutive ids, and the most buckets there can be (their heads, 20 bytes
#: each, are broadcast). Beyond ROWS * MOST documents buckets hold more rows, which Spark sorts on disk.
ROWS = 1024
MOST = 1 << 20
QUANTILES = 64


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC, white space folding (ICU and SQL functions)."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.btrim(F.regexp_replace(again, r"(?U)\s+", " "))


def wide_hash(canon: Column, lanes: int = LANES) -> Column:
    """``lanes`` xxhash64 lanes, eight bytes each; lane k hashes k before the text, which seeds it."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), canon)), 16, "0") for k in range(lanes))))


def digest(text: Column) -> Column:
    """The first half of the SHA-256: 16 bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def settle(hashed: DataFrame) -> DataFrame:
    """Buckets with several canonical texts: (hash, low), low the digest of the text that keeps the plain hash.

    hashed: hash, canon. Texts are compared byte by byte as grouping keys.
    """
    kinds = hashed.select("hash", "canon").distinct().groupBy("hash").agg(F.count("*").alias("kinds"), F.min(digest(F.col("canon"))).alias("low"))
    return kinds.filter("kinds > 1").select("hash", "low")


def _resolved(hash_: str, sha: str, low: str) -> Column:
    plain = F.lower(F.hex(hash_))
    return F.when(F.col(low).isNull() | (F.col(sha) == F.col(low)), plain).otherwise(F.concat(plain, F.lit("+"), F.lower(F.hex(sha))))


def fingerprints(docs: DataFrame, lanes: int = LANES) -> DataFrame:
    """All columns of ``docs`` but ``fingerprint``, and ``fingerprint``."""
    docs = docs.drop("fingerprint")
    canon = canonical(F.coalesce(F.col("text").cast("string"), F.lit("")))
    clashes = materialize(settle(docs.select(canon.alias("canon")).select(wide_hash(F.col("canon"), lanes).alias("hash"), "canon")), "clashes")
    hashed = docs.withColumn("__canon", canon).withColumn("__hash", wide_hash(F.col("__canon"), lanes))
    if clashes.isEmpty():
        return hashed.withColumn("fingerprint", F.lower(F.hex("__hash"))).drop("__canon", "__hash")
    known = clashes.select(F.col("hash").alias("__hash"), F.col("low").alias("__low"))
    hashed = hashed.withColumn("__sha", digest(F.col("__canon"))).drop("__canon").join(known, "__hash", "left")
    return hashed.withColumn("fingerprint", _resolved("__hash", "__sha", "__low")).drop("__hash", "__sha", "__low")


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, hash, sha and next_text, next_hash, next_sha: those next in descending order of ids; after the last comes the first.

    docs: doc_id, text, hash, sha. Rows are dealt into buckets of consecutive ids; the first rows of a bucket
    (at most ``MOST`` ids, which bounds the broadcast) also go to the bucket
    before it as ghosts, so that one shuffle and one sort settle all.
    """
    span = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES)]).alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    cuts = sorted(set((span["q"] or [0]) + [span["lo"] or 0]))
    parts = max(1, min(MOST, -(-span["n"] // ROWS)) // len(cuts) + 1)
    top = (span["hi"] or 0) + 1
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(cuts, [*cuts[1:], top], strict=True)]
    ids = F.col("doc_id")
    segment = F.size(F.filter(F.lit(cuts), lambda c: c <= ids)) - 1
    bucket = F.when(ids.isNull(), F.lit(-1)).otherwise(segment * parts + F.least(F.lit(parts - 1), F.floor((ids - F.lit(cuts)[segment]) / F.lit(widths)[segment]))).cast("int")
    dealt = docs.withColumn("bucket", bucket)
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("bucket")
    heads = heads.select("head", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("goes_to"), F.lead("bucket").over(order).isNull().alias("wraps"))
    # heads: one row a bucket; the ghost of a bucket's head goes to the bucket above, the top one's to the lowest
    ghosts = dealt.join(F.broadcast(heads), dealt["doc_id"].eqNullSafe(heads["head"])).select("doc_id", "text", "hash", "sha", F.col("goes_to").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("ghost"))
    rows = dealt.select("doc_id", "text", "hash", "sha", "bucket", F.lit(0).alias("ghost")).union(ghosts)
    line = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    after = [F.coalesce(F.lead(c).over(line), F.col(c)).alias(f"next_{c}") for c in ("text", "hash", "sha")]
    return rows.select("*", *after).filter("ghost = 0").drop("bucket", "ghost")


def edited_fingerprints(docs: DataFrame, lanes: int = LANES) -> DataFrame:
    """Fingerprints of all texts, of their edited texts and of the next documents.

    The edited text replaces the last floor(n/2) code points by the first as
    many (or all) of the next document.
    """
    docs = texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    canon = canonical(F.col("text"))
    docs = docs.withColumn("canon", canon).select("doc_id", "text", wide_hash(F.col("canon"), lanes).alias("hash"), digest(F.col("canon")).alias("sha"))
    rows = _with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "hash", "sha", F.unhex(F.sha2("edited", 256)).alias("edited_sha"), canonical(F.col("edited")).alias("e_canon"), ((F.col("hash") == F.col("next_hash")) & (F.col("sha") == F.col("next_sha"))).alias("near_next"))
    narrow = rows.select("doc_id", "n_chars", "edited_sha", "hash", "sha", wide_hash(F.col("e_canon"), lanes).alias("e_hash"), digest(F.col("e_canon")).alias("e_sha"), "near_next")
    narrow = narrow.withColumn("near_edited", (F.col("hash") == F.col("e_hash")) & (F.col("sha") == F.col("e_sha")))
    texts = texts.select(canon.alias("canon")).select(wide_hash(F.col("canon"), lanes).alias("hash"), "canon")
    every = narrow.select(F.explode(F.array(F.struct("hash", "sha"), F.struct(F.col("e_hash").alias("hash"), F.col("e_sha").alias("sha")))).alias("x")).groupBy("x.hash").agg(F.min("x.sha").alias("low"), F.max("x.sha").alias("high"))
    clashes = settle(texts).union(every.filter("low <> high").select("hash", "low")).groupBy("hash").agg(F.min("low").alias("low"))
    for p in ("", "e_"):
        narrow = narrow.join(clashes.select(F.col("hash").alias(f"{p}hash"), F.col("low").alias(f"{p}low")), f"{p}hash", "left").withColumn(f"{p}print", _resolved(f"{p}hash", f"{p}sha", f"{p}low"))
    sha = F.lower(F.hex("edited_sha")).alias("edited_sha256")
    return narrow.select("doc_id", "n_chars", sha, F.col("print").alias("fingerprint"), F.col("e_print").alias("edited_fingerprint"), F.col("near_edited").cast("double").alias("near_edited"), F.col("near_next").cast("double").alias("near_next"))
