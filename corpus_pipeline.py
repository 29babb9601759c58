"""A corpus pipeline of five operators; each stage reads what the one before wrote.

Language ID drops documents it can't tell, near-duplicates keep the smallest
doc_id of each group, decontamination drops documents that hold a benchmark
item, sanitisation rewrites texts, packing ends with one row per piece. All but
the last return the columns of ``documents``.

Cases: an empty table gives no row; null and empty texts have no language and
go in the first stage, as do texts without a letter; where no row has a
language, none can be told and all documents stay; rows without a doc_id pass the
near-duplicate stage, rows that share one count as one document there; columns
beside those of ``documents`` pass through, however they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hornlake.llm import decontam, langid, neardup, packing, pii
from hornlake.llm.common import fresh, materialize, table
from hornlake.llm.queries import learned_languages


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with numbers for names, ``text`` apart, so that no column clashes with an operator's."""
    return docs.toDF(*("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)))


def named(found: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from ``found``, which has them numbered; ``new`` replaces some."""
    return found.select(*(new.get(c, F.col("text" if c == "text" else f"c{k}")).alias(c) for k, c in enumerate(docs.columns)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dictionaries = learned_languages(docs)
    if not dictionaries:
        return docs
    return named(langid.classify(numbered(docs), dictionaries).filter("not rejected"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text")
    at = fresh("row", docs)
    rows = docs.join(kept, "doc_id", "left_semi").withColumn(at, F.row_number().over(one)).filter(F.col(at) == 1)
    return rows.select(*docs.columns).union(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminate(numbered(docs), table(spark, sf_dir, "benchmark"))
    return named(found.filter(F.size("matches") == 0), docs)


def sanitisation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return named(pii.sanitize(numbered(docs)), docs, text=F.col("clean_text"), n_chars=F.length("clean_text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_sanitisation", sanitisation_stage),
    ("best_fit_packing", packing_stage),
]

#: Compression, tokenizers and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
