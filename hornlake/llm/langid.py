"""Language identification by compression (operator 9).

One zstandard raw-content dictionary per language holds the words that most of a
bounded sample of labelled rows have (the ``SAMPLE_DOCS`` whole texts of each
language with the smallest hashes), the most frequent ones last, up to
``DICT_BYTES`` bytes. A text in lower case is encoded, in pieces of ``CHUNK`` bytes so
that its own content doesn't drown the dictionary, with every dictionary; the
smallest total wins. Where the second total lies within a margin of the first
(``MARGIN`` of it, or one byte), those of the encoder's ``FINER`` levels are added; a
text whose sums still lie as close is rejected.

Both bounds are chosen on labelled rows: more of the right answers would be lost
above, more texts in a language that wasn't learned would pass below.

Cases: a null text or one without a letter is ``und`` with score 0 and counts
as rejected; ties go to the language first in order; with no labelled row all
rows are ``und``; one language alone gets all texts; repeated rows give repeated
rows; very long texts are read whole; more than ``LANGS`` languages, whose
dictionaries would be too much to tell each task, are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import map_arrow

SAMPLE_DOCS = 400
LANGS = 1_000
DICT_BYTES = 112 * 1024
CHUNK = 2048
LEVEL = 9
FINER = (1, 3, 5, 6, 7, 8, 13, 16)
MARGIN = 0.02
_LETTER = re.compile(r"[^\W\d_]")


def _sample_words(sample: DataFrame) -> DataFrame:
    """(lang, word): the distinct words of each text in lower case. sample: lang, text."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            langs, words = [], []
            for lang, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                own = set(text.lower().split())
                langs += [lang] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

        return step

    return map_arrow(sample, make, "lang string, word string", text=1)


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries from ``doc_id``, ``text``, ``lang`` of the rows given; at most ``dict_bytes`` a language.

    Rows are ranked by a hash of id and text. Only about eight times as many as
    are wanted pass a threshold on it, set from the language's count, so that
    ranking one language never gathers more.
    """
    rows = labelled.filter("lang is not null and text is not null and lang <> 'und'")
    counts = rows.groupBy("lang").count().limit(LANGS + 1).collect()
    if len(counts) > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    if not counts:
        return {}
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 8 * sample_docs / r["count"]) * 2**32) for r in counts], "lang string, most double")
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = (
        rows.select("lang", F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**32)).alias("h"))
        .join(F.broadcast(shares), "lang")  # at most LANGS rows
        .filter("h < most")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= sample_docs)
        .select("lang", "text")
    )
    held = _sample_words(sample).groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("bytes", F.octet_length("word") + 1)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "bytes", "word")
    best = held.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= dict_bytes)
    words: dict[str, list[tuple]] = {r["lang"]: [] for r in counts}
    for r in best.select("lang", "upto", "word").collect():
        words[r["lang"]].append((r["upto"], r["word"]))
    return {lang: b" ".join(w.encode("utf-8", "replace") for _, w in sorted(own, reverse=True)).rjust(8) for lang, own in sorted(words.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, chunk: int = CHUNK):
        self.langs = sorted(dictionaries)
        self.dictionaries, self.level, self.chunk = dictionaries, level, chunk
        self.made: dict[int, list[zstandard.ZstdCompressor]] = {}

    def coders(self, level: int) -> list[zstandard.ZstdCompressor]:
        if level not in self.made:
            self.made[level] = []
            for lang in self.langs:
                raw = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=level)
                params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=False, write_content_size=False, write_dict_id=False)
                self.made[level].append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params))
        return self.made[level]

    def sizes(self, text: str, level: int) -> list[int]:
        data = text.encode("utf-8", "replace")
        pieces = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders(level)]

    def __call__(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        text, levels = text.lower(), 1
        sizes = self.sizes(text, self.level)
        best, second = sorted(sizes)[:2]
        if second - best < max(1, margin * best):  # other encoders of the same dictionaries tell sizes apart
            for level in FINER:
                sizes = [a + b for a, b in zip(sizes, self.sizes(text, level), strict=True)]
            levels += len(FINER)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], second / (best + second), second - best < max(levels, margin * best)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` but those it adds: lang_pred, score, rejected."""
    added = ("lang_pred", "score", "rejected")
    docs = docs.drop(*added)
    text_at = docs.columns.index("text")

    def make():
        judge = Classifier(dictionaries)
        names = [*docs_columns, *added]

        def step(batch: pa.RecordBatch):
            got = [judge(t, margin) for t in batch.column(text_at).to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

        return step

    docs_columns = list(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_arrow(docs, make, schema, text=text_at)
