r"""Benchmark decontamination with BM25 and block-max WAND (operator 10).

The test items make an inverted index over word pairs. An item's weights are
its BM25 weights divided by its own full score, so a passage that holds the
whole item scores 1. Every training passage (``2 s`` words, a new one each ``s``
words) is a query; s is the length of the longest item of up to ``STRIDE`` words,
and longer items are looked for in passages of their own, a class of items for
each doubling of the length, so that every item fits into s. Block-max WAND retrieves all items from ``THRESHOLD`` on. A passage whose sum of
term maxima stays below it has no pivot and is passed over. Then the item's
question and answer must both overlap the passage: ``OVERLAP`` of the runs of
three words of each.

Words are runs of \w in lower case. A question ends at the first line break, else
before the last sentence; an item of one sentence is both question and answer.

The index is told to all tasks in blocks of at most ``BLOCK_ITEMS`` items or
``BLOCK_CHARS`` characters (or one item, if longer); a larger benchmark takes several
passes, one block at a time on the driver, and so does each class of long
items. Frequencies, mean and longest lengths are the whole benchmark's: Spark
counts them, and a block's index is told those of its own word pairs.

Cases: null and empty texts have no passage and items no match; repeated items
match each for itself; a null doc_id is carried; repeated rows give repeated
rows; an empty benchmark leaves all documents clean; long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
STRIDE = 512
POSTINGS = 64
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.?!]\s+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def parts(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    text = text.strip()
    if "\n" in text:
        question, _, answer = text.partition("\n")
    else:
        ends = list(_SENTENCE.finditer(text))
        question, answer = (text[: ends[-1].end()], text[ends[-1].end() :]) if ends else (text, text)
    return (question, answer) if words(question) and words(answer) else (text, text)


def runs(ws: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(ws))
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()


def pairs(ws: list[str]) -> Counter:
    """Word pairs; an item of one word pairs it with itself."""
    return Counter(zip(ws, ws[1:] or ws, strict=False))


def length_class(n: int) -> int:
    """0 up to ``STRIDE`` words, then one more for each doubling."""
    return (-(-n // STRIDE) - 1).bit_length() if n else 0


class Statistics:
    """What the weights and passages of all items depend on; ``held_in`` has the word pairs of the items in question."""

    def __init__(self, items: int, mean: float, longest: dict[int, int], held_in):
        self.items, self.mean, self.longest, self.held_in = items, mean, longest, held_in

    @classmethod
    def of(cls, texts: Iterable[str]) -> Statistics:
        held_in: Counter = Counter()
        longest: dict[int, int] = {}
        items = total = 0
        for text in texts:
            if ws := words(text):
                c = pairs(ws)
                items += 1
                total += sum(c.values())
                held_in.update(c.keys())
                k = length_class(len(ws))
                longest[k] = max(longest.get(k, 0), len(ws))
        return cls(items, total / max(1, items), longest, held_in)


class Index:
    """BM25 over word pairs, with postings in blocks. items: (id, text), of one class of lengths."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, known: Statistics | None = None):
        known = known or Statistics.of(text for _, text in items)
        self.threshold = threshold
        held = [(i, text, words(text)) for i, text in items]
        held = [x for x in held if x[2]]
        self.ids = [i for i, _, _ in held]
        self.asked = [tuple((n, runs(p, n)) for p in map(words, parts(text)) for n in [min(3, len(p))]) for _, text, _ in held]
        self.stride = max([32, *(known.longest[length_class(len(w))] for _, _, w in held)])
        self.vocabulary: dict[str, int] = {}
        for _, _, ws in held:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        size = max(1, len(self.vocabulary))
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, (_, _, ws) in enumerate(held):
            c = pairs(ws)
            length = sum(c.values())
            weight = {t: math.log(1 + (known.items - known.held_in[t] + 0.5) / (known.held_in[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / known.mean)) for t, tf in c.items()}
            full = sum(weight.values())
            for (a, b), w in weight.items():
                postings.setdefault(self.vocabulary[a] * size + self.vocabulary[b], []).append((k, w / full))
        self.size = size
        self.keys = np.array(sorted(postings), dtype=np.int64)
        #: per term: items, weights, and (last item, largest weight) of each block
        self.postings = [([i for i, _ in p], [w for _, w in p], [(p[min(at + POSTINGS, len(p)) - 1][0], max(w for _, w in p[at : at + POSTINGS])) for at in range(0, len(p), POSTINGS)]) for p in (postings[k] for k in self.keys.tolist())]
        self.most = np.array([max(w) for _, w, _ in self.postings])

    def wand(self, terms: list[int]) -> dict[int, float]:
        """All items whose score over the (distinct) terms reaches the threshold."""
        found: dict[int, float] = {}
        least = self.threshold - 1e-9
        lists = [[self.postings[t][0][0], t, 0] for t in terms]  # item, term, place
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the pivot item
            bound, upto = 0.0, None
            for x in lists[: pivot + 1]:
                blocks = self.postings[x[1]][2]
                b = x[2] // POSTINGS
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b][1]
                    upto = blocks[b][0] if upto is None else min(upto, blocks[b][0])
            if bound >= least:
                if lists[0][0] == item:
                    score = sum(self.postings[t][1][at] for i, t, at in lists[: pivot + 1])
                    if score >= least:
                        found[item] = score
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = (item if upto is None else upto) + 1
                if pivot + 1 < len(lists):
                    goal = max(item + 1, min(goal, lists[pivot + 1][0]))
            for x in lists[: pivot + 1]:
                items = self.postings[x[1]][0]
                at = x[2]
                while at < len(items) and items[at] < goal:
                    at += 1
                x[0], x[2] = (items[at], at) if at < len(items) else (-1, -1)
            lists = [x for x in lists if x[2] >= 0]
        return found

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, passage's first word) of a text, each item's best passage."""
        ws = words(text)
        if not ws or not len(self.keys):
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
        if len(ids) == 1:
            ids = np.append(ids, ids)
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.size + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = np.nonzero(self.keys[at] == pair)[0]
        if not len(hit):
            return []
        term = at[hit]
        bound = np.concatenate(([0.0], np.cumsum(self.most[term])))
        starts = np.arange(0, max(1, len(ws) - self.stride), self.stride)
        low, high = np.searchsorted(hit, starts), np.searchsorted(hit, starts + 2 * self.stride - 1)
        best: dict[int, tuple] = {}
        for k in np.nonzero(bound[high] - bound[low] >= self.threshold - 1e-6)[0].tolist():
            start = int(starts[k])
            passage = None
            for item, score in self.wand(sorted(set(term[low[k] : high[k]].tolist()))).items():
                if passage is None:
                    passage = ws[start : start + 2 * self.stride]
                    seen: dict[int, set] = {}
                overlaps = []
                for n, asked in self.asked[item]:
                    if n not in seen:
                        seen[n] = runs(passage, n) if len(passage) >= n else set()
                    overlaps.append(len(asked & seen[n]) / len(asked))
                if min(overlaps) >= OVERLAP and (item not in best or (score, -start) > (best[item][0], -best[item][3])):
                    best[item] = (score, *overlaps, start)
        return [(item, *best[item]) for item in sorted(best)]


_MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()), T.StructField("start", T.LongType())])


def _item_pairs(items: DataFrame) -> DataFrame:
    """(block, class, words, a, b): the distinct word pairs of each item; its first row alone has its words, the others 0."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for block, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                n = len(ws := words(text))
                rows += [(block, length_class(n), 0 if k else n, a, b) for k, (a, b) in enumerate(pairs(ws))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "class", "words", "a", "b"])

        return step

    return map_arrow(items.select("block", "text"), make, "block long, class long, words long, a string, b string", text=1)


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    """An index for each block and class of lengths, one after the other; at least one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    count = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    known = found = None
    if count > 1:
        found = materialize(_item_pairs(items), "item-pairs")
        held = found.filter("words > 0").groupBy("class").agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("words") - 1, F.lit(1))).alias("pairs"), F.max("words").alias("longest")).collect()  # few classes
        total = sum(r["n"] for r in held)
        known = Statistics(total, sum(r["pairs"] for r in held) / max(1, total), {r["class"]: r["longest"] for r in held}, None)
        held_in = materialize(found.groupBy("a", "b").agg(F.count("*").alias("n")), "held-in")
    made = False
    for k in range(count):
        block = [(r["item_id"], r["text"]) for r in (items if count == 1 else items.filter(F.col("block") == k)).orderBy("item_id", "text").collect()]
        if count == 1:
            known = Statistics.of(text for _, text in block)
        else:
            own = found.filter(F.col("block") == k).select("a", "b").distinct().join(held_in, ["a", "b"]).collect()
            known.held_in = {(r["a"], r["b"]): r["n"] for r in own}
        classes: dict[int, list[tuple[int | None, str]]] = {}
        for i, text in block:
            if ws := words(text):
                classes.setdefault(length_class(len(ws)), []).append((i, text))
        for c in sorted(classes):
            made = True
            yield Index(classes[c], threshold, known)
    if not made:
        yield Index([], threshold, known)


def contaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` (but ``matches``) and ``matches``: the items each text holds.

    A pass's rows are written before the next pass, so that one index is held at a time.
    """
    docs = docs.drop("matches")
    names = docs.columns
    text_at = names.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start", pa.int64())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(_MATCH))])

    def scan(docs: DataFrame, index: Index) -> DataFrame:
        def make():
            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                found = []
                for text in batch.column(text_at).to_pylist():
                    found.append([{"item_id": index.ids[i], "score": round(s, 6), "question_overlap": q, "answer_overlap": a, "start": at} for i, s, q, a, at in index.matches(text)])
                columns = list(batch.columns)
                if len(columns) > len(names):
                    found = [a + b for a, b in zip(columns.pop().to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*names, "matches"])

            return step

        return map_arrow(docs, make, schema, text=text_at)

    scanned = None
    for index in _indexes(benchmark, threshold):
        scanned = scan(docs if scanned is None else materialize(scanned, "passes"), index)
    return scanned


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item found in it."""
    found = contaminate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, threshold)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
