"""Substring removal over super-k-mers (operator 4).

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the
smallest hash of the ``MINI`` consecutive words inside it. Consecutive windows
with one minimiser form a super-k-mer. First its place alone is noted (narrow
rows); where a minimiser occurs in several documents, the super-k-mer travels
as one packed string to the minimiser's bucket. There the windows of the
distinct strings are sorted by hash, so that equal ones stand together, and
compared byte by byte: the smallest doc_id of each is exact.

A document other than the smallest one that holds a packed string loses it as
a whole, so a bucket only reports, per string, that smallest id and which of
its windows an even smaller document holds. Reports meet the places in a join
Spark can split. A string's id is its minimiser with a hash of its words (128
bits); two different strings with one id would be an error, not a loss.

Hot groups: a task sends a string again only for a smaller document or, once,
as a mark that it repeats, so copies don't pile up in a bucket. Minimisers under
which more than ``hot_strings`` different strings lie (such as those at the ends
of a passage that many documents share) are split: each of their windows
becomes a string of its own, dealt by its own hash, where again only those that
several documents hold travel. So a bucket has at most ``hot_strings`` strings
(some 60 MB) at any size of the table; which minimisers are hot is a table that
is joined. Splitting costs another shuffle of the texts and more bytes than packed
strings do, hence only beyond what a task can well hold.

Cases: null and empty texts and those shorter than a window lose nothing; rows
of one doc_id never remove from each other; rows with a null doc_id neither
lose nor remove; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, map_arrow, materialize, mix64, powers, run_hashes, slices, words_in

WINDOW = 50
MINI = 8
HOT_STRINGS = 20_000
#: Strings a task remembers having sent.
MEMO = 200_000
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 2**64)
_PLACES = "mini long, sid long, doc_id long, text_id long, start int, windows int"


def minimisers(words: np.ndarray, window: int = WINDOW, mini: int = MINI) -> np.ndarray:
    """The minimiser of every window, by doubling."""
    low = mix64(run_hashes(words, mini))
    span, want = 1, window - mini + 1
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = want - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def super_kmers(words: np.ndarray, window: int = WINDOW, mini: int = MINI) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, string id, first window, windows) of each run of windows with one minimiser."""
    low = minimisers(words, window, mini)
    first = np.nonzero(np.concatenate(([True], low[1:] != low[:-1])))[0]
    count = np.diff(np.append(first, len(low)))
    return low[first], _ids(words, first, count, window), first, count


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names)


def _ids(words: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the words of runs of ``count`` windows from ``first`` on."""
    n = len(words)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(_STEP, n), dtype=np.uint64)))
    return mix64((sums[first + count + window - 1] - sums[first]) * powers(_BACK, n)[first] + count.astype(np.uint64))


def _columns(parts: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], [c.split()[0] for c in schema.split(", ")])


def places_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where the super-k-mers of ``docs`` (doc_id, text_id, text) lie."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, found = words_in(batch.column(2)), []
            for k, (doc, text_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True)):
                own = words.hashes[words.first[k] : words.first[k + 1]]
                if doc is not None and len(own) >= window:
                    low, sid, first, count = super_kmers(own, window)
                    found.append((low.view(np.int64), sid.view(np.int64), np.full(len(low), doc), np.full(len(low), text_id), first.astype(np.int32), count.astype(np.int32)))
            yield from _columns(found, _PLACES)

        return step

    return map_arrow(docs, make, _PLACES, text=2)


def _single_windows(held: DataFrame, window: int) -> DataFrame:
    """The windows of the super-k-mers wanted as places of their own, with the window's hash for a minimiser.

    held: doc_id, text_id, text, wanted (start, windows).
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, found = words_in(batch.column(2)), []
            for k, (doc, text_id, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                own = words.hashes[words.first[k] : words.first[k + 1]]
                at = np.unique(np.concatenate([np.arange(w["start"], w["start"] + w["windows"]) for w in wanted]))
                one = np.ones(len(at), dtype=np.int32)
                found.append((run_hashes(own, window)[at].view(np.int64), _ids(own, at, one, window).view(np.int64), np.full(len(at), doc), np.full(len(at), text_id), at.astype(np.int32), one))
            yield from _columns(found, _PLACES)

        return step

    return map_arrow(held, make, _PLACES, text=2)


def _strings(held: DataFrame, window: int) -> DataFrame:
    """Packed strings of the super-k-mers wanted; what a task has sent already stays away.

    held: doc_id, text_id, text, wanted (mini, sid, start, windows).
    """

    def make():
        sent: dict[int, int] = {}  # a string's id -> twice the smallest document, and one if a mark has been sent

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, rows = words_in(batch.column(2)), []
            for k, (doc, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3)), strict=True)):
                base = int(words.first[k])
                for w in wanted:
                    mini, sid, at = w["mini"], w["sid"], base + w["start"]
                    name = (mini << 64) + sid
                    known, packed = sent.get(name), None
                    if known is None or doc < known >> 1:
                        if known is None and len(sent) >= MEMO:
                            sent.clear()
                        sent[name] = 2 * doc
                        packed = words.packed(at, at + w["windows"] + window - 1)
                    elif doc == known >> 1 or known & 1:
                        continue
                    else:
                        sent[name] = known | 1
                    rows.append((mini, sid, doc, packed))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)], ["mini", "sid", "doc_id", "packed"])

        return step

    return map_arrow(held, make, "mini long, sid long, doc_id long, packed binary", text=2)


def _joined(packed: list[bytes]) -> Words:
    """The words of all strings, hashed a slice at a time."""
    column = pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["packed"])
    parts = [words_in(p.column(0)) for p in slices(column, 0)]
    at = np.cumsum([0] + [len(p.data) for p in parts])
    n = np.cumsum([0] + [len(p.starts) for p in parts])
    whole = lambda name, add: np.concatenate([getattr(p, name) + k for p, k in zip(parts, add, strict=False)])
    first = np.concatenate([p.first[:-1] + k for p, k in zip(parts, n, strict=False)] + [n[-1:]])
    return Words(whole("data", np.zeros(len(parts), dtype=np.uint8)), whole("starts", at), whole("ends", at), whole("hashes", np.zeros(len(parts), dtype=np.uint64)), first)


def _repeats(packed: list[bytes], docs: list[int], window: int) -> list[list[int]]:
    """Per string, its windows that a string of a smaller document holds. docs: a smallest document for each string."""
    words = _joined(packed)
    count = np.maximum(0, np.diff(words.first) - window + 1)
    string = np.repeat(np.arange(len(packed)), count)
    own = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    at = words.first[string] + own  # a window's first word
    key, doc = run_hashes(words.hashes, window)[at], np.asarray(docs, dtype=np.int64)[string]
    order = np.lexsort((doc, key))
    start = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(order) else np.empty(0, dtype=bool)
    group = np.cumsum(start) - 1
    first = order[np.flatnonzero(start)]
    data = words.data.tobytes()
    text = lambda x: data[words.starts[at[x]] : words.ends[at[x] + window - 1]]
    found: list[list[int]] = [[] for _ in packed]
    clashing: set[int] = set()
    hits = np.flatnonzero(doc[order] > doc[first][group]).tolist() if len(order) else []
    for h in hits:
        x, g = int(order[h]), int(group[h])
        if text(x) != text(first[g]):
            clashing.add(g)
        elif g not in clashing:
            found[string[x]].append(int(own[x]))
    for g in clashing:  # different windows with one hash: told apart by their words
        members, low = order[group == g].tolist(), {}
        for x in members:  # in order of documents
            low.setdefault(text(x), doc[x])
        for x in members:
            place = int(own[x])
            hit, listed = doc[x] > low[text(x)], place in found[string[x]]
            if hit != listed:
                (found[string[x]].append if hit else found[string[x]].remove)(place)
    return found


def _count_bucket(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Reports of one bucket: (sid, smallest doc, window ranges [from, to) that smaller documents hold).

    rows: (sid, doc, packed or None). Strings that nobody else holds any part of aren't reported.
    """
    low: dict[int, int] = {}
    several: set[int] = set()
    text: dict[int, bytes] = {}
    for sid, doc, packed in rows:
        if low.setdefault(sid, doc) != doc:
            several.add(sid)
            low[sid] = min(low[sid], doc)
        if packed is not None and text.setdefault(sid, packed) != packed:
            raise ArithmeticError("two strings share one id")
    ranges: dict[int, list] = {}
    if len(set(low.values())) > 1:
        ranges = dict(zip(text, _repeats(list(text.values()), [low[s] for s in text], window), strict=True))
    for sid, own in low.items():
        hit = sorted(ranges.get(sid, ()))
        if sid in several or hit:
            joined: list[list[int]] = []
            for k in hit:
                if joined and joined[-1][1] == k:
                    joined[-1][1] = k + 1
                else:
                    joined.append([k, k + 1])
            yield sid, own, joined


def _buckets(strings: DataFrame, window: int) -> DataFrame:
    """Reports of all buckets: strings are dealt by minimiser and come sorted by it."""
    schema = "mini long, sid long, low long, ranges array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, mini, out = [], None, []

        def close():
            if len(bucket) > 1:
                out.extend((mini, *found) for found in _count_bucket(bucket, window))

        def flush():
            kinds = [pa.int64()] * 3 + [pa.list_(pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["mini", "sid", "low", "ranges"])

        for batch in batches:
            for m, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if m != mini:
                    close()
                    bucket, mini = [], m
                bucket.append(row)
            if len(out) > 4096:
                yield flush()
                out = []
        close()
        if out:
            yield flush()

    return strings.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, schema)


def _grouped(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text_id, text and the places ``wanted`` in it."""
    by_doc = places.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("mini", "sid", "start", "windows")).alias("wanted"))
    return docs.join(by_doc, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "wanted")


def _repeated(places: DataFrame) -> DataFrame:
    """(mini, n): minimisers that several documents have, and how often they occur."""
    seen = places.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    return seen.filter("lo <> hi").select("mini", "n")


def _wanted(docs: DataFrame, places: DataFrame, window: int, hot_strings: int) -> DataFrame:
    """The places whose strings travel: those of repeated minimisers; of hot ones the repeated single windows."""
    repeated = materialize(_repeated(places), "repeated")
    crowded = repeated.filter(F.col("n") > hot_strings).select("mini")
    if not crowded.isEmpty():
        kinds = places.join(crowded, "mini").groupBy("mini", "sid").agg(F.lit(1)).groupBy("mini").agg(F.count("*").alias("kinds"))
        hot = materialize(kinds.filter(F.col("kinds") > hot_strings).select("mini"), "hot")
        if not hot.isEmpty():
            single = materialize(_single_windows(_grouped(docs, places.join(hot, "mini", "left_semi")), window), "windows")
            cold = places.join(repeated.select("mini").join(hot, "mini", "left_anti"), "mini")
            return cold.unionByName(single.join(_repeated(single).select("mini"), "mini"))
    return places.join(repeated.select("mini"), "mini")


def removed_ranges(docs: DataFrame, window: int = WINDOW, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """(doc_id, text_id, ranges): word ranges [a, b) to remove, of every document that loses words.

    docs: doc_id, text_id, text.
    """
    wanted = materialize(_wanted(docs, materialize(places_of(docs, window), "places"), window, hot_strings), "wanted")
    reports = _buckets(_strings(_grouped(docs, wanted), window), window)
    met = wanted.join(reports, ["mini", "sid"])
    own = F.transform("ranges", lambda r: F.struct((F.col("start") + r[0]).alias("a"), (F.col("start") + r[1] + (window - 1)).alias("b")))
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + (window - 1)).alias("b")))
    spans = met.select("doc_id", "text_id", F.explode(F.when(F.col("doc_id") > F.col("low"), whole).otherwise(own)).alias("span"))
    return spans.groupBy("doc_id", "text_id").agg(F.collect_set("span").alias("ranges"))


def keep_unique(docs: DataFrame, window: int = WINDOW, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.col("text").cast("string").alias("text"))
    ranges = removed_ranges(docs, window, hot_strings)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, gone, kept = words_in(batch.column(1)), [], []
            n = np.diff(words.first)
            for k, spans in enumerate(batch.column(2).to_pylist()):
                base, own = int(words.first[k]), int(n[k])
                drop = np.zeros(own + 2, dtype=np.int64)
                drop[own] = 1
                for s in spans or ():
                    drop[s["a"]] += 1
                    drop[s["b"]] -= 1
                held = np.cumsum(drop[: own + 1]) == 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], held))))  # where runs of kept words start and end, by turns
                kept.append(b" ".join(words.packed(base + a, base + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
                gone.append(own - int(held.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

        return step

    joined = docs.join(ranges, ["doc_id", "text_id"], "left").select("doc_id", "text", "ranges")
    return map_arrow(joined, make, "doc_id long, n_words long, n_removed long, kept_text string", text=1)
