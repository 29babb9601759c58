"""Best-fit packing with swap-based local search (operator 6).

Every document becomes the ids of its text plus an end id. Only documents
longer than a sequence are cut: the first piece takes the remainder, all later
ones are full. Pieces are packed per input partition: best-fit decreasing
makes the start, then a local search moves a piece into a fuller bin or
swaps one or two for a shorter one there. Each step raises the sum of squared
fills, so the search ends, which it does only when no such step is left between
any two underfull bins; a bin whose pieces all leave is gone. The bins of all
partitions that are still underfull are then packed again together, in groups
of about ``GROUP`` pieces.

A task holds lengths and places of its own pieces only (about 60 bytes each),
never ids or texts of more than one batch. The first packing is written to the
shared folder, so that a lost executor never mixes two of them; only the pieces
of underfull bins are shuffled, without ids or texts.

Cases: a null text counts as empty (one piece: the end id); repeated rows are
packed as often as they occur; null ids stay null; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import limit_batches, materialize, release, slices

SEQUENCE = 1024
END_ID = 2
#: Pieces of underfull bins that one task packs again, about.
GROUP = 50_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Encoder:
    """Byte-level BPE ids. The rank file and the tokenizer file hold the same
    vocabulary; texts that contain a special token's string go through the
    tokenizer file, which gives such strings their own id."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    @classmethod
    def get(cls, name: str) -> "Encoder":
        return cls._made.get(name) or cls._made.setdefault(name, cls(name))

    def __call__(self, text: str) -> np.ndarray:
        if "<|endoftext|>" not in text:
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(n: int, size: int = SEQUENCE) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` ids."""
    at = 0
    step = n % size or size
    while at < n:
        yield at, step
        at, step = at + step, size


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # sorted rooms that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, size
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        left = room - need
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges into fuller bins, until none is left between any two underfull ones.

    Candidates are looked up by length and room, of which there are at most
    ``size`` each, so a look at one bin costs the same however many others there are.
    """
    size_of = lengths.tolist()
    fill = [sum(size_of[i] for i in b) for b in bins]
    under = [b for b in range(len(bins)) if 0 < fill[b] < size]
    held = np.zeros((size + 1, size + 1), dtype=np.int32)  # bins that hold a length, by their room
    lengths_held = np.zeros(size + 1, dtype=np.int64)
    rooms = np.zeros(size + 1, dtype=np.int64)
    who: dict[tuple[int, int], dict[int, None]] = {}  # bins of a length and a room; length 0 stands for any

    def note(b: int, way: int) -> None:
        room = size - fill[b]
        if not 0 < room < size:
            return
        own = {size_of[i] for i in bins[b]}
        for n in own:
            held[n, room] += way
            lengths_held[n] += way
        rooms[room] += way
        for n in (0, *own):
            if way > 0:
                who.setdefault((n, room), {})[b] = None
            else:
                del who[n, room][b]

    def put(i: int, a: int, b: int) -> None:
        bins[a].remove(i)
        bins[b].append(i)
        fill[a] -= size_of[i]
        fill[b] += size_of[i]

    def shrink(low: int) -> bool:
        """One improving move or exchange that takes length out of bin ``low``, which is not among the noted ones."""
        gap = size - fill[low]
        by_length: dict[int, list[int]] = {}
        for i in bins[low]:
            by_length.setdefault(size_of[i], []).append(i)
        own = sorted(by_length, reverse=True)
        for n in own:
            fits = np.flatnonzero(rooms[n:])
            if len(fits) and n + fits[0] < gap + n:  # squared fill rises
                b = next(iter(who[0, n + int(fits[0])]))
                note(b, -1)
                put(by_length[n][0], low, b)
                note(b, 1)
                return True
        kinds = np.flatnonzero(lengths_held)
        inside = held[kinds, 1 : gap + 1] > 0  # of bins at least as full as this one
        reach = np.where(inside.any(axis=1), gap - np.argmax(inside[:, ::-1], axis=1), 0)
        singles = [(n,) for n in own]
        doubles = [(n, m) for k, n in enumerate(own) for m in own[k:] if n != m or len(by_length[n]) > 1]
        for groups in (singles, doubles):
            if not groups or not len(kinds):
                continue
            gain = np.array([sum(g) for g in groups])[:, None] - kinds
            gain[(gain <= 0) | (gain > reach)] = 0
            best = gain.max(axis=1)
            if not best.any():
                continue
            k = int(np.argmax(best > 0))
            at = int(np.argmax(gain[k]))
            back = int(kinds[at])
            room = int(best[k]) + int(np.argmax(held[back, int(best[k]) : gap + 1] > 0))
            b = next(iter(who[back, room]))
            note(b, -1)
            put(next(i for i in bins[b] if size_of[i] == back), b, low)
            taken = dict.fromkeys(groups[k], 0)
            for n in groups[k]:
                put(by_length[n][taken[n]], low, b)
                taken[n] += 1
            note(b, 1)
            return True
        return False

    for b in under:
        note(b, 1)
    changed = len(under) > 1
    while changed:
        changed = False
        failed: set[tuple[int, ...]] = set()  # bins like these can't improve unless something changes
        for low in sorted((b for b in under if 0 < fill[b] < size), key=lambda b: (fill[b], b)):
            if not 0 < fill[low] < size:
                continue
            alike = tuple(sorted(size_of[i] for i in bins[low]))
            if alike in failed:
                continue
            note(low, -1)
            moved = False
            while bins[low] and shrink(low):
                moved = True
            note(low, 1)
            if moved:
                changed = True
                failed.clear()
            else:
                failed.add(alike)
    return [b for b in bins if b]


def places(bins: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and its place there."""
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    for b, members in enumerate(bins):
        sequence[members] = b
        offset[members] = np.cumsum(lengths[members]) - lengths[members]
    return sequence, offset


def repack(lengths: np.ndarray, sequences: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Underfull bins of several partitions packed together, from the better of the given and a new start."""
    given: dict[int, list[int]] = {}
    for i, s in enumerate(sequences.tolist()):
        given.setdefault(s, []).append(i)
    return min((local_search(b, lengths, size) for b in (best_fit(lengths, size), list(given.values()))), key=len)


def _parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, 20_000):
        yield rows.slice(at, 20_000)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    arrow_schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder.get(vocabulary)
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        for batch in (part for whole in batches for part in slices(whole, 1)):
            got = []
            for text in batch.column(1).to_pylist():
                tokens = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(pieces(len(tokens), size)):
                    got.append((len(ids), k, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
                ids.append(None)
            ids[len(ids) - batch.num_rows :] = batch.column(0).to_pylist()
            if got:
                rows.append(np.array(got, dtype=np.int64))
        release()
        if not rows:
            return
        table = np.concatenate(rows)
        lengths = table[:, 3]
        sequence, offset = places(local_search(best_fit(lengths, size), lengths, size), lengths)
        whole = np.bincount(sequence, weights=lengths)[sequence] == size
        sequence += TaskContext.get().partitionId() << 32
        doc = pa.array(ids, pa.int64()).take(pa.array(table[:, 0]))
        columns = [doc, pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, k]) for k in (2, 3, 4)), pa.array(sequence), pa.array(offset), pa.array(whole)]
        yield from _parts(pa.RecordBatch.from_arrays(columns, [*NAMES, "whole"]))
        release()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(batches, arrow_schema).combine_chunks()
        if not rows.num_rows:
            return
        lengths, before = (rows.column(c).to_numpy() for c in ("length", "sequence_id"))
        sequence, offset = places(repack(lengths, before, size), lengths)
        sequence = ~(sequence + (TaskContext.get().partitionId() << 32))  # below 0, apart from the others
        columns = [*(rows.column(c).combine_chunks() for c in NAMES[:5]), pa.array(sequence), pa.array(offset)]
        yield from _parts(pa.RecordBatch.from_arrays(columns, NAMES))

    limit_batches(docs.sparkSession)
    first = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{SCHEMA}, whole boolean")
    placed = materialize(first, "packed")
    loose = placed.filter("not whole").drop("whole")
    groups = max(1, -(-loose.count() // GROUP))
    packed = loose.repartition(groups, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(again, SCHEMA)
    return placed.filter("whole").drop("whole").unionByName(packed)
