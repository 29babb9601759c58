"""Shared helpers: table access, shared-folder materialisation, Arrow mapping and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, shared_dir

__all__ = ["Words", "fresh", "limit_batches", "map_arrow", "materialize", "mix64", "release", "run_hashes", "shared_dir", "slices", "table", "words_in", "words_of"]

#: Rows, and bytes of text, that a task turns into Python objects at once; one longer text counts as a slice.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
#: Rows of an Arrow batch at most; texts are long, and both sides hold whole batches.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores after it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes of column ``text``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(size[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right"))), at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives freed memory back to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def limit_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on rows of an Arrow batch to ``BATCH_ROWS`` where it is higher."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, BATCH_ROWS)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema, text: int | None = None) -> DataFrame:
    """``mapInArrow`` with state per task: ``make()`` runs once per task and gives the batch function.

    With ``text``, the place of a text column, the function gets small slices of the batches.
    The session's limit on rows of a batch is lowered to ``BATCH_ROWS`` where it is higher.
    """
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for part in (batch,) if text is None else slices(batch, text):
                    yield from step(part)
        finally:
            del step
            release()

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``: runs between ASCII white space only."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if text else []


def mix64(x):
    """The splitmix64 finaliser over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(words, n: int):
    """Hashes of all runs of ``n`` consecutive words, from their uint64 hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    odd = 0x9E3779B97F4A7C15
    for k in range(n):
        total += words[k : k + count] * np.uint64(odd)
        odd = odd * 0xD1342543DE82EF95 % 2**64
    return mix64(total)


class Words(NamedTuple):
    """The words of some texts, as arrays: bytes, where each word starts and ends in them, its hash, and each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def packed(self, a: int, b: int) -> bytes:
        """Words [a, b), with single spaces between."""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xA0761D6478BD642F


def words_in(column: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of strings (or bytes), A-Z in lower case if so wished; null texts have none.

    Separators are ASCII, so words are found in the UTF-8 bytes; a word's hash is a
    polynomial over random values of its bytes, mixed with its length.
    """
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    at = at - at[0]
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text starts here
    cut[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts):
        length = ends - starts
        place = np.arange(len(data))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        place[~inside] = 0
        value = _BYTE[data] * powers(_BASE, int(length.max()))[place]
        value[~inside] = 0
        hashes = mix64(np.add.reduceat(value, starts) + length.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    else:
        hashes = np.empty(0, dtype=np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, at))
