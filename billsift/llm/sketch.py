"""Counts of 64-bit hashes in a table of fixed size.

Functions that give the hashes of a batch return one array or an iterator of arrays.
Hashes that share a slot are counted together, so a count is never too low. Operators use the table to order
work or to leave out what cannot repeat, never to decide a result; its size is a parameter that
more memory may raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from billsift.llm import workers
from billsift.llm.common import stored
from billsift.session import shuffles_removed

_CHUNK_BITS = 16
#: Hashes a task gathers before it passes their counts on.
_GATHERED = 4_000_000
#: Slots per hash, at least, where hashes are looked at in ranges.
SPARE = 4


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Bits of a count: 0 for none, 1 for one, 2 for two or three, ..."""
    return np.ceil(np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def levels(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """Levels of the counts of all hashes of ``df``, one byte per slot: 2 ** bits bytes on every worker."""
    return _broadcast(df, hashes, bits, _levels)


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """One bit per slot: whether two hashes or more fall on it."""
    return _broadcast(df, hashes, bits, lambda counts: np.packbits(counts > 1))


def is_repeated(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slots = slots_of(hashes, bits)
    return (table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0


def recurring(df: DataFrame, column: str, name: str, total: int, bits: int) -> list[DataFrame]:
    """Values of a list column of hashes that fall on a slot with another one: one row each, as ``name``, beside the other columns.

    The hashes, ``total`` of them or about so many, are taken in as many ranges as keep a table at most
    ``1 / SPARE`` full, so that the share of single ones that stay does not grow with the input. Each range is stored.
    """
    others = [c for c in df.columns if c != column]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{name} bigint"] + [f"`{c}` {kinds[c]}" for c in others])
    ranges = max(1, -(-SPARE * total >> bits))
    rows = df.select(column, *others)
    parts = []
    for nth in range(ranges):

        def of_range(values: np.ndarray, nth: int = nth) -> np.ndarray:
            # The top bits are the slot, so others tell the range.
            return (values & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32) == nth

        def hashes(batch: pa.RecordBatch, of_range=of_range) -> Iterator[np.ndarray]:
            values = _flat(batch.column(0))
            yield values[of_range(values)]

        twice = repeated(rows.select(column), hashes, bits)

        def kept(batches: Iterator[pa.RecordBatch], of_range=of_range, twice=twice) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = _flat(batch.column(0))
                inside = np.flatnonzero(of_range(values))
                stay = inside[is_repeated(twice.value, values[inside], bits)]
                owners = pc.list_parent_indices(batch.column(0)).take(pa.array(stay))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[stay].view(np.int64)), *[c.take(owners) for c in batch.columns[1:]]], [name, *others]
                )

        parts.append(stored(workers.mapped(rows, kept, schema)))
        twice.destroy()
    return parts


def _flat(lists: pa.Array) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)


def _broadcast(df, hashes, bits, reduced) -> Broadcast:
    chunks, width = 1 << (bits - _CHUNK_BITS), 1 << _CHUNK_BITS

    def flushed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(gathered))
        ends = np.searchsorted(slots, np.arange(1, chunks + 1, dtype=np.uint64) << np.uint64(_CHUNK_BITS))
        pack = zstandard.ZstdCompressor(level=1).compress
        numbers, blobs, start = [], [], 0
        for chunk, end in enumerate(ends.tolist()):
            if end > start:
                places = slots[start:end] & np.uint32(width - 1)
                numbers.append(chunk)
                if 4 * (end - start) < width:
                    # Few: the steps from place to place.
                    steps = np.diff(places, prepend=np.uint32(0)).astype("<u2")
                    blobs.append(b"\1" + pack(steps.tobytes()))
                else:
                    counts = np.minimum(np.bincount(places, minlength=width), 65535).astype("<u2")
                    blobs.append(b"\0" + pack(counts.view(np.uint8).reshape(-1, 2).T.tobytes()))
            start = end
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            parts = hashes(batch)
            for part in [parts] if isinstance(parts, np.ndarray) else parts:
                found = slots_of(part, bits)
                gathered.append(found)
                held += len(found)
                if held >= _GATHERED:
                    yield flushed(gathered)
                    gathered, held = [], 0
        if held:
            yield flushed(gathered)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=1).compress
        last, counts = None, None

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([last], pa.int32()), pa.array([pack(reduced(counts).tobytes())], pa.binary())], ["chunk", "counts"]
            )

        # The rows come in order of their chunk, so one chunk is held at a time.
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != last:
                    if last is not None:
                        yield summed()
                    last, counts = chunk, np.zeros(width, np.int64)
                blob = blob.as_py()
                content = unpack(blob[1:])
                if blob[0]:
                    np.add.at(counts, np.cumsum(np.frombuffer(content, "<u2"), dtype=np.int64), 1)
                else:
                    halves = np.frombuffer(content, np.uint8).reshape(2, width)
                    counts += halves[0]
                    counts += halves[1].astype(np.int64) << 8
        if last is not None:
            yield summed()

    schema = "chunk int, counts binary"
    # One row per chunk: the size of the table, whatever the input.
    with shuffles_removed(df.sparkSession):
        parts = workers.mapped(df, count, schema).repartition("chunk").sortWithinPartitions("chunk")
        rows = workers.mapped(parts, add, schema).collect()
    unpack = zstandard.ZstdDecompressor().decompress
    empty = reduced(np.zeros(width, np.int64))
    table = np.zeros((chunks, len(empty)), np.uint8)
    for row in rows:
        table[row["chunk"]] = np.frombuffer(unpack(bytes(row["counts"])), np.uint8)
    return df.sparkSession.sparkContext.broadcast(table.reshape(-1))


def probably(df: DataFrame, key: str, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """Rows whose 64-bit ``key`` is in the column of the same name of ``wanted``, and a few others.

    Spares a shuffle of rows that a following join drops anyway.
    """

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    table = _broadcast(wanted.select(key), hashes, bits, lambda counts: np.packbits(counts > 0))
    at = df.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = slots_of(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            stay = (table.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(stay > 0))

    return workers.mapped(df, keep, df.schema)
