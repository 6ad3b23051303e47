"""Documents packed into sequences of one length, related documents next to each other.

A document is its token ids and an end id. As many whole sequences as it fills are its own; what is left
over, and documents shorter than a sequence, are tails, and tails fill sequences together:

* Tails are documents of a BM25 index over token ids, with statistics over all tails.
* The index is cut into shards of bounded size, each built and asked in one task. So that neighbours meet
  in a shard, tails are ordered by their two most telling terms; equal ones are spread by their number, so
  a group of copies of any size fills as many shards as it needs.
* In a shard, a seed opens a sequence and its unused neighbours follow by descending score until the
  sequence is full. The last one is cut, and its rest is the next seed. A seed without unused neighbours
  is followed by the next unused tail of the shard.
* What a shard has left at its end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billsift.llm import bpe
from billsift.llm.common import stored

#: Ids of a sequence, a power of two.
WINDOW = 1024
#: Id that ends each document.
END_ID = 0
#: Ids of the tails of one shard, about; tails of a shard at most.
SHARD_IDS = 4_000_000
SHARD_TAILS = 16_384
#: A seed asks with so many of its terms, those of the highest weight, for so many neighbours at a time.
QUERY_TERMS = 16
NEIGHBOURS = 48
#: BM25: saturation of counts and weight of lengths.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75

# Fixed value: how byte-level vocabularies split a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Rows of one task are numbered below this.
_TASK = 1 << 33


class _Encoder:
    """Ids of a byte-level vocabulary file whose ids follow its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        byte_of = {letter: b for b, letter in enumerate(bpe.byte_letters())}
        ids = {t: i for t, i in content["model"]["vocab"].items() if t not in special}
        self.size = max([*ids.values(), *special.values()]) + 1
        self._special = special
        ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items()}
        self._plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if not any(s in text for s in self._special):
            return self._plain.encode_ordinary(text)
        out: list[int] = []
        for part, number in bpe.words.special_parts(text, self._special):
            out += self._plain.encode_ordinary(part) if number is None else [number]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    """The encoder of a vocabulary file, built once per worker."""
    return _Encoder(path)


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def coded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, doc_tokens, window_no (of its first own sequence), full and tail (ids). Stored."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        width = _kind(known.size)
        windows = TaskContext.get().partitionId() * _TASK
        for batch in bpe.slices(batches, 2):
            sizes, first, full, tail = [], [], [], []
            for text in batch.column(2).to_pylist():
                ids = known.encode(text)
                ids.append(end_id)
                packed = np.array(ids, width)
                own = len(ids) // WINDOW
                sizes.append(len(ids))
                first.append(windows)
                full.append(packed[: own * WINDOW].tobytes())
                tail.append(packed[own * WINDOW :].tobytes())
                windows += own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(full, pa.binary()), pa.array(tail, pa.binary())],
                names=["row", "doc_id", "doc_tokens", "window_no", "full", "tail"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(
        rows.mapInArrow(
            run, f"row long, doc_id {kind}, doc_tokens long, window_no long, full binary, tail binary"
        )
    )


_PIECE = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(_PIECE))


def _piece_schema(rows: DataFrame) -> str:
    return (
        f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )


def _own_sequences(rows: DataFrame, width: str) -> DataFrame:
    """The sequences that one document fills alone; their numbers are even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.slices(batches, 3):
            out = []
            for doc_id, tokens, first, full in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(full, width).astype("<u4").tobytes()
                for n in range(len(ids) // (4 * WINDOW)):
                    part = ids[n * 4 * WINDOW : (n + 1) * 4 * WINDOW]
                    out.append((doc_id, n * WINDOW, WINDOW, part, tokens, 2 * (first + n), 0))
            if out:
                yield _pieces(out, batch.column(0).type)

    return (
        rows.filter("doc_tokens >= " + str(WINDOW))
        .select("doc_id", "doc_tokens", "window_no", "full")
        .mapInArrow(run, _piece_schema(rows))
    )


def _statistics(tails: DataFrame, width: str, size: int) -> tuple[np.ndarray, int, int]:
    """(tails per term, tails, their ids): sums per task before the shuffle, one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 2, np.int64)
        for batch in batches:
            for tail in batch.column(0):
                ids = np.frombuffer(tail.as_buffer(), width)
                held[np.unique(ids)] += 1
                held[size] += 1
                held[size + 1] += len(ids)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "n"])

    out = np.zeros(size + 2, np.int64)
    for row in tails.select("tail").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out[:size], int(out[size]), int(out[size + 1])


def _impacts(tail: np.ndarray, idf: np.ndarray, mean: float, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, BM25 impacts) of a tail; the end id is no term."""
    terms, counts = np.unique(tail, return_counts=True)
    counts = counts[terms != end_id]
    terms = terms[terms != end_id]
    norm = SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * len(tail) / mean)
    return terms, idf[terms] * (counts * (SATURATION + 1) / (counts + norm)).astype(np.float32)


class _Shard:
    """Inverted index over the tails of a shard, and what is unused of them."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, end_id: int):
        self.sizes = [len(t) for t in tails]
        self.taken = [0] * len(tails)
        self.free = np.ones(len(tails), bool)
        found = [_impacts(t, idf, mean, end_id) for t in tails]
        self.queries = [t[np.argsort(-w, kind="stable")[:QUERY_TERMS]] for t, w in found]
        owner = np.repeat(np.arange(len(tails), dtype=np.int32), [len(t) for t, _ in found])
        terms = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        self.owner, self.impact = owner[order], np.concatenate([w for _, w in found])[order] if found else owner
        self.starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self._next = 0

    def next_unused(self) -> int | None:
        while self._next < len(self.sizes):
            if self.free[self._next]:
                return self._next
            self._next += 1
        return None

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused tails by descending score for the seed's terms, the most telling ones first."""
        ranges = [(self.starts[t], self.starts[t + 1]) for t in self.queries[seed].tolist()]
        if not ranges:
            return np.zeros(0, np.int64)
        owner = np.concatenate([self.owner[a:b] for a, b in ranges])
        score = np.bincount(owner, np.concatenate([self.impact[a:b] for a, b in ranges]), len(self.sizes))
        score *= self.free
        best = np.flatnonzero(score)
        if len(best) > NEIGHBOURS:
            top = np.partition(score[best], len(best) - NEIGHBOURS)[len(best) - NEIGHBOURS]
            best = best[score[best] >= top]
        return best[np.argsort(-score[best], kind="stable")]

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Pieces (tail, start in it, length) of one sequence after the other; only the last may be short."""
        seed: int | None = None
        while True:
            pieces: list[tuple[int, int, int]] = []
            room = WINDOW
            seed = self.next_unused() if seed is None else seed
            while room and seed is not None:
                waiting = iter((seed,))
                asked = False
                while room:
                    tail = next(waiting, None)
                    if tail is None:
                        if asked:
                            break
                        waiting, asked = iter(self.neighbours(seed).tolist()), True
                        continue
                    start = self.taken[tail]
                    length = min(room, self.sizes[tail] - start)
                    pieces.append((tail, start, length))
                    room -= length
                    self.taken[tail] = start + length
                    self.free[tail] = self.taken[tail] < self.sizes[tail]
                seed = self.next_unused()
            if not pieces:
                return
            yield pieces
            last = pieces[-1][0]
            seed = last if self.free[last] else None


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence that is not full, cut into sequences of powers of two, the longest first."""
    left = sum(length for _, _, length in pieces)
    waiting = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            tail, start, length = waiting.pop()
            here = min(room, length)
            out.append((tail, start, here))
            room -= here
            if here < length:
                waiting.append((tail, start + here, length - here))
        yield out


def _shared_sequences(rows: DataFrame, width: str, size: int, end_id: int) -> DataFrame:
    """Sequences made of tails; their numbers are odd."""
    spark = rows.sparkSession
    tails = rows.filter("octet_length(tail) > 0").select("row", "doc_id", "doc_tokens", "tail")
    holding, count, total = _statistics(tails, width, size)
    mean = total / max(count, 1)
    idf = np.log1p((count - holding + 0.5) / (holding + 0.5)).astype(np.float32)
    # One weight per id of the vocabulary.
    sent = spark.sparkContext.broadcast((idf, np.where(holding > 1, idf, 0).astype(np.float32)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A term that no other tail has leads nowhere.
        _, telling = sent.value
        for batch in batches:
            firsts, seconds = [], []
            for tail in batch.column(3):
                terms, impacts = _impacts(np.frombuffer(tail.as_buffer(), width), telling, mean, end_id)
                best = terms[np.lexsort((terms, -impacts))[:2]].tolist() if len(terms) < 3 else None
                if best is None:
                    top = np.argpartition(-impacts, 1)[:2]
                    best = terms[top[np.lexsort((terms[top], -impacts[top]))]].tolist()
                best += [-1, -1]
                firsts.append(best[0])
                seconds.append(best[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(firsts, pa.int32()), pa.array(seconds, pa.int32())],
                names=[*batch.schema.names, "first", "second"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = sent.value
        number = TaskContext.get().partitionId() * _TASK
        owners: list[tuple] = []
        held: list[np.ndarray] = []

        def packed(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            out = []
            for pieces in _Shard(held, weights, mean, end_id).sequences():
                whole = sum(length for _, _, length in pieces) == WINDOW
                for part in [pieces] if whole else _powers(pieces):
                    offset = 0
                    for tail, start, length in part:
                        doc_id, tokens = owners[tail]
                        ids = held[tail][start : start + length].astype("<u4").tobytes()
                        before = tokens - len(held[tail]) + start
                        out.append((doc_id, before, length, ids, tokens, 2 * number + 1, offset))
                        offset += length
                    number += 1
            owners.clear()
            held.clear()
            return _pieces(out, kind)

        count = 0
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, tokens, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owners.append((doc_id, tokens))
                held.append(np.frombuffer(tail, width))
                count += len(held[-1])
                if count >= 2 * SHARD_IDS or len(held) >= SHARD_TAILS:
                    yield packed(kind)
                    count = 0
        if held:
            yield packed(kind)

    kind = dict(rows.dtypes)["doc_id"]
    order = ["first", "second", "row"]
    return (
        tails.mapInArrow(keyed, f"row long, doc_id {kind}, doc_tokens long, tail binary, first int, second int")
        .repartitionByRange(max(1, -(-total // SHARD_IDS)), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "doc_tokens", "tail")
        .mapInArrow(run, _piece_schema(rows))
    )


def packed(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (binary, unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    A null text is empty and has the end id alone. Rows are documents: repeated rows and ids are packed as
    often as they occur, a null doc_id stays null, other columns play no part. An empty table gives no
    pieces. Every id lies in one piece; sequences hold ``WINDOW`` ids or a smaller power of two.
    """
    rows = coded(docs, path, end_id)
    size = encoder(path).size
    width = _kind(size)
    return _own_sequences(rows, width).unionByName(_shared_sequences(rows, width, size, end_id))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
