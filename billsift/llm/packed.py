"""Token ids in files of 64-bit words (Simple-8b), written and read as blocks.

A word has a selector in its top four bits and so many ids of equal width below. Ids of 60 bits or
more follow an escape word as they are. Every block of ``BLOCK`` ids starts a new word, and a
segment keeps the word at which each of its blocks starts, so all blocks of a segment are packed and
unpacked side by side.

The files are Parquet files with one row per segment, so Spark's writer commits them and any store
that Spark reaches can hold them. A segment holds whole documents:

    shard, first     place of the segment: shard in doc_id order, ids of the shard before it
    doc_ids, lengths documents in order and their number of ids
    starts           word at which each block starts, unsigned 32-bit
    words            unsigned 64-bit, little-endian
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billsift.llm import bpe, words
from billsift.session import ensure_checkpoint_dir

# Fixed values of the format: ids per word and bits per id, by selector.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
           (3, 20), (2, 30), (1, 60))
ESCAPE = len(LAYOUTS)

BLOCK = 1024
SEGMENT_IDS = 262_144
#: Id that ends each document.
END_ID = 2


def _widths_searched(ids: np.ndarray) -> np.ndarray:
    known = sorted({b for _, b in LAYOUTS})
    limits = np.array([1 << b for b in known], np.uint64)
    return np.array([*known, 64], np.uint8)[np.searchsorted(limits, ids, side="right")]


#: Widths of the ids below 2 ** 16, which most vocabularies do not exceed.
_WIDTHS = _widths_searched(np.arange(1 << 16, dtype=np.uint64))


def _widths(ids: np.ndarray) -> np.ndarray:
    """The least width of the layouts that holds an id; 64 if none does."""
    if int(ids.max()) < len(_WIDTHS):
        return _WIDTHS[ids.astype(np.uint16)]
    return _widths_searched(ids)


def _widest(widths: np.ndarray, count: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Largest width among the next ``count`` ids, at every position."""
    if count not in known:
        half = max(c for c in known if c < count)
        rest = count - half
        if rest > half:
            _widest(widths, half * 2, known)
            return _widest(widths, count, known)
        # Two windows that overlap cover the whole one.
        front = known[half]
        back = np.zeros_like(front)
        back[:, : front.shape[1] - rest] = front[:, rest:]
        known[count] = np.maximum(front, back)
    return known[count]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of blocks, words) of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    # Room after each block, of width zero, so that the last word of a block may be filled up.
    room = 64
    grid = np.zeros((blocks, BLOCK + room), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    widths = _widths(grid)
    choice = np.full(grid.shape, ESCAPE, np.uint8)
    known = {1: widths}
    for selector in range(len(LAYOUTS) - 1, -1, -1):
        count, bits = LAYOUTS[selector]
        np.copyto(choice, np.uint8(selector), where=_widest(widths, count, known) <= bits)
    counts = np.array([c for c, _ in LAYOUTS] + [1], np.int64)
    steps = counts[choice]
    size = np.full(blocks, BLOCK, np.int64)
    size[-1] = len(ids) - (blocks - 1) * BLOCK
    # All blocks take their next word at the same time.
    lanes = np.arange(blocks)
    at = np.zeros(blocks, np.int64)
    taken_lane, taken_at = [], []
    while len(lanes):
        taken_lane.append(lanes)
        taken_at.append(at)
        at = at + steps[lanes, at]
        open_ = at < size[lanes]
        lanes, at = lanes[open_], at[open_]
    # Places in the grid as one number: in order of block and place.
    cells, chosen = grid.reshape(-1), choice.reshape(-1)
    spot = np.sort(np.concatenate(taken_lane) * grid.shape[1] + np.concatenate(taken_at))
    lane, selector = spot // grid.shape[1], chosen[spot]
    lengths = 1 + (selector == ESCAPE)
    place = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(place[-1], np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[place[rows]] = np.uint64(ESCAPE << 60)
            out[place[rows] + 1] = cells[spot[rows]]
            continue
        count, bits = LAYOUTS[s]
        word, first = np.full(len(rows), int(s) << 60, np.uint64), spot[rows]
        for k in range(count):
            word |= cells[first + k] << np.uint64(k * bits)
        out[place[rows]] = word
    starts = place[:-1][np.searchsorted(lane, np.arange(blocks))].astype(np.uint32)
    return starts, out


def unpack(starts: np.ndarray, packed: np.ndarray, total: int) -> np.ndarray:
    """The ``total`` ids of a segment."""
    blocks = len(starts)
    if not blocks:
        return np.zeros(0, np.uint64)
    selector = (packed >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(packed), bool)
    for p in np.flatnonzero(selector == ESCAPE):
        if not raw[p]:
            raw[p + 1] = True
    counts = np.array([c for c, _ in LAYOUTS] + [0], np.int64)
    held = np.where(raw, 1, counts[np.minimum(selector, ESCAPE)])
    ahead = np.cumsum(held) - held
    lane = np.searchsorted(starts, np.arange(len(packed)), side="right") - 1
    at = ahead - ahead[starts][lane]
    width = BLOCK + 64
    cells, spot = np.zeros(blocks * width, np.uint64), lane * width + at
    for s in np.unique(selector[~raw]):
        if s == ESCAPE:
            continue
        count, bits = LAYOUTS[s]
        rows = np.flatnonzero((selector == s) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        first, content = spot[rows], packed[rows]
        for k in range(count):
            cells[first + k] = (content >> np.uint64(k * bits)) & mask
    rows = np.flatnonzero(raw)
    cells[spot[rows]] = packed[rows]
    return cells.reshape(blocks, width)[:, :BLOCK].reshape(-1)[:total]


class _Encoder:
    """Ids by the tokenizers library, asked once for each piece of a text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._model = self._library.model
        self._letters = bpe.byte_letters()
        self._pieces = words.Kept(self._piece)
        self.chunks = words.Kept(self._chunk)
        self._plain = words.plain(t.content for t in self._library.get_added_tokens_decoder().values())

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII letters stand for themselves.
        if not (piece.isascii() and piece.isprintable()):
            letters = self._letters
            piece = "".join([letters[b] for b in piece.encode()])
        ids = [t.id for t in self._model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if not self._plain(chunk):
            return np.array(self._library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        known, found = self._pieces, words.pieces(chunk)
        return known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])

    def encode(self, text: str) -> bytes:
        known = self.chunks
        return b"".join(map(known.__getitem__, words.chunks(text)))


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encodes every text, appends the end id and writes the files in ascending doc_id order.

    A null text counts as empty and has the end id alone; a null doc_id comes first; rows with the
    same doc_id follow each other in the order of their texts. An empty table writes no segment.
    ``shards`` defaults to the number of shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ending = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoder(path)
        shard = TaskContext.get().partitionId()
        first, held, owners, parts = 0, 0, [], []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            starts, packed = pack(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([owners]),
                    pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                    pa.array([starts.astype("<u4").tobytes()], pa.binary()),
                    pa.array([packed.astype("<u8").tobytes()], pa.binary()),
                ],
                names=["shard", "first", "n_ids", "doc_ids", "lengths", "starts", "words"],
            )

        for batch in batches:
            owner_type = pa.list_(batch.column(0).type)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = known.encode(text) + ending
                owners.append(doc_id)
                parts.append(part)
                held += len(part) // 4
                if held >= SEGMENT_IDS:
                    owners = pa.scalar(owners, owner_type)
                    yield segment()
                    first, held, owners, parts = first + held, 0, [], []
        if parts:
            owners = pa.scalar(owners, owner_type)
            yield segment()

    rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
        run,
        f"shard int, first bigint, n_ids bigint, doc_ids array<{kind}>, lengths array<bigint>, "
        "starts binary, words binary",
    ).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, place (ids of the shard before the document), ids (binary, unsigned 32-bit)."""
    segments = spark.read.parquet(folder)
    kind = dict(segments.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                total, lengths = at["n_ids"].as_py(), np.array(at["lengths"].as_py(), np.int64)
                ids = unpack(
                    np.frombuffer(at["starts"].as_py(), "<u4"), np.frombuffer(at["words"].as_py(), "<u8"), total
                ).astype("<u4")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        at["doc_ids"].values,
                        pa.array(np.full(len(ends), at["shard"].as_py(), np.int32)),
                        pa.array(ends - lengths + at["first"].as_py()),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "shard", "place", "ids"],
                )

    return segments.mapInArrow(run, f"doc_id {kind}, shard int, place bigint, ids binary")


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids before each shard: one row per file partition, from two narrow columns."""
    totals = spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("held"))
    return totals.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("base"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Start, count and checksum of every document, from the files."""
    rows = read(spark, folder).select(
        "doc_id",
        "shard",
        "place",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return rows.join(shard_starts(spark, folder), "shard").select(
        "doc_id", (F.col("place") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"


