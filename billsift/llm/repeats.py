"""Repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else.

Two equal strings have the same minimizer, the hashed ``GRAM``-byte piece with the smallest key, at the same place.
So texts are cut into pieces of successive strings with one minimizer (the anchor), 2 * LENGTH bytes long at most,
and equal strings can only be in pieces of equal anchors. Equal pieces are counted by their hashes; pieces that differ
are brought together by anchor, and there a suffix array over them gives the longest previous factor of
every position: the longer of its matches with the nearest smaller position before and after it in suffix order.

Texts move twice at most, and only those of documents with a repeated anchor. An anchor with more than
``MOST_PIECES`` different pieces is split further, into single strings, which are counted by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billsift.llm import bpe, sketch
from billsift.llm.common import numbered, stored, text_or_empty
from billsift.llm.shingle_join import mixed
from billsift.session import discard

LENGTH = 200
GRAM = 32
MOST_PIECES = 2000
REPEAT_BITS = 26
#: Symbols of one suffix array.
SYMBOLS = 1_000_000

_SPAN = LENGTH - GRAM + 1
_STRETCH = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE_BITS = np.uint64(24)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, width, factor = _OF_BYTE[data], 1, int(_ODD)
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, width * 2
    return mixed(h)


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Smallest of every ``span`` successive keys."""
    n = len(keys)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1))
    padded[:n] = keys
    grid = padded.reshape(blocks, span)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - span + 1], forward[span - 1 : n])


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, piece hashes, first and last string starts) of a text, in order."""
    found = []
    for begin in range(0, max(1, len(data) - LENGTH + 1), _STRETCH):
        part = np.frombuffer(data, np.uint8, min(len(data) - begin, _STRETCH + LENGTH - 1), begin)
        if len(part) < LENGTH:
            break
        hashes = _gram_hashes(part)
        # The leftmost of equal keys: the place fills the low bits.
        keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(keys, _SPAN) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts - 1, [len(at) - 1]])
        found.append((hashes[at[first]], first + begin, last + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    anchors, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    view = memoryview(data)
    hashed = np.array(
        [xxhash.xxh3_64_intdigest(view[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)],
        np.uint64,
    )
    return anchors, hashed, first, last


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their keys, rank of each place's key)."""
    order = np.argsort(keys)
    line = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], line[1:] != line[:-1]])[: len(keys)])
    return order, rank


def _ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first 224 symbols, equal ones in any order, and the ranks by 112."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    order, rank = _ordered(key)
    width, kept = 7, rank
    while width < 224:
        kept = rank
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        order, rank = _ordered(rank * (n + 2) + behind)
        width *= 2
    return order, kept


def _matches(a: np.ndarray, b: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Whether the suffixes at a and b share ``LENGTH`` symbols: the first 112, and the last 112 of these."""
    last = len(ranks) - 1
    same = ranks[a] == ranks[b]
    open_ = np.flatnonzero(same)
    x, y = (np.minimum(c[open_] + (LENGTH - 112), last) for c in (a, b))
    same[open_] = ranks[x] == ranks[y]
    return same


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, or -1. Pointers jump over what is larger."""
    n = len(values)
    found = np.arange(-1, n - 1)
    held = np.concatenate([values, [-1]])
    open_ = np.flatnonzero(held[found] > values)
    while len(open_):
        found[open_] = found[found[open_]]
        open_ = open_[held[found[open_]] > values[open_]]
    return found


def previous_factors(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, source): whether the factor of ``LENGTH`` at a position occurs earlier, and whether it occurs later.

    The nearest smaller positions before and after a suffix in suffix order are its best earlier matches. Suffixes that
    share the factor follow each other there, so their own order does not matter.
    """
    order, ranks = _ranks(symbols)
    repeated, source = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
    for direction in (1, -1):
        line = order[::direction]
        at = _nearest_smaller(line)
        has = np.flatnonzero(at >= 0)
        one, other = line[has], line[at[has]]
        same = _matches(one, other, ranks)
        repeated[one[same]] = True
        source[other[same]] = True
    return repeated, source


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _measured(texts: DataFrame) -> DataFrame:
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.slices(batches, 1):
            contents = [_encoded(t) for t in batch.column(1).to_pylist()]
            found = [pieces(c) for c in contents]
            lists = [
                pa.array([f[k].view(np.int64) for f in found], pa.list_(pa.int64())) for k in range(2)
            ] + [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([_digest(c) for c in contents], pa.binary()),
                    pa.array([len(c) for c in contents], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in contents]),
                    *lists,
                ],
                names=["doc_id", "digest", "n_bytes", "sha256", "anchors", "hashed", "first", "last"],
            )

    return texts.mapInArrow(
        run,
        f"doc_id {kind}, digest binary, n_bytes bigint, sha256 string, anchors array<bigint>, hashed array<bigint>, "
        "first array<int>, last array<int>",
    )


def _fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (digest, first_doc, ...) with the text of their document."""
    key = F.xxhash64("doc_id")
    likely = sketch.probably(texts.withColumn("doc_key", key), "doc_key", wanted.select(F.xxhash64("first_doc").alias("doc_key")))
    return likely.join(wanted, likely["doc_id"].eqNullSafe(wanted["first_doc"])).drop("doc_id", "doc_key", "first_doc")


def _pieces_of(texts: DataFrame, spots: DataFrame, single: bool) -> DataFrame:
    """anchor, row, count, place, piece: the pieces of the spots, or with ``single`` the strings in them."""
    grouped = stored(
        spots.groupBy("digest", "first_doc").agg(
            F.collect_list(F.struct("anchor", "row", "count", "first", "last")).alias("spots")
        )
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of one text twice give their pieces once.
        seen: set[int] = set()
        for batch in bpe.slices(batches, 0):
            out = []
            for text, digest, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = _encoded(text)
                if wanted[0]["row"] in seen or _digest(content) != digest:
                    continue
                seen.add(wanted[0]["row"])
                for s in wanted:
                    piece = content[s["first"] : s["last"] + LENGTH]
                    if not single:
                        out.append((s["anchor"], s["row"], s["count"], 0, piece))
                        continue
                    for k in range(s["last"] - s["first"] + 1):
                        string = piece[k : k + LENGTH]
                        out.append((s["anchor"], s["row"], s["count"], k, _digest(string)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                ["anchor", "row", "count", "place", "piece"],
            )

    return _fetched(texts, grouped).select("text", "digest", "spots").mapInArrow(
        cut, "anchor bigint, row bigint, count bigint, place int, piece binary"
    )


def _compared(texts: DataFrame, spots: DataFrame, keep_first: bool) -> DataFrame:
    """(row, starts, ends): runs of repeated string starts of pieces, relative to the piece's first.

    spots: digest, first_doc, anchor, row, count, first, last, hot; a row per different piece of the anchors.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts, parts, held, anchor = [], [], [], 0, None

        def out() -> pa.RecordBatch:
            symbols = np.zeros(held + len(parts), np.uint64)
            at, begins = 0, []
            for p in parts:
                symbols[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint64) + np.uint64(1)
                begins.append(at)
                at += len(p) + 1
            repeated, source = previous_factors(symbols)
            marked = repeated if keep_first else repeated | source
            found = [_runs(marked[b : b + len(p) - LENGTH + 1]) for b, p in zip(begins, parts, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64())] + [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)],
                ["row", "starts", "ends"],
            )

        for batch in batches:
            for a, row, count, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if a != anchor and held >= SYMBOLS:
                    yield out()
                    rows, counts, parts, held = [], [], [], 0
                anchor = a
                rows.append(row)
                counts.append(count)
                parts.append(piece)
                held += len(piece)
        if parts:
            yield out()

    plain = (
        _pieces_of(texts, spots.filter(~F.col("hot")), False).repartition("anchor").sortWithinPartitions("anchor", "row")
        .mapInArrow(search, "row bigint, starts array<bigint>, ends array<bigint>")
    )
    hot = spots.filter("hot")
    if hot.isEmpty():
        return plain
    # Strings of split anchors: equal ones have equal hashes.
    strings = stored(_pieces_of(texts, hot, True))
    totals = strings.groupBy("anchor", "piece").agg(F.sum("count").alias("n"), F.min(F.struct("row", "place")).alias("least"))
    single = strings.join(totals.filter("n > 1"), ["anchor", "piece"]).filter(
        F.lit(not keep_first) | (F.struct("row", "place") != F.col("least"))
    ).select(
        "row", F.array(F.col("place").cast("bigint")).alias("starts"), F.array((F.col("place") + 1).cast("bigint")).alias("ends")
    )
    return plain.unionByName(single)


def removals(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """digest, first_doc, copies, n_bytes, sha256, cuts (byte ranges to remove, possibly overlapping) per distinct text,
    and the table of rows with their digest: (distinct, rows).

    With ``keep_first`` the first occurrence of a string stays: by smallest doc_id, then by place.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    measured = stored(_measured(texts))
    known = numbered(
        measured.groupBy("digest").agg(
            F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"),
            F.first("sha256").alias("sha256"),
        ),
        "text_no",
    )
    def all_anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).view(np.uint64)

    twice = sketch.repeated(measured.select("anchors"), all_anchors, REPEAT_BITS)
    kind = dict(measured.dtypes)["doc_id"]
    parts = "anchors array<bigint>, hashed array<bigint>, first array<int>, last array<int>"

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [pc.list_flatten(batch.column(k)).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            parents = pc.list_parent_indices(batch.column(2)).to_numpy(zero_copy_only=False)
            stay = sketch.is_repeated(twice.value, flat[0].view(np.uint64), REPEAT_BITS)
            ends = np.concatenate([[0], np.cumsum(np.bincount(parents[stay], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.ListArray.from_arrays(pa.array(ends), pa.array(f[stay])) for f in flat],
                ["doc_id", "digest", "anchors", "hashed", "first", "last"],
            )

    # Only one row of each text takes part, and only its pieces whose anchor may occur again.
    likely = measured.select("doc_id", "digest", "anchors", "hashed", "first", "last").mapInArrow(
        thinned, f"doc_id {kind}, digest binary, {parts}"
    ).filter("size(anchors) > 0")
    heads = known.select(F.col("digest").alias("known_digest"), "first_doc", "text_no")
    rows = (
        likely.drop("doc_id").join(heads, F.col("digest") == F.col("known_digest")).dropDuplicates(["digest"])
        .select("text_no", "first_doc", F.inline(F.arrays_zip("anchors", "hashed", "first", "last")))
        .withColumnRenamed("anchors", "anchor")
    )
    if keep_first:
        rows = rows.repartitionByRange("first_doc").sortWithinPartitions("first_doc", "text_no", "first")
    rows = numbered(rows, "row")
    # The pieces are in the rows now; of the texts only these columns are asked for again.
    digested = stored(measured.select("doc_id", "digest", "n_bytes"))
    discard(measured)
    twice.destroy()
    distinct = rows.groupBy("anchor", "hashed").agg(F.count(F.lit(1)).alias("count"), F.min("row").alias("least"))
    distinct = stored(distinct)
    per_anchor = distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("count").alias("fewest")
    ).filter("kinds > 1" if keep_first else "kinds > 1 and fewest = 1")
    spots = (
        distinct.join(per_anchor, "anchor")
        .join(rows.select("row", "text_no", "first", "last"), F.col("least") == F.col("row"))
        .join(known.select("text_no", "digest", "first_doc"), "text_no")
        .select("digest", "first_doc", "anchor", "row", "count", "first", "last", (F.col("kinds") > MOST_PIECES).alias("hot"))
    )
    partial = _compared(texts, spots, keep_first)
    whole = rows.join(distinct, ["anchor", "hashed"]).filter(
        (F.col("row") != F.col("least")) if keep_first else (F.col("count") > 1)
    ).select("text_no", F.col("first").cast("bigint").alias("from"), (F.col("last") + LENGTH).cast("bigint").alias("to"))
    runs = partial.select("row", F.explode(F.arrays_zip("starts", "ends")).alias("run"))
    some = runs.join(rows.select("row", "text_no", "first"), "row").select(
        "text_no",
        (F.col("first") + F.col("run.starts")).alias("from"),
        (F.col("first") + F.col("run.ends") - 1 + LENGTH).alias("to"),
    )
    cuts = whole.unionByName(some).groupBy("text_no").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("cuts"))
    return known.join(cuts, "text_no", "left"), digested


def _cut(content: bytes, cuts: list[dict]) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, removed runs)."""
    left, at, runs = [], 0, 0
    for c in cuts:
        if c["from"] > at or not runs:
            runs += 1
            left.append(content[at : c["from"]])
            at = c["to"]
        else:
            at = max(at, c["to"])
    left.append(content[at:])
    kept = b"".join(left)
    return kept, len(content) - len(kept), runs


def digests(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; judged on the whole input.

    A null text is empty. A text of fewer than ``LENGTH`` bytes stays. Rows with equal texts are copies of each other
    and lose everything (with ``keep_first`` all but the first). Other columns are not looked at; an empty table
    gives no row.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    found, rows = removals(docs, keep_first)
    found = stored(found)
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH) & F.lit(not keep_first)
    touched = found.filter(~copied & F.col("cuts").isNotNull()).select("digest", "first_doc", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.slices(batches, 0):
            out = []
            for text, digest, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = _encoded(text)
                if _digest(content) == digest:
                    kept, removed, spans = _cut(content, cuts)
                    out.append((digest, removed, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["digest", "n_removed", "n_spans", "kept_sha256"],
            )

    changed = _fetched(texts, touched).select("text", "digest", "cuts").mapInArrow(
        run, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string"
    ).dropDuplicates(["digest"])
    nothing = hashlib.sha256(b"").hexdigest()
    results = found.select("digest", "first_doc", "copies", "sha256", copied.alias("copied")).join(changed, "digest", "left")
    done = rows.select("doc_id", "digest", "n_bytes").join(results, "digest")
    # With keep_first, later rows of a text lose it whole.
    later = F.col("copied") | (
        F.lit(keep_first) & (F.col("n_bytes") >= LENGTH) & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    )
    return done.select(
        "doc_id",
        "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(later, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
