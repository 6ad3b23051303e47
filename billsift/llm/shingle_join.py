"""Self-join of documents on the Jaccard similarity of their word shingles.

Shingles have one global order, rare ones first, by class and hash. Class 1 holds the rare shingles,
class 2 and 3 the frequent ones. A document's prefix starts with its rarest shingles; class 1
shingles in it are indexed one by one, class k shingles as combinations of k. Combinations stay
within one of several groups into which each class is split by hash, so their number grows in
proportion to the prefix. A group gives k - 1 shingles less than it holds, and the prefix is
extended until it gives one more than a similar document may lack: two similar documents then share an
indexed entry. Documents that share one are compared exactly.

The number of groups depends on the size of a set, to the power of two; a document whose similar
ones may lie in the next power is indexed for both.
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

from billsift.llm import bpe, linking, sketch, words, workers
from billsift.llm.common import numbered, stored, text_or_empty
from billsift.session import discard

WIDTH = 4
PERCENT = 85
#: Slots of the frequency table and of the table of repeated entries, as powers of two.
ORDER_BITS = 24
REPEAT_BITS = 26
#: Documents from which on a shingle is frequent (class 2) and very frequent (class 3), beyond the
#: mean count of a slot.
FREQUENT = 8
VERY_FREQUENT = 1024
#: The index finds all similar pairs from this percentage on.
LEAST_PERCENT = 80

_ODD = np.uint64(0x9E3779B97F4A7C15)
_known = words.Kept(lambda word: xxhash.xxh64_digest(word), 40_000_000)
workers.at_end_of_task(_known.forget)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _hashed(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the word shingles in order; of all words, if there are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.frombuffer(b"".join([_known[w] for w in found]), np.uint64)
    width = min(width, len(ids))
    h = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        h = h * _ODD + ids[k : len(ids) - width + 1 + k]
    return mixed(h + np.uint64(width))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(_hashed(text, width))


def _combined(tokens: np.ndarray, groups: np.ndarray, k: int, salt: int) -> list[np.ndarray]:
    """Hashes of all combinations of k tokens that are in the same group."""
    order = np.lexsort((tokens, groups))
    tokens, groups = tokens[order], groups[order]
    n = len(tokens)
    out = []
    for d in range(1, n):
        near = groups[d:] == groups[:-d]
        if not near.any():
            break
        first = np.flatnonzero(near)
        if k == 2:
            out.append(mixed(tokens[first] * _ODD + tokens[first + d] + np.uint64(salt)))
            continue
        for e in range(d + 1, n):
            third = first[first + e < n]
            third = third[groups[third + e] == groups[third]]
            if not len(third):
                break
            out.append(mixed((tokens[third] * _ODD + tokens[third + d]) * _ODD + tokens[third + e] + np.uint64(salt)))
    return out


def entries(grams: np.ndarray, levels: np.ndarray, bits: int, noise: float, percent: int = PERCENT) -> np.ndarray:
    """Index entries of a set: hashes of rare shingles and of combinations of frequent ones."""
    n = len(grams)
    # With one element more or less a set this small is not similar any more.
    if 100 * n < percent * (n + 1):
        return np.zeros(0, np.uint64)
    level = levels[sketch.slots_of(grams, bits)]
    classes = np.ones(n, np.int64)
    classes[level > np.log2(FREQUENT + noise)] = 2
    classes[level > np.log2(VERY_FREQUENT + noise)] = 3
    order = np.lexsort((grams, np.where(classes > 1, level, 0)))
    tokens, classes = grams[order], classes[order]
    spread = mixed(tokens)
    needed = n - (-(-percent * n // 100)) + 1
    power = n.bit_length() - 1
    powers = [power]
    if 100 * n >= percent << (power + 1):
        powers.append(power + 1)
    out = []
    for p in powers:
        count = max(1, (1 << p) // 8)
        groups = (spread % np.uint64(count)).astype(np.int64)
        gives = classes == 1
        for k in (2, 3):
            at = np.flatnonzero(classes == k)
            if len(at):
                by_group = np.argsort(groups[at], kind="stable")
                g = groups[at][by_group]
                nth = np.arange(len(g)) - np.searchsorted(g, g)
                gives[at[by_group]] = nth >= k - 1
        end = int(np.searchsorted(np.cumsum(gives), needed)) + 1
        head, kinds, own = tokens[:end], classes[:end], groups[:end]
        out.append(head[kinds == 1])
        for k in (2, 3):
            chosen = kinds == k
            if chosen.any():
                out += _combined(head[chosen], own[chosen], k, p * 8 + k)
    return np.unique(np.concatenate(out))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, root for every row.

    Documents with equal shingle sets are one class. ``root`` is the smallest class id a class is linked
    with; a document without words has no class.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"similarity must be {LEAST_PERCENT} percent or more")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    kind = dict(texts.dtypes)["doc_id"]

    def all_grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in bpe.slices(iter((batch,)), 0):
            yield np.concatenate([_hashed(t, width) for t in part.column(0).to_pylist()])

    counts = sketch.levels(texts.select("text"), all_grams, ORDER_BITS)
    # Mean count of a slot, which any shingle's count may hold besides its own.
    noise = float(np.median(counts.value[:: 1 << 8].astype(np.float64)))
    noise = 2.0**noise if noise > 1 else 0.0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in bpe.slices(batches, 1):
            sizes, digests, found, signs = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text, width)
                sizes.append(len(grams))
                digests.append(_digest(grams) if len(grams) else None)
                own = entries(grams, table, ORDER_BITS, noise, percent)
                found.append(own.view(np.int64))
                signs.append(linking.sign(grams).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(found, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "entries", "sign"],
            )

    rows = stored(
        workers.mapped(
            texts, index, f"doc_id {kind}, n_shingles bigint, digest binary, entries array<bigint>, sign array<bigint>"
        )
    )
    grouped = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("size")
    )
    known = numbered(grouped, "id")

    def all_entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).view(np.uint64)

    twice = sketch.repeated(rows.select("entries"), all_entries, REPEAT_BITS)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            parents = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
            stay = sketch.is_repeated(twice.value, values.view(np.uint64), REPEAT_BITS)
            ends = np.concatenate([[0], np.cumsum(np.bincount(parents[stay], minlength=len(column)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(values[stay]))],
                ["doc_id", "digest", "entries"],
            )

    likely = workers.mapped(
        rows.select("doc_id", "digest", "entries"), thinned, f"doc_id {kind}, digest binary, entries array<bigint>"
    ).filter("size(entries) > 0")
    heads = known.select("id", "size", F.col("digest").alias("head_digest"), "first_doc")
    is_head = (F.col("digest") == F.col("head_digest")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))
    buckets = stored(likely.join(heads, is_head).select("id", "size", F.explode("entries").alias("bucket")))

    signs = rows.filter("sign is not null").select("doc_id", "digest", "sign").join(heads, is_head).select("id", "sign")

    def fetch(ids: DataFrame) -> DataFrame:
        """(id, text) of a document of each class."""
        key = F.xxhash64("doc_id").alias("doc_key")
        wanted = heads.join(ids, "id", "left_semi").select("id", F.col("head_digest").alias("digest"),
                                                           F.xxhash64("first_doc").alias("doc_key"))
        wanted = stored(wanted)
        near = sketch.probably(texts.select("text", key), "doc_key", wanted)
        found = near.join(wanted, "doc_key").select("id", "text", "digest")
        return workers.mapped(found, own, "id bigint, text string")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A doc_id may have several rows: one with the class's shingles counts, once.
        seen: set[int] = set()
        for batch in batches:
            stay = []
            for row, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fine = row not in seen and _digest(shingles(text, width)) == digest
                stay.append(fine)
                if fine:
                    seen.add(row)
            yield batch.filter(pa.array(stay, pa.bool_())).select([0, 1])

    roots = linking.linked(buckets, signs, fetch, lambda t: shingles(t, width), percent, used=(buckets,))
    for table in (counts, twice):
        table.destroy()
    members = (
        rows.select("doc_id", "n_shingles", "digest")
        .join(known.select("digest", F.col("id").alias("class_id")), "digest", "left")
        .join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("root"))
    )
    return members


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    component_id is the smallest doc_id that links reach. A null or empty text, or one without words, has
    no shingle and is linked with nothing. Rows with equal texts are linked; a null doc_id is never the
    smallest unless it is alone. Other columns are not looked at; an empty table gives no row.
    """
    members = stored(classes(docs, width, percent))
    smallest = members.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return members.join(smallest, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_component(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The documents without those that links connect to a smaller doc_id, with their columns.

    Of rows with one doc_id all stay or go together; rows without doc_id and rows without words stay.
    """
    gone = joined(docs, width, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
