"""Components of similar texts, from buckets of texts that may be similar.

Two texts that share a bucket are compared exactly unless they are connected already. First every text
is compared with one other, the smallest of the bucket it shares most with; then with the
smallest of each bucket whose component differs; what then still shares a bucket across components is
compared in full. A group of copies is therefore joined by one comparison per copy, and no link between
components is lost.

Every text has a sign: for each of some slots, whether the number of its grams there is odd. Where two signs differ
lies a gram that only one of the texts has, so signs that differ in more slots than the similarity leaves room for
exclude a pair, and nothing similar is lost. Pairs are excluded inside the join that makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.llm import workers
from billsift.llm.common import components, stored
from billsift.session import discard

Grams = Callable[[str], np.ndarray]

#: Slots of a sign.
SIGN_BITS = 1024
_WORD_BITS = 64
#: In buckets of more rows than ``BUSY`` a pair is told once, by the first of ``FIRSTS`` such buckets of each text.
BUSY = 16
FIRSTS = 16


def sign(grams: np.ndarray, bits: int = SIGN_BITS) -> np.ndarray:
    """The sign of distinct gram hashes, as 64-bit words. Slots are the hashes' top bits; ``bits`` is a power of two."""
    slots = (grams >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    odd = (np.bincount(slots, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def may_be_similar(one: Column, other: Column, sizes: Column, bits: int, percent: int) -> Column:
    """Whether two signs leave room for the similarity; sizes: grams of both texts together.

    Sets of that similarity differ in a share of (100 - percent) / (100 + percent) of both sizes at most.
    """
    differing = sum((F.bit_count(one[k].bitwiseXOR(other[k])) for k in range(bits // _WORD_BITS)), F.lit(0))
    return differing * (100 + percent) <= sizes * (100 - percent)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def compared(pairs: DataFrame, texts: DataFrame, grams: Grams, percent: int) -> DataFrame:
    """Pairs (a, b) with ``similar``: 100 * shared grams >= percent * all grams. texts: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            found = kept.get(text)
            if found is None:
                found = grams(text)
                if len(kept) >= 64:
                    kept.clear()
                kept[text] = found
            return found

        for batch in batches:
            similar = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(one), grams(other)
                both = _shared(x, y)
                similar.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar)], ["a", "b", "similar"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return workers.mapped(both, run, "a bigint, b bigint, similar boolean")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id")
    )


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def linked(
    buckets: DataFrame,
    signs: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    grams: Grams,
    percent: int,
    bits: int = SIGN_BITS,
    used: tuple[DataFrame, ...] = (),
) -> DataFrame:
    """(node, root) of every text with a link.

    buckets: (bucket, id, size); a pair is compared only if the smaller size has the share of the larger that
    the similarity asks for. signs: (id, sign) of every id, repeated or not, words of ``bits`` slots. ``fetch`` gives (id, text) for ids.
    ``used``: stored tables that buckets and signs are read from and nothing else; they are discarded.
    """

    def fits(one: str, other: str) -> Column:
        return 100 * F.least(one, other) >= percent * F.greatest(one, other)

    def signed(one: str, other: str) -> Column:
        sizes = F.col(f"{one}_size").cast("bigint") + F.col(f"{other}_size")
        return may_be_similar(F.col(f"{one}_sign"), F.col(f"{other}_sign"), sizes, bits, percent)

    # Buckets of the same texts say the same: one of them stays, known by its count and two sums of hashes.
    hashed = F.xxhash64("id")
    shared = (
        buckets.groupBy("bucket").agg(
            F.min(F.struct("id", "size")).alias("least"),
            F.max("id").alias("top"),
            F.count(F.lit(1)).alias("n"),
            F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("low"),
            F.sum(F.shiftrightunsigned(hashed, 32)).alias("high"),
        )
        .filter(F.col("least.id") < F.col("top"))
        .dropDuplicates(["n", "low", "high"])
        .select("bucket", "least")
    )
    # The choice among equal buckets is made once.
    shared = stored(shared)
    with_least = stored(
        buckets.join(shared, "bucket")
        .select("bucket", "id", "size", F.col("least.id").alias("a"), F.col("least.size").alias("a_size"))
    )
    signs = stored(
        signs.join(with_least.select("id").distinct(), "id", "left_semi").select("id", "sign").dropDuplicates(["id"])
    )
    discard(shared, *used)
    votes = (
        with_least.filter(F.col("id") > F.col("a")).filter(fits("size", "a_size"))
        .groupBy("a", F.col("id").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.first("a_size").alias("a_size"), F.first("size").alias("b_size")
        )
    )
    ready = stored(
        votes.join(signs.select(F.col("id").alias("b"), F.col("sign").alias("b_sign")), "b")
        .join(signs.select(F.col("id").alias("a"), F.col("sign").alias("a_sign")), "a")
        .filter(signed("a", "b"))
        .select("a", "b", "n")
    )
    texts = stored(fetch(ids_of(ready)))
    # First turn: the smallest of the bucket that a text shares most with.
    best = ready.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("m"))).alias("best")).select(
        (-F.col("best.m")).alias("a"), "b"
    )
    first_tested = stored(compared(best, texts, grams, percent))
    tested = first_tested
    first_roots = stored(components(tested.filter("similar").select("a", "b")))
    roots = first_roots
    # Second turn: the smallest of every bucket against members of other components.
    pairs = (
        _labelled(ready.select("a", F.col("b").alias("id")), roots)
        .join(roots.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a", "left")
        .filter(F.col("root") != F.coalesce("a_root", "a"))
        .select("a", F.col("id").alias("b"))
        .join(tested, ["a", "b"], "left_anti")
    )
    tested = stored(tested.unionByName(compared(pairs, texts, grams, percent)))
    discard(first_tested, first_roots, ready, texts)
    found = tested.filter("similar").select("a", "b")
    roots = stored(components(found))
    # Third turn: all that still shares a bucket across components, but for pairs with its smallest.
    rows = _labelled(with_least.select("bucket", "id", "size", F.col("a").alias("least")), roots)
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    open_rows = stored(
        rows.filter(F.col("id") != F.col("least")).join(mixed.select("bucket"), "bucket", "left_semi")
        .select("bucket", "id", "size", "root")
    )
    busy = open_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUSY)
    firsts = open_rows.join(busy, "bucket", "left_semi").groupBy("id").agg(
        F.slice(F.sort_array(F.collect_set("bucket")), 1, FIRSTS).alias("firsts")
    )
    marks = stored(open_rows.select("id").distinct().join(signs, "id").join(firsts, "id", "left"))
    discard(with_least, signs)
    known = open_rows.join(marks, "id")

    def side(name: str) -> DataFrame:
        return known.select("bucket", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "size", "root", "sign", "firsts")])

    # Texts that share many large buckets would meet in each of them.
    told = F.array_min(F.array_intersect("a_firsts", "b_firsts"))
    crossing = stored(
        side("a").join(side("b"), "bucket")
        .filter("a_id < b_id and a_root <> b_root")
        .filter(fits("a_size", "b_size"))
        .filter(signed("a", "b"))
        .filter(F.col("bucket") == F.coalesce(told, "bucket"))
        .select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        .distinct()
    )
    last = stored(crossing.join(tested, ["a", "b"], "left_anti"))
    discard(open_rows, marks, crossing)
    if last.isEmpty():
        return roots
    last = compared(last, fetch(ids_of(last)), grams, percent)
    return stored(components(found.unionByName(last.filter("similar").select("a", "b"))))
