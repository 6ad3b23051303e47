"""Ranked lexical search: the highest-scoring documents of every item, by sequential reads alone (NRA).

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. Scores are
integers: a term's weight is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``, its impact on a document
``weight * ((10^9 tf) div (1000 tf + 20 m))`` with ``m = 50 + (50 n N) div L``, and a document's score the
sum of the impacts of the item's distinct terms.

Documents are read once: each becomes a short row with its number of terms and the counts of those terms
that some item has. Statistics are sums over these rows. Then every task takes its rows in shards of
bounded size, builds the impact-sorted lists of a shard, and answers every item from them:

* All lists of an item are read from the top, a stretch at a time. A document's lower bound is the sum
  of the impacts read for it, its upper bound adds the next unread impact of every list it has not yet
  been met in. Nothing is looked up out of order.
* Documents whose upper bound falls below the lowest lower bound of the best ``top`` (or of the best of
  earlier shards of the task) are dismissed. Reading goes on until no unmet document can reach them and
  both bounds of all that remain agree, so membership, ties and scores are final.

The best of each task are merged per item. Items are taken in blocks whose terms have a bounded size, so
what is sent to the tasks does not grow with the number of items; each block reads the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billsift.llm.common import stored

#: Documents returned per item.
TOP = 50
#: Documents of one shard, and entries of its lists at most unless a single document has more.
SHARD_DOCS = 8192
SHARD_ENTRIES = 4_000_000
#: Bytes of the distinct terms of a block of items, beyond which the next block begins.
BLOCK_BYTES = 16_000_000
#: Entries of each list that the first stretch of reads takes; later ones take twice as many.
STRETCH = 32

_LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.translate(_LETTERS).split()


def term_weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class _Lists:
    """The impact-sorted lists of one shard; documents are numbered in the order that breaks ties."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, weights: np.ndarray, docs: int, total: int):
        self.docs = len(length)
        m = 50 + (50 * length * docs) // max(total, 1)
        impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        order = order[impact[order] > 0]
        self.term, self.doc, self.impact = term[order], doc[order], impact[order]

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.term, [term, term + 1])
        return self.doc[low:high], self.impact[low:high]

    def best(self, wanted: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the best ``top``, with final scores.

        ``floor`` is a score that documents must reach to matter.
        """
        lists = [x for x in map(self.of, wanted.tolist()) if len(x[0])]
        lower = np.zeros(self.docs, np.int64)
        open_ = np.arange(self.docs)
        at, stretch = 0, STRETCH
        while True:
            for doc, impact in lists:
                lower[doc[at : at + stretch]] += impact[at : at + stretch]
            at, stretch = at + stretch, stretch * 2
            # What a document may still gain: the next unread impact of each list it was not met in.
            frontier = [int(impact[at]) if at < len(impact) else 0 for _, impact in lists]
            gain = np.full(self.docs, sum(frontier), np.int64)
            for (doc, _), ahead in zip(lists, frontier, strict=True):
                if ahead:
                    gain[doc[:at]] -= ahead
            scores, gains = lower[open_], gain[open_]
            bar = max(floor, 1)
            if len(scores) >= top:
                bar = max(bar, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
            near = scores + gains >= bar
            open_ = open_[near]
            if not gains[near].any():
                return open_, lower[open_]


def _counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), term and tf (binary, unsigned 32-bit) of the known terms. Stored."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            lengths, held, counts = [], [], []
            for text in batch.column(1):
                words = terms(text.as_buffer().to_pybytes())
                found = Counter(map(number, words))
                found.pop(None, None)
                lengths.append(len(words))
                held.append(np.fromiter(found.keys(), "<u4", len(found)).tobytes())
                counts.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "n", "term", "tf"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    out = stored(rows.mapInArrow(run, "doc_id long, n long, term binary, tf binary").filter("n > 0"))
    sent.destroy()
    return out


def _holding(counted: DataFrame, size: int) -> np.ndarray:
    """Documents per term: one sum per task and term before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column(0):
                sums[np.frombuffer(held.as_buffer(), "<u4")] += 1
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["term", "docs"])

    out = np.zeros(size, np.int64)
    # One row per term of the block.
    for row in counted.select("term").mapInArrow(run, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[row["term"]] = row["docs"]
    return out


def _best_of_tasks(counted: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, docs: int, total: int, top: int) -> DataFrame:
    """item, doc_id, score: the best of every task for every item."""
    spark = counted.sparkSession
    sent = spark.sparkContext.broadcast((wanted, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        ends = np.iinfo(np.int64).max
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
        ids, lengths, held, counts = [], [], [], []

        def answer() -> None:
            # Equal scores are ordered by doc_id, null last.
            null = np.array([i is None for i in ids])
            key = np.array([ends if i is None else i for i in ids], np.int64)
            order = np.lexsort((key, null))
            sizes = np.array([len(held[i]) // 4 for i in order])
            shard = _Lists(
                np.repeat(np.arange(len(order)), sizes),
                np.frombuffer(b"".join([held[i] for i in order]), "<u4").astype(np.int64),
                np.frombuffer(b"".join([counts[i] for i in order]), "<u4").astype(np.int64),
                np.array(lengths, np.int64)[order], weight, docs, total,
            )
            key, null = key[order], null[order]
            for n, item in enumerate(items):
                known, known_null, scores = best[n]
                found, score = shard.best(item, top, int(scores[-1]) if len(scores) >= top else 0)
                keys, nulls = np.append(known, key[found]), np.append(known_null, null[found])
                scores = np.append(scores, score)
                keep = np.lexsort((keys, nulls, -scores))[:top]
                best[n] = keys[keep], nulls[keep], scores[keep]
            for part in (ids, lengths, held, counts):
                part.clear()

        entries = 0
        for batch in batches:
            for doc_id, n, term, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                lengths.append(n)
                held.append(term)
                counts.append(tf)
                entries += len(term) // 4
                if len(ids) >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                    answer()
                    entries = 0
        if ids:
            answer()
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(items), dtype=np.int32), sizes)),
                    pa.array(np.concatenate([b[0] for b in best]), mask=np.concatenate([b[1] for b in best])),
                    pa.array(np.concatenate([b[2] for b in best])),
                ],
                names=["item", "doc_id", "score"],
            )

    return counted.filter(F.octet_length("term") > 0).mapInArrow(run, "item int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """(item_ids, distinct term numbers per item, numbers of the terms) of one block after the other."""
    ids, wanted, known, size = [], [], {}, 0
    for row in items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).toLocalIterator():
        held = []
        for term in dict.fromkeys(terms(bytes(row["text"]))):
            if term not in known:
                known[term] = len(known)
                size += len(term)
            held.append(known[term])
        ids.append(row["item_id"])
        wanted.append(held)
        size += 8 * len(held)
        if size >= BLOCK_BYTES:
            yield ids, wanted, known
            ids, wanted, known, size = [], [], {}, 0
    if ids:
        yield ids, wanted, known


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` documents with the highest scores above 0.

    Equal scores are ordered by ascending doc_id, a null doc_id last. Every row of the documents is one
    document, so repeated rows appear side by side; equal rows of the items are one item, and items with
    the same id and different texts are ranked apart. A null text has no terms: such an item, like one
    without a match, returns no row. Other columns play no part. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    asked = stored(items.select("item_id", "text").distinct())
    found: DataFrame | None = None
    for ids, wanted, known in _blocks(asked):
        counted = _counted(docs, known)
        totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        holding = _holding(counted, len(known))
        weights = np.array([term_weight(totals["docs"], h) if h else 0 for h in holding.tolist()], np.int64)
        lists = [np.array(w, np.int64) for w in wanted]
        best = stored(_best_of_tasks(counted, lists, weights, totals["docs"], totals["total"], top))
        # One row per item of the block.
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        place = F.row_number().over(
            Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        )
        rows = best.withColumn("rank", place).filter(F.col("rank") <= top).join(F.broadcast(names), "item")
        rows = rows.select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else stored(found).unionByName(rows)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return found
