"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest Euclidean distance: vectors are divided by the largest norm and get one more
component that fills them up to length one, queries are divided by their own norm and get a zero there.
``PROJECTIONS`` Gaussian projections, cut into cells of width ``WIDTH``, give the bucket of a vector in each of
``TABLES`` tables. Of a neighbour with the similarity c that the query's own scores against a sample let expect,
each projection is normally distributed about c times the query's, so every bucket has an estimated chance to hold
it. A query visits a table's buckets in
the order of that chance until they add up to ``SUCCESS``. What the tables find is merged and scored exactly.

Buckets are split into blocks of ``BLOCK`` vectors, queries go to every block of their buckets, and a task
works through its blocks one after the other, so a bucket may hold any share of the rows. Equal vectors are one
entry with as many row ids as can ever be among a query's nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billsift.llm.common import numbered, stored

TABLES = 2
PROJECTIONS = 6
WIDTH = 2.0
#: Estimated chance, per table, that a neighbour is in a visited bucket. Neighbours closer than estimated are found
#: more often.
SUCCESS = 0.86
#: Rows that queries are scored against to estimate the similarity of their neighbours.
SAMPLE = 1000
BLOCK = 4096
SEED = 20
#: Cells of a projection: those about the middle, the outermost reach to infinity.
_LOWEST, _HIGHEST = -2, 2
_CELLS = _HIGHEST - _LOWEST + 1
_HELD = 400_000


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part: no null, not all zero, every component finite."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checked = rows.select("vec_id", vector.alias("embedding")).filter("vec_id is not null and embedding is not null")
    checked = checked.filter(fine & F.exists("embedding", lambda x: x != 0))
    # Vectors of the commonest length, if lengths differ.
    lengths = checked.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return checked.filter(F.size("embedding") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


class Tables:
    """The projections, the same for every task."""

    def __init__(self, dimension: int, largest: float, sample: np.ndarray, total: int, k: int):
        random = np.random.default_rng(SEED)
        self.largest = largest
        self.sample = sample
        self.total = total
        self.k = k
        self.directions = random.standard_normal((TABLES, dimension + 1, PROJECTIONS))
        self.offsets = random.random((TABLES, PROJECTIONS)) * WIDTH

    def _cells(self, table: int, projected: np.ndarray) -> np.ndarray:
        cells = np.floor((projected + self.offsets[table]) / WIDTH).astype(np.int64)
        return np.clip(cells, _LOWEST, _HIGHEST) - _LOWEST

    def _number(self, table: int, cells: np.ndarray) -> np.ndarray:
        return (cells @ (_CELLS ** np.arange(PROJECTIONS))) * TABLES + table

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """One bucket per table for every vector."""
        scaled = vectors / self.largest
        fill = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        extended = np.column_stack([scaled, fill])
        return np.stack(
            [self._number(t, self._cells(t, extended @ self.directions[t])) for t in range(TABLES)], axis=1
        )

    def probes(self, query: np.ndarray) -> np.ndarray:
        """Buckets a query visits, likeliest first within each table."""
        unit = query / math.sqrt(float(query @ query))
        similarity = _similarity(query, self.sample, self.largest, self.total, self.k)
        spread = math.sqrt(max(1e-6, 1.0 - similarity**2))
        out = []
        for t in range(TABLES):
            middle = similarity * (unit @ self.directions[t][:-1])
            chances = np.ones(1)
            for k in range(PROJECTIONS):
                cuts = (np.arange(_LOWEST + 1, _HIGHEST + 1) * WIDTH - self.offsets[t][k] - middle[k]) / spread
                reach = [0.0, *(0.5 * (1.0 + math.erf(z / math.sqrt(2.0))) for z in cuts), 1.0]
                per_cell = np.array([b - a for a, b in pairwise(reach)])
                chances = (per_cell[:, None] * chances[None, :]).reshape(-1)
            order = np.argsort(-chances, kind="stable")
            count = int(np.searchsorted(np.cumsum(chances[order]), SUCCESS)) + 1
            out.append(order[:count] * TABLES + t)
        return np.concatenate(out)


def _similarity(query: np.ndarray, sample: np.ndarray, largest: float, total: int, k: int) -> float:
    """Similarity that the k nearest of ``total`` to the query exceed, from the query's scores against the sample.

    The lower of two estimates, since scores of vectors in clusters have more than one peak: by mean and spread, and
    the sample's score at the same share from the top.
    """
    others = sample[(sample != query).any(axis=1)]
    if len(others) < 10:
        return 0.1
    scores = np.sort(others @ (query / (math.sqrt(float(query @ query)) * largest)))
    share = min(0.5, k / max(k + 1, total))
    normal = float(scores.mean() + scores.std() * NormalDist().inv_cdf(1.0 - share))
    ranked = float(scores[-min(len(scores), max(1, math.ceil(share * len(scores))))])
    return min(0.9, max(0.1, min(normal, ranked)))


def _merged(query: np.ndarray, entry: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best different entries of every query."""
    order = np.lexsort((entry, -score, query))
    query, entry, score = query[order], entry[order], score[order]
    same = np.zeros(len(query), bool)
    same[1:] = (query[1:] == query[:-1]) & (entry[1:] == entry[:-1])
    query, entry, score = query[~same], entry[~same], score[~same]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    best = nth < k
    return [query[best], entry[best], score[best]]


def nearest(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for every query row.

    ``is_query`` is a condition on vec_id. A query's own id is no candidate; ties go to the smaller vec_id. A null
    vec_id, and a vector that is null, zero or holds a null or non-finite component, takes no part. Equal
    rows are one row. Other columns are not looked at; an empty table gives no row.
    """
    spark = rows.sparkSession
    usable = valid(rows).distinct()
    # k + 1 of the rows with one vector are enough: ties go to the smallest ids, and one may be the query.
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.withColumn("nth", F.row_number().over(by_vector)).filter(F.col("nth") <= k + 1)
    listed = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # Numbered in the order of their smallest ids.
    entries = numbered(
        listed.repartitionByRange(F.element_at("ids", 1)).sortWithinPartitions(F.element_at("ids", 1)), "entry"
    )
    norms = entries.select(
        F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.size("embedding").alias("n")
    ).agg(F.max("norm").alias("norm"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not norms["rows"]:
        return spark.createDataFrame([], schema)
    sample = entries.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("embedding").toArrow().column(0)
    tables = Tables(norms["n"], norms["norm"], _matrix(sample.combine_chunks()), norms["rows"], k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = tables.buckets(_matrix(batch.column(1)))
                at = pa.array(np.repeat(np.arange(batch.num_rows), TABLES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.reshape(-1)), batch.column(0).take(at), batch.column(1).take(at)],
                    ["bucket", "id", "embedding"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                found = [tables.probes(q) for q in _matrix(batch.column(1))]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), batch.column(0).take(at), batch.column(1).take(at)],
                    ["bucket", "id", "embedding"],
                )

    layout = "bucket bigint, id bigint, embedding array<double>"
    placed = stored(entries.select("entry", "embedding").mapInArrow(index, layout))
    blocks = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    queries = usable.filter(is_query)
    asked = numbered(queries.select("embedding").distinct(), "query")
    visits = asked.select("query", "embedding").mapInArrow(probe, layout)
    held = placed.join(blocks, "bucket").select(
        "bucket", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "embedding"
    )
    sent = visits.join(blocks, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "embedding"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors = None, [], []
        query, entry, score, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (query, entry, score)], ["query", "entry", "score"]
            )

        for batch in batches:
            buckets = batch.column(0).to_numpy() * 2**20 + batch.column(1).to_numpy()
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            keys, matrix = batch.column(3).to_numpy(), _matrix(batch.column(4)) if batch.num_rows else None
            cuts = np.flatnonzero((np.diff(buckets) != 0) | (asks[1:] != asks[:-1])) + 1
            for start, stop in pairwise([0, *cuts, len(keys)]):
                if start == stop:
                    continue
                if block != buckets[start]:
                    block, ids, vectors = buckets[start], [], []
                if not asks[start]:
                    ids.append(keys[start:stop])
                    vectors.append(matrix[start:stop])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                for first in range(start, stop, 256):
                    some = matrix[first : min(stop, first + 256)]
                    found = some @ vectors[0].T
                    best = (
                        np.argpartition(-found, k, axis=1)[:, : k + 1] if found.shape[1] > k + 1
                        else np.tile(np.arange(found.shape[1]), (len(some), 1))
                    )
                    q = np.repeat(np.arange(len(some)), best.shape[1])
                    e = best.reshape(-1)
                    query.append(keys[first : first + len(some)][q])
                    entry.append(ids[0][e])
                    # Summed alike for every pair, whatever the block.
                    score.append((some[q] * vectors[0][e]).sum(axis=1))
                    size += len(q)
                if size > _HELD:
                    query, entry, score = ([c] for c in _merged(*map(np.concatenate, (query, entry, score)), k + 1))
                    size = len(query[0])
                    if size > _HELD // 2:
                        yield out()
                        query, entry, score, size = [], [], [], 0
        if size:
            query, entry, score = ([c] for c in _merged(*map(np.concatenate, (query, entry, score)), k + 1))
            yield out()

    found = (
        held.unionByName(sent).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
        .mapInArrow(search, "query bigint, entry bigint, score double")
    )
    # A table finds an entry once at most; the best are cut before anything is joined to them.
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = found.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= (k + 1) * TABLES)
    best = best.dropDuplicates(["query", "entry"]).select("query", "entry", "score")
    best_entries = best.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    best_rows = best_entries.withColumn(
        "nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ).filter(F.col("nth") <= k + 1)
    lists = best_rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    # A vector may be asked for by many ids; each leaves itself out of the common list.
    return (
        queries.select(F.col("vec_id").alias("query_id"), "embedding")
        .join(asked, "embedding")
        .join(lists, "query")
        .select(
            "query_id",
            F.posexplode(
                F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
            ).alias("place", "hit"),
        )
        .select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
    )
