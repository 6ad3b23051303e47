import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from billsift.llm import queries, ranked
from tests.llm import brute

ITEMS = "item_id bigint, text string"


@pytest.fixture(scope="module")
def items(corpus):
    r = random.Random(3)
    out = [(n, " ".join(r.sample((t or "none").split() or ["none"], 1) * 2 + (t or "").split()[:40])) for n, (_, t, _, _) in enumerate(corpus)]
    return [*out, out[0], (0, "One two THREE"), (None, "words in it; a line"), (99, None), (98, "nowhere-found"), (97, "é ñ 日本語")]


def _rows(frame):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("shard", "block"), [(8192, 16_000_000), (5, 2000)])
def test_ranks_equal_brute_force(spark, clashing, corpus, items, monkeypatch, shard, block):
    """Also in many shards of a task and many blocks of items."""
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    asked = spark.createDataFrame(items, ITEMS).withColumns({n: F.lit(n) for n in ("rank", "score", "doc_id", "item")})
    expected = brute.ranked_documents([(d, t) for d, t, _, _ in corpus], items, 7)
    assert _rows(ranked.ranked(clashing, asked, top=7)) == sorted(expected, key=str)


def test_equal_scores_and_long_items(spark):
    r = random.Random(1)
    docs = [(n, "same text here" if n % 3 else f"word{r.randint(0, 300)} text") for n in range(900)] + [(5, "same text here")] * 60
    items = [(1, "text"), (2, "same here"), (3, " ".join(f"word{n}" for n in range(20_000)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    found = _rows(ranked.ranked(frame, spark.createDataFrame(items, ITEMS)))
    # "text" is in every document and weighs nothing.
    assert found == sorted(brute.ranked_documents(docs, items, 50), key=str) and len(found) == 100


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_bounds_of_one_shard(monkeypatch, stretch):
    """The lists give the best documents with final scores from any stretch of reads."""
    monkeypatch.setattr(ranked, "STRETCH", stretch)
    r = np.random.default_rng(2)
    docs, terms = 300, 12
    pairs = np.unique(np.stack([r.integers(0, docs, 1500), r.integers(0, terms, 1500) ** 2 // terms], 1), axis=0)
    doc, term = pairs.T
    count = r.integers(1, 6, len(pairs))
    length = r.integers(20, 200, docs)
    weights = r.integers(0, 3000, terms)
    shard = ranked._Lists(doc, term, count, length, weights, docs, int(length.sum()))
    m = 50 + 50 * length * docs // int(length.sum())
    scores = np.zeros(docs, np.int64)
    np.add.at(scores, doc, weights[term] * (10**9 * count // (1000 * count + 20 * m[doc])))
    bar = np.sort(scores)[-20]
    for floor in (0, int(bar) + 1):
        found, given = shard.best(np.arange(terms), 20, floor)
        assert (scores[found] == given).all()
        assert set(np.flatnonzero(scores >= max(bar, floor, 1))) <= set(found.tolist())


def test_term_weights():
    assert ranked.term_weight(1000, 1) == math.floor(1000 * math.log(2002 / 3)) and ranked.term_weight(10, 10) == 46


def test_no_rows(spark, docs, none):
    no_items = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "word")], ITEMS)
    for a, b in ((none, one), (docs, no_items), (none, no_items)):
        found = ranked.ranked(a, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_query_equals_its_sql(spark, docs, items, tmp_path):
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    relation = connection.sql(queries.STATEMENTS["op12_ranked_search"])
    expected = sorted(relation.select("item_id, rank, doc_id, score").fetchall(), key=str)
    assert _rows(queries.op12_ranked_search(spark, str(tmp_path))) == expected and len(expected) > 100
