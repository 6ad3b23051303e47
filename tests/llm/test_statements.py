import math

import duckdb
import pytest
from pyspark.sql import functions as F

from billsift.llm import queries


@pytest.mark.parametrize("name", ["op10_source_mix", "op6_quality_rules", "op9_shingle_join"])
def test_query_equals_its_sql(spark, docs, tmp_path, name):
    # Rows with one doc_id are one node of the join and two rows in SQL: each document once.
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    # Enough labelled copies of odd and plain texts for cutoffs to pass their test.
    many = once.filter("length(text) > 200 and length(text) < 5000").limit(12).crossJoin(spark.range(160).withColumnRenamed("id", "n"))
    more = many.select(
        (F.col("doc_id") * 1000 + F.col("n") + 10_000).alias("doc_id"),
        F.when(F.col("n") % 8 == 0, F.regexp_replace("text", "([a-e]) ", "$1### "))
        .otherwise(F.concat(F.lit("x"), F.col("n").cast("string"), F.lit(" "), F.col("text"))).alias("text"),
        F.lit("en").alias("lang"), "source", "n_chars",
    )
    table = once if name == "op9_shingle_join" else once.unionByName(more)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    more.select("doc_id", F.when(F.col("text").contains("###"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")) \
        .write.parquet(f"{tmp_path}/labels.parquet")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    for t in ("documents", "labels"):
        connection.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    relation = connection.sql(queries.STATEMENTS[name])
    expected = sorted(relation.select(", ".join(frame.columns)).fetchall())
    found = sorted(tuple(r) for r in frame.collect())
    assert len(found) == len(expected) > 0
    for a, b in zip(found, expected, strict=True):
        assert all(x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True)), (a, b)
    if name == "op6_quality_rules":
        assert sum(not r[-1] and not r[-2] for r in found) > 50
