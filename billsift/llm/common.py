"""What several corpus operators share: tables, stored intermediates, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.session import cut_lineage, discard

#: White space of the word definition: blank, tab, line feed, vertical tab, form feed, return.
WORD_GAPS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back."""
    return cut_lineage(df)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with a unique number, stored so that the numbers stay."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node it reaches.

    Alternating stars: each node hands its larger neighbours to the smallest node it knows, then its
    smaller ones, until every node hangs on its root. Both steps are a combining minimum and an
    equality join, so a node of any degree is spread over tasks. Each round is stored, and the number
    of rounds grows with the logarithm of the longest path.
    """
    links = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = stored(large)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        fresh = stored(small)
        # Done when every node has one parent and no parent is a child.
        state = fresh.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
        ).first()
        before = links.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
        ).first()
        # A round needs nothing of the one before once it is stored.
        discard(links, large)
        links = fresh
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
