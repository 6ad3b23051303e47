"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in hashed order, form one stream that repeats when it is used up.
The schedule is the golden-ratio sequence: slot i draws the source in whose stretch of the cumulated
targets the fractional part of i times the golden ratio lies, so every source comes up evenly from
the first slot on. A slot takes its source's next block; blocks of a source have equal numbers of words,
chosen so that its slots take its target exactly.

Everything is DataFrame work. Running sums and ranks go in two levels (within buckets of about the
square root of the rows, then over bucket totals), so that a source with any share of the rows is
spread over tasks. The list of sources itself, one row per source, is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billsift.llm.common import WORD_GAPS, numbered, stored

#: Words of a slot, about.
BLOCK_WORDS = 512
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this, counted in its own size.
MOST_EPOCHS = 3
SEED = "mix-1"
GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0
_CHUNK = 65_536
_CELLS = 4096
_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_GAPS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_no, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn. They share the sum of all sizes by weight;
    a source whose share is above ``most`` times its size stops there and the rest is shared again. That
    is: sources in the order of size over weight stop, one after the other, until the common level fits.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)) + 1)
    listed = sizes.withColumn("source_no", number).withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * float(most)
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    # Stopping a source below the level raises it for the rest, stopping one above would lower it:
    # the common level is the highest.
    leveled = listed.withColumn("level", level)
    return leveled.withColumn("common", F.max("level").over(everything)).select(
        "source", "source_no", "source_size", F.least("cap", F.col("common") * F.col("weight")).alias("target")
    )


def _sized(docs: DataFrame) -> DataFrame:
    """Rows with their word count and hashed order, numbered and stored without texts."""
    return numbered(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _place().alias("place")), "row_no"
    )


def _place() -> Column:
    """Order of a document in its source; equal for rows with equal doc_id and text."""
    tie = F.md5(F.coalesce("text", F.lit("")))
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), tie))


def _streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Place of every document with words in its source's stream: row_no, source_no, size, start."""
    rows = sized.filter("size > 0")
    buckets = max(1, math.isqrt(rows.count()))
    bucket = F.expr(f"cast(conv(substr(place, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    keyed = rows.join(
        sources.select(F.col("source").alias("known"), "source_no"), F.col("source").eqNullSafe(F.col("known"))
    ).select("row_no", "source_no", "size", "place", bucket.alias("bucket"))
    within = Window.partitionBy("source_no", "bucket").orderBy("place", "row_no")
    local = keyed.withColumn("upto", F.sum("size").over(within))
    totals = keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    ahead = totals.select(
        "source_no",
        "bucket",
        (F.sum("held").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("held")).alias("base"),
    )
    return local.join(ahead, ["source_no", "bucket"]).select(
        "row_no", "source_no", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start")
    )


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source_no, rank): the source of every slot and how many slots it had before.

    A source with a target of a word or more that no point falls on gets one slot at the end.
    """
    spark = sources.sparkSession
    wanted = sources.filter("floor(target) >= 1").select("source_no", "target")
    total = wanted.agg(F.sum("target")).first()[0] or 0.0
    slots = math.ceil(total / block_words)
    order = Window.orderBy("source_no")
    share = wanted.select(
        "source_no",
        ((F.sum("target").over(order) - F.col("target")) / total).alias("low"),
        (F.sum("target").over(order) / total).alias("high"),
        F.row_number().over(Window.orderBy(F.col("source_no").desc())).alias("from_last"),
    ).select("source_no", "low", F.when(F.col("from_last") == 1, F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    cells = share.select(
        "source_no",
        "low",
        "high",
        F.explode(
            F.sequence(F.floor(F.col("low") * _CELLS), F.floor(F.least(F.col("high"), F.lit(1.0)) * _CELLS))
        ).alias("cell"),
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN!r}D % 1.0D").alias("point")
    ).withColumn("cell", F.floor(F.col("point") * _CELLS))
    drawn = points.join(cells, "cell").filter("low <= point and point < high").select(
        "slot", "source_no", F.expr(f"slot div {_CHUNK}").alias("chunk")
    )
    per_chunk = drawn.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("held"))
    ahead = per_chunk.select(
        "source_no",
        "chunk",
        (F.sum("held").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("held")).alias("base"),
    )
    ranked = drawn.withColumn(
        "nth", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot"))
    ).join(ahead, ["source_no", "chunk"]).select("slot", "source_no", (F.col("base") + F.col("nth") - 1).alias("rank"))
    missed = wanted.join(per_chunk, "source_no", "left_anti").select(
        (F.lit(slots) + F.col("source_no")).cast("bigint").alias("slot"), "source_no", F.lit(0).cast("bigint").alias("rank")
    )
    return ranked.unionByName(missed)


def pieces(sized: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, source_no, row_no, epoch, first_word, n_words; a row per document and slot."""
    slots = stored(schedule(sources, block_words))
    held = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("blocks"))
    plan = sources.select("source_no", "source_size", F.floor("target").cast("bigint").alias("quota")).join(
        held, "source_no"
    )
    streams = _streams(sized, sources).join(plan, "source_no")
    epochs = streams.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)))).select(
        "row_no", "source_no", "quota", "blocks", "epoch",
        (F.col("start") + F.col("epoch") * F.col("source_size")).alias("head"),
        F.least(F.col("start") + F.col("size") + F.col("epoch") * F.col("source_size"), F.col("quota")).alias("tail"),
    ).filter("head < tail")

    def rank_of(place: str) -> Column:
        """Block of a place: block r holds the words from r * quota div blocks on."""
        return F.expr(
            f"cast((cast({place} + 1 as {_WIDE}) * cast(blocks as {_WIDE}) - 1) div cast(quota as {_WIDE}) as bigint)"
        )

    cut = epochs.withColumn("rank", F.explode(F.sequence(rank_of("head"), rank_of("tail - 1"))))

    def edge(rank: str) -> Column:
        return F.expr(
            f"cast(cast({rank} as {_WIDE}) * cast(quota as {_WIDE}) div cast(blocks as {_WIDE}) as bigint)"
        )

    spans = cut.withColumn("first", F.greatest("head", edge("rank"))).withColumn(
        "last", F.least("tail", edge("rank + 1"))
    )
    return slots.join(spans, ["source_no", "rank"]).select(
        "slot", "source_no", "row_no", "epoch",
        (F.col("first") - F.col("head")).alias("first_word"), (F.col("last") - F.col("first")).alias("n_words"),
    )


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size, sources with targets, pieces of the mix).

    A null text has size 0 and is never taken; a null source is a source of its own; repeated rows count
    each. An empty table, or one without words, gives an empty mix. Other columns are not looked at.
    """
    sized = _sized(docs)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes))
    return sized, sources, pieces(sized, sources, block_words)


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix) for every row."""
    sized, sources, mix = mixed(docs, block_words)
    per_row = mix.groupBy("row_no").agg(F.sum("n_words").alias("taken"))
    known = sources.select(F.col("source").alias("known"), "source_size", "target")
    return (
        sized.join(known, F.col("source").eqNullSafe(F.col("known")))
        .join(per_row, "row_no", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def repeated(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix with their columns: a row for every pass over its source that takes from it.

    Rows with equal doc_id and text are repeated alike.
    """
    sized, _, mix = mixed(docs, block_words)
    passes = mix.groupBy("row_no").agg(F.count_distinct("epoch").cast("int").alias("passes"))
    per_place = sized.select("row_no", "place").join(passes, "row_no").groupBy("place").agg(F.max("passes").alias("passes"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), _place().alias("place"))
    return (
        rows.join(per_place, "place")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("nth"))
        .select("row.*")
    )
