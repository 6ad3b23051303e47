"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.llm import ann, bpe, edits, line_dedup, mixing, packed, packing, pii, quality, ranked, repeats, shingle_join, statements, turns
from billsift.llm.common import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.removals(table(spark, folder, "documents"))


def op2_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(table(spark, folder, "documents"))


def op3_bpe_coding(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.transcode(table(spark, folder, "documents"), VOCABULARY))


def op4_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = packed.new_folder(spark)
    packed.write(table(spark, folder, "documents"), VOCABULARY, files)
    return packed.digests(spark, files)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.reported(table(spark, folder, "documents"))


def op8_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edits.counts(edits.planned_edits(table(spark, folder, "documents")), VOCABULARY)


def op9_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.joined(table(spark, folder, "documents"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def op11_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.packed(table(spark, folder, "documents"), BYTE_VOCABULARY))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return turns.digests(turns.damaged(rows), rows.select("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_repeated_passages, op3_bpe_coding, op4_nearest_vectors, op5_packed_ids, op6_quality_rules, op7_personal_data, op8_edit_counts, op9_shingle_join, op10_source_mix, op11_retrieval_packing, op12_ranked_search, op13_turn_repair)
}

STATEMENTS: dict[str, str] = {
    "op6_quality_rules": statements.quality_rules(),
    "op9_shingle_join": statements.shingle_join(),
    "op10_source_mix": statements.source_mix(),
    "op12_ranked_search": statements.ranked_search(),
    "op13_turn_repair": statements.turn_repair(),
}
