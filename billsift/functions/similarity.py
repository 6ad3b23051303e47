"""Similarity of invoice numbers as Spark columns.

The ratio is 200 * LCS / (length a + length b), the better of the plain texts and
of the texts with their white-space tokens sorted. Arguments are column names, so
that an expression mentions a column instead of repeating how it was computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: two numbers are near when the ratio, rounded to two decimals, reaches this.
NEAR_THRESHOLD = 90.0
# Smallest unrounded share that rounds up to the threshold.
_SHARE = 0.89995
_WORD = 62


def _lcs_bits(a: str, b: str) -> str:
    """LCS with the row for ``a`` held in the bits of one number, one step per character of ``b``."""
    places = (
        f"aggregate(sequence(0, length({a}) - 1), 0L,"
        f" (x, i) -> x | if(substr({a}, i + 1, 1) = c, shiftleft(1L, i), 0L))"
    )
    return (
        f"length({a}) - bit_count(aggregate(transform(split({b}, ''), c -> {places}),"
        f" shiftleft(1L, length({a})) - 1,"
        f" (v, m) -> ((v + (v & m)) | (v & ~m)) & (shiftleft(1L, length({a})) - 1)))"
    )


def _lcs_rows(a: str, b: str) -> str:
    """LCS row by row, for texts longer than one number has bits."""
    best = (
        f"greatest(row[j], element_at(done, -1),"
        f" row[j - 1] + if(substr({a}, j, 1) = c, 1, 0))"
    )
    return (
        f"element_at(aggregate(split({b}, ''), array_repeat(0, length({a}) + 1),"
        f" (row, c) -> aggregate(sequence(1, length({a})), array(0),"
        f" (done, j) -> array_append(done, {best}))), -1)"
    )


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two columns.

    A small edit distance settles it without the table: as many edits as the lengths
    differ are all insertions, one edit at equal lengths is one replacement, and two
    edits at lengths one apart are a replacement and an insertion.
    """
    edits, apart = f"levenshtein({a}, {b})", f"abs(length({a}) - length({b}))"
    shorter = f"least(length({a}), length({b}))"
    return F.expr(
        f"case when length({a}) = 0 or length({b}) = 0 then 0"
        f" when {edits} = {apart} then {shorter}"
        f" when {edits} = 1 or ({edits} = 2 and {apart} = 1) then {shorter} - 1"
        f" when length({a}) <= {_WORD} then {_lcs_bits(a, b)}"
        f" when length({b}) <= {_WORD} then {_lcs_bits(b, a)}"
        f" else {_lcs_rows(a, b)} end"
    )


def ratio(a: str, b: str) -> Column:
    total = F.length(F.col(a)) + F.length(F.col(b))
    return F.when(total == 0, F.lit(100.0)).otherwise(
        F.lit(200.0) * lcs_length(a, b) / total
    )


def sorted_tokens(col: Column) -> Column:
    """White-space tokens in order, joined by one blank."""
    return F.when(
        col.rlike(r"\s"), F.array_join(F.array_sort(F.split(col, r"\s+")), " ")
    ).otherwise(col)


def with_number_similarity(df: DataFrame, a: str, b: str, out: str = "similarity",
                           only: Column | None = None) -> DataFrame:
    """Add the similarity (0..100, two decimals) of two trimmed number columns.

    With ``only``, rows that fail the condition get null and cost nothing.
    """
    spaced = F.col(a).rlike(r"\s") | F.col(b).rlike(r"\s")
    best = F.when(spaced, F.greatest(ratio(a, b), ratio("_a_tokens", "_b_tokens"))).otherwise(ratio(a, b))
    score = F.bround(best, 2) if only is None else F.when(only, F.bround(best, 2))
    return (
        df.withColumns({"_a_tokens": sorted_tokens(F.col(a)), "_b_tokens": sorted_tokens(F.col(b))})
        .withColumn(out, score)
        .drop("_a_tokens", "_b_tokens")
    )


def _edits_allow(a: Column, b: Column) -> Column:
    budget = F.floor((F.length(a) + F.length(b)) * (1 - _SHARE))
    close = F.abs(F.length(a) - F.length(b)) <= budget
    return F.when(close, F.levenshtein(a, b) <= budget).otherwise(F.lit(False))


def may_be_near(a: str, b: str) -> Column:
    """Cheap necessary condition: edit distance never exceeds insert/delete distance."""
    left, right = F.col(a), F.col(b)
    spaced = left.rlike(r"\s") | right.rlike(r"\s")
    sorted_allow = _edits_allow(sorted_tokens(left), sorted_tokens(right))
    return _edits_allow(left, right) | F.when(spaced, sorted_allow).otherwise(F.lit(False))


def near_only(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two numbers are near, with their similarity."""
    return with_number_similarity(df.filter(may_be_near(a, b)), a, b).filter(
        F.col("similarity") >= NEAR_THRESHOLD
    )


def common_needed(a_length: Column, b_length: Column) -> Column:
    """Shortest common subsequence that makes texts of these lengths near."""
    return F.ceil((a_length + b_length) * (_SHARE / 2) - 1e-9).cast("int")


def shortest_partner(length: Column) -> Column:
    """No near text is shorter: even as a subsequence it would be too short."""
    return F.ceil(length * (_SHARE / (2 - _SHARE)) - 1e-9).cast("int")


def longest_partner(length: Column) -> Column:
    return F.floor(length * ((2 - _SHARE) / _SHARE) + 1e-9).cast("int")


def edits_allowed(length: Column) -> Column:
    """Most insertions plus deletions between a text of this length and any near text."""
    return F.floor(length * (1 - _SHARE) * (1 + (2 - _SHARE) / _SHARE) + 1e-9).cast("int")


def _drop_one(texts: str) -> Column:
    return F.expr(
        f"array_distinct(flatten(transform({texts}, t -> if(length(t) = 0, array(),"
        f" transform(sequence(1, greatest(length(t), 1)),"
        f" i -> concat(substr(t, 1, i - 1), substr(t, i + 1)))))))"
    )


def with_subsequences(df: DataFrame, text: str, times: str, out: str, most: int) -> DataFrame:
    """Add all texts left after dropping exactly ``times`` characters, at most ``most``.

    A text shorter than that leaves the empty text.
    """
    rows = df.withColumn("_dropped_0", F.array(F.col(text)))
    kept = F.col("_dropped_0")
    for done in range(1, most + 1):
        name = f"_dropped_{done}"
        wanted = F.least(F.col(times), F.length(F.col(text)))
        nothing = F.array().cast("array<string>")
        rows = rows.withColumn(name, F.when(wanted >= done, _drop_one(f"_dropped_{done - 1}")).otherwise(nothing))
        kept = F.when(wanted >= done, F.col(name)).otherwise(kept)
    return rows.withColumn(out, kept).drop(*[f"_dropped_{i}" for i in range(most + 1)])


def pieces(text: str, size: str) -> Column:
    """Consecutive pieces of ``size`` characters. Size 0 gives one empty piece."""
    return F.expr(
        f"transform(if({size} > 0 and length({text}) >= {size},"
        f" sequence(1, length({text}) - {size} + 1, greatest({size}, 1)), array(1)),"
        f" i -> substr({text}, i, {size}))"
    )


def grams(text: str, size: str) -> Column:
    """Every substring of ``size`` characters."""
    return F.expr(
        f"array_distinct(transform(if({size} > 0 and length({text}) >= {size},"
        f" sequence(1, length({text}) - {size} + 1), array(1)),"
        f" i -> substr({text}, i, {size})))"
    )
