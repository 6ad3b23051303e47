"""Near-duplicate numbers: same vendor, amounts within 1.00, similarity of at least 90.

The input is one row per cell: rows equal on company, vendor, number and amount are
already counted into one. Cells meet in blocks of (vendor, amount bucket).

* Ordinary blocks hold few cells and are joined directly.
* Hot blocks (one vendor billing one amount over and over) are not joined on the block.
  Their cells meet on (block, key of the number), with keys that any two near numbers
  must share. Two short numbers are near exactly when they share a subsequence of the
  length their two lengths ask for, so those subsequences are the keys and whatever
  meets is a match. Of long numbers there are too many subsequences: pieces of one meet
  substrings of the other (with more pieces than allowed edits, one piece survives). Both kinds of
  keys are made for each length a partner may have, so an odd short number shortens no other's pieces.
  The prefix shared by a whole block carries no information and is cut off first.

Pairs that such a key does not prove are compared in full, so the route changes cost only.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift.functions import similarity

NEAR_CENTS = 100
_BUCKET = 400
HOT_BLOCK = 64
MAX_KEYS = 400
_MOST_DELETIONS = 3
_BLOCK = ["vendor_id", "bucket"]
_CARRIED = ["cell", "anchor", "n", "n_scanned", "company_id", "number", "number_key", "cents"]


def _prefixed(df: DataFrame, prefix: str, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def _own(cells: DataFrame) -> DataFrame:
    return cells.withColumn("bucket", F.floor(F.col("cents") / _BUCKET))


def _reached(cells: DataFrame) -> DataFrame:
    buckets = F.array_distinct(
        F.array(
            F.floor((F.col("cents") - NEAR_CENTS) / _BUCKET),
            F.floor((F.col("cents") + NEAR_CENTS) / _BUCKET),
        )
    )
    return cells.withColumn("bucket", F.explode(buckets))


def close_rows(rows: DataFrame) -> DataFrame:
    """Rows whose vendor has another row in the block of their amount; all others are near to none."""
    known = rows.filter(F.col("vendor_id").isNotNull() & F.col("cents").isNotNull())
    blocks = (
        _reached(known.select("vendor_id", "cents", "scanned")).groupBy(*_BLOCK)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("scanned").alias("n_scanned"))
        .filter("n > 1 and n_scanned > 0")
    )
    return _own(known).join(blocks.select(*_BLOCK), _BLOCK, "left_semi").drop("bucket")


def _shared_prefix_length(low: str, high: str) -> Column:
    """All texts between the least and the greatest share what these two share."""
    return F.expr(
        f"size(filter(sequence(0, least(length({low}), length({high}))),"
        f" i -> i > 0 and substr({low}, 1, i) = substr({high}, 1, i)))"
    )


def _block_stats(reached: DataFrame, hot_block: int, max_keys: int) -> DataFrame:
    """Size of every block worth joining, and how to make keys if it is hot."""
    number = F.col("number")
    stats = (
        reached.groupBy(*_BLOCK)
        .agg(
            F.count(F.lit(1)).alias("block_n"),
            F.sum("n_scanned").alias("block_scanned"),
            F.min(number).alias("low"),
            F.max(number).alias("high"),
            F.min(F.least(F.length(number), F.length(similarity.sorted_tokens(number)))).alias("shortest"),
            F.max(F.length(number)).alias("longest"),
            F.max(number.rlike(r"\s")).alias("spaced"),
            # Lengths are few; numbers of other lengths need no keys.
            F.collect_set(F.length(similarity.sorted_tokens(number))).alias("token_lengths"),
            F.collect_set(F.length(number)).alias("plain_lengths"),
        )
        .filter((F.col("block_n") > 1) & (F.col("block_scanned") > 0))
    )
    # Sorting tokens may move the shared prefix, so spaced blocks keep it.
    cut = F.when(F.col("spaced"), F.lit(0)).otherwise(_shared_prefix_length("low", "high"))
    stats = stats.withColumn("cut", cut)
    rest = F.col("longest") - F.col("cut")
    partner = F.greatest(F.col("shortest"), similarity.shortest_partner(F.col("longest")))
    deletions = F.col("longest") - similarity.common_needed(F.col("longest"), partner)
    few = F.lit(False)
    for d in range(_MOST_DELETIONS + 1):
        # Longest rest that has no more subsequences than the limit.
        reach = max(r for r in range(1000) if comb(r, d) <= max_keys or r == 0)
        few = few | ((deletions == d) & (rest <= reach))
    return stats.select(
        *_BLOCK,
        (F.col("block_n") > hot_block).alias("hot"),
        "cut",
        "spaced",
        few.alias("by_subsequence"),
        F.array_union("plain_lengths", "token_lengths").alias("lengths"),
    )


def _formed(rows: DataFrame) -> DataFrame:
    """The number without the shared prefix, and its sorted tokens where they differ."""
    number = F.col("number")
    plain = F.substring(number, F.col("cut") + 1, F.length(number))
    forms = F.when(number.rlike(r"\s"), F.array(plain, similarity.sorted_tokens(number))).otherwise(
        F.array(plain)
    )
    return rows.withColumn("form", F.explode(F.array_distinct(forms)))


def _with_partners(formed: DataFrame) -> DataFrame:
    """A row for every length that a similar number of the block may have; both lengths name the class."""
    whole = F.length("form") + F.col("cut")
    partners = F.filter(
        "lengths",
        lambda p: p.between(similarity.shortest_partner(whole), similarity.longest_partner(whole)),
    )
    rows = formed.withColumn("partner", F.explode(partners))
    return rows.withColumns({
        "whole": whole,
        "class": F.concat_ws(":", F.least(whole, "partner"), F.greatest(whole, "partner")),
    })


def _subsequence_keys(rows: DataFrame) -> DataFrame:
    """The subsequences that a partner of each length asks for."""
    whole = F.col("whole")
    rows = rows.withColumn("times", whole - similarity.common_needed(whole, F.col("partner")))
    rows = similarity.with_subsequences(rows, "form", "times", "kept", _MOST_DELETIONS)
    return rows.withColumn("kept", F.explode("kept")).withColumn(
        "key", F.concat("class", F.lit(":"), F.col("kept"))
    )


def _piece_keys(rows: DataFrame, cut_up: Callable) -> DataFrame:
    """Pieces (or substrings) as long as the two lengths of a class allow."""
    shorter, longer = F.least("whole", "partner"), F.greatest("whole", "partner")
    piece = F.floor((shorter - F.col("cut")) / (similarity.edits_allowed(longer) + 1)).cast("int")
    rows = rows.withColumn("piece", F.greatest(piece, F.lit(0)))
    return rows.withColumn("part", F.explode(cut_up("form", "piece"))).withColumn(
        "key", F.concat("class", F.lit(":"), F.col("part"))
    )


def _keyed(rows: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """One row per key of each number. The sides differ only for pieces against substrings.

    ``proves`` marks keys whose sharing is the similarity itself. In blocks with white
    space a plain text may meet a sorted one, which proves nothing.
    """
    formed = _with_partners(_formed(rows))
    short = _subsequence_keys(formed.filter("by_subsequence")).withColumn("proves", ~F.col("spaced"))
    cut_up = similarity.pieces if side == "a" else similarity.grams
    long = _piece_keys(formed.filter("not by_subsequence"), cut_up).withColumn("proves", F.lit(False))
    keep = [*_BLOCK, "key", "proves"]
    return _prefixed(short, f"{side}_", columns, *keep).unionByName(
        _prefixed(long, f"{side}_", columns, *keep)
    )


def _comparable() -> Column:
    """Everything but the similarity itself."""
    same_company = F.coalesce(F.col("a_company_id") == F.col("b_company_id"), F.lit(True))
    other_number = (F.col("a_number_key") != F.col("b_number_key")) | (F.col("a_number_key") == "")
    return (
        (F.col("a_cell") < F.col("b_cell"))
        & (F.abs(F.col("a_cents") - F.col("b_cents")) <= NEAR_CENTS)
        & (F.col("a_n_scanned") + F.col("b_n_scanned") > 0)
        & same_company
        & other_number
    )


def near_cells(cells: DataFrame, carried: list[str] | None = None, hot_block: int = HOT_BLOCK,
               max_keys: int = MAX_KEYS) -> DataFrame:
    """Pairs of cells with similar numbers; columns come prefixed a_ and b_."""
    columns = _CARRIED + list(carried or [])
    reached = _reached(cells)
    blocks = _block_stats(reached, hot_block, max_keys)
    cold = blocks.filter(~F.col("hot")).select(*_BLOCK)
    hot = blocks.filter("hot").drop("hot")
    own = _own(cells)

    a = _prefixed(own.join(cold, _BLOCK, "left_semi"), "a_", columns, *_BLOCK)
    b = _prefixed(reached.join(cold, _BLOCK, "left_semi"), "b_", columns, *_BLOCK)
    direct = a.join(b, _BLOCK).filter(_comparable()).drop(*_BLOCK)

    hot_a = _keyed(own.join(hot, _BLOCK), "a", columns)
    hot_b = _keyed(reached.join(hot, _BLOCK), "b", columns)
    met = hot_a.join(hot_b, [*_BLOCK, "key", "proves"]).filter(_comparable()).drop(*_BLOCK, "key")
    # A pair can meet on several keys.
    met = met.dropDuplicates(["a_cell", "b_cell", "proves"])
    proven = met.filter("proves").drop("proves")
    open_pairs = direct.unionByName(met.filter("not proves").drop("proves"))
    checked = similarity.near_only(open_pairs, "a_number", "b_number").drop("similarity")
    return proven.unionByName(checked)
