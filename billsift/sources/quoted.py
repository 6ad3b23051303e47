"""CSV files with line breaks inside quoted cells, read in parallel.

Whether a line starts inside a quoted cell depends on all lines before it. Each line is a map of that state: it
keeps it, turns it round, or sets it whatever it was. Such maps combine in any grouping, so they are
combined inside each block of a file first, as the block is read, then over the blocks (one row per block), and every line
then knows its state.
Lines that are a row by themselves go on as they are; only the lines of rows with breaks are brought together. Lines
end with a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billsift.session import cut_lineage

_BLOCK = ["file_path", "block"]
# States within a line: at its start, in an unquoted cell, in a quoted one, behind a quote in a quoted one.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
# A quoted cell without quotes in it.
_QUOTED_CELL = r'(^|,)"[^"]*+"(?=,|\z)'


def ends_quoted(line: Column, starts_quoted: bool) -> Column:
    """Whether the line ends inside a quoted cell. Quotes open a cell only at its first character."""
    between = F.split(line, '"', -1)

    def after_quote(state: Column, part: Column) -> Column:
        opens = part.endswith(",") | ((part == "") & (state == _START))
        again = (state == _CLOSED) & (part == "")
        return F.when(state == _QUOTED, _CLOSED).when(again | opens, _QUOTED).otherwise(_PLAIN)

    first = F.lit(_QUOTED if starts_quoted else _START)
    last = F.aggregate(F.slice(between, 1, F.size(between) - 1), first, after_quote)
    return last == _QUOTED


def _combined(turns: Column, fixed: Column, start: Column) -> Column:
    """State after lines that turn it ``turns`` times, the last setting one being ``fixed`` (as if turned by all of them)."""
    return F.coalesce(fixed, start) != (turns % 2 == 1)


def _turns(order: str, keys: list[str], turn: Column, sets: Column, to: Column) -> tuple[Column, Column]:
    """Running turns, and for the last row that sets the state its value before all those turns."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = F.sum(turn.cast("bigint")).over(running)
    return turns, F.when(sets, to != (turns % 2 == 1))


def _with_states(lines: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``fixed`` of the lines of a block up to each one, and the same before it.

    Every task must get the lines of a block together and in order, as a scan gives them.
    """
    quoted = F.contains("value", F.lit('"'))
    maps = lines.withColumns({
        "outside": F.when(quoted, ends_quoted(F.col("value"), False)).otherwise(False),
        "inside": F.when(quoted, ends_quoted(F.col("value"), True)).otherwise(True),
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the line before: file, block, turns, and fixed as 0, 1 or -1 for null.
        before = (None, None, 0, -1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            path, block = batch.column(0), batch.column(1).to_numpy()
            outside = batch.column(4).to_numpy(zero_copy_only=False)
            inside = batch.column(5).to_numpy(zero_copy_only=False)
            same_path = pc.equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            goes_on = np.concatenate([[False], same_path & (block[1:] == block[:-1])])
            first = path[0].as_py(), int(block[0])
            held = before[2:] if first == before[:2] else (0, -1)
            turn = outside & ~inside
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(goes_on, 0, place))
            total = np.cumsum(turn)
            turns = total - (total - turn)[begin] + np.where(begin == 0, held[0], 0)
            last_set = np.maximum.accumulate(np.where(outside == inside, place, -1))
            at_set = (outside != (turns % 2 == 1)).astype(np.int8)
            fixed = np.where(last_set >= begin, at_set[last_set], np.where(begin == 0, held[1], -1))
            turns_before = np.where(goes_on, np.roll(turns, 1), 0)
            fixed_before = np.where(goes_on, np.roll(fixed, 1), -1)
            turns_before[0], fixed_before[0] = held
            before = (path[n - 1].as_py(), int(block[-1]), int(turns[-1]), int(fixed[-1]))

            def flags(values: np.ndarray) -> pa.Array:
                return pa.array(values == 1, pa.bool_(), mask=values < 0)

            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(turns, pa.int64()), flags(fixed), pa.array(turns_before, pa.int64()), flags(fixed_before)],
                [*batch.schema.names[:4], "turns", "fixed", "turns_before", "fixed_before"],
            )

    return maps.mapInArrow(
        run,
        "file_path string, block bigint, nth bigint, value string, turns bigint, fixed boolean, "
        "turns_before bigint, fixed_before boolean",
    )


def records(scanned: DataFrame, used: list[DataFrame]) -> DataFrame:
    """file_path, block, nth (of the first line), record from what ``stored_lines`` gives. Blank rows go.

    Tables that are stored on the way and not needed once the records are read are added to ``used``.
    """
    ordered = Window.partitionBy(*_BLOCK).orderBy("nth")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = scanned.groupBy(*_BLOCK).agg(
        F.max_by("turns", "nth").alias("turns"), F.max_by("fixed", "nth").alias("fixed")
    )
    # The same over the blocks of a file.
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_turns, block_set = _turns(
        "block", ["file_path"], F.col("fixed").isNull() & (F.col("turns") % 2 == 1), F.col("fixed").isNotNull(),
        _combined(F.col("turns"), F.col("fixed"), F.lit(False)),
    )
    starts = cut_lineage(blocks.withColumns({"block_turns": block_turns, "block_set": block_set}).select(
        *_BLOCK,
        _combined(
            F.coalesce(F.max("block_turns").over(before), F.lit(0)), F.last("block_set", True).over(before), F.lit(False)
        ).alias("block_start"),
    ))
    # One row per block is sent to the tasks.
    stated = scanned.join(F.broadcast(starts), _BLOCK).withColumns({
        "after": _combined(F.col("turns"), F.col("fixed"), F.col("block_start")),
        "before": _combined(F.col("turns_before"), F.col("fixed_before"), F.col("block_start")),
    })
    whole = stated.filter("not before and not after").select(*_BLOCK, "nth", F.col("value").alias("record"))
    # Lines of rows with breaks: from a line that leaves a cell open to the one that closes it.
    parts = cut_lineage(
        stated.filter("before or after").withColumn(
            "first_line", F.last(F.when(~F.col("before"), F.struct("block", "nth")), True).over(running)
        ).select(*_BLOCK, "nth", "value", "first_line")
    )
    used += [starts, parts]
    # A block may begin within a row that began in an earlier block.
    carried = (
        parts.groupBy(*_BLOCK).agg(F.max("first_line").alias("last_first"))
        .withColumn("carried", F.last("last_first", True).over(before)).select(*_BLOCK, "carried")
    )
    joined = (
        parts.join(carried, _BLOCK).withColumn("first_line", F.coalesce("first_line", "carried"))
        .groupBy("file_path", "first_line")
        .agg(F.array_sort(F.collect_list(F.struct("block", "nth", "value"))).alias("lines"))
        .select("file_path", "first_line.block", "first_line.nth", F.array_join("lines.value", "\n").alias("record"))
    )
    return whole.unionByName(joined).filter(F.btrim("record", F.lit(" \r\n\t")) != "")


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, block, nth, value of every line of the CSV files under ``path``, and its place among the states of the block.

    A character of a value stands for a byte.
    """
    text = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").option("lineSep", "\n")
        .text(path)
    )
    return cut_lineage(_with_states(text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"),
    )))


def _with_filled(found: DataFrame, width: int) -> DataFrame:
    """Adds ``filled``: the record with empty cells added up to ``width``, null where it may have more or cannot be counted.

    Without its quoted cells a record that still holds a quote is not counted: an escaped quote, one inside a
    cell, or one never closed.
    """
    quote, comma = F.lit('"'), F.lit(",")
    bare = F.when(F.contains("record", quote), F.regexp_replace("record", _QUOTED_CELL, "$1")).otherwise(F.col("record"))
    missing = width - 1 - (F.length("bare") - F.length(F.replace("bare", comma, F.lit(""))))
    counted = ~F.contains("bare", quote) & (F.col("missing") >= 0)
    return (
        found.withColumn("bare", bare).withColumn("missing", missing)
        .withColumn("filled", F.when(counted, F.concat("record", F.repeat(comma, F.col("missing")))))
    )


def cells_of(
    lines: DataFrame, schema: str, options: dict[str, str], width: int | None = None, used: list[DataFrame] | None = None
) -> DataFrame:
    """file_path, row_order, cells of stored lines, as the CSV reader with the options gives them.

    The reader takes many times as long over a record whose cells are not as many as it expects. Records of
    ``width`` cells at most (those of the widest header) are therefore filled up to it and read as that many.
    ``used`` is for ``records``.
    """
    parsed = {k: v for k, v in options.items() if k not in ("header", "encoding")}

    def read(record: Column, as_schema: str) -> Column:
        return F.from_csv(record, F.lit(as_schema), parsed)

    record = F.col("record")
    found = records(lines, [] if used is None else used).select(
        "file_path", F.struct("block", "nth").alias("row_order"),
        F.when(record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record).alias("record"),
    )
    if width is None:
        return found.select("file_path", "row_order", read(F.col("record"), schema).alias("row")).select(
            "file_path", "row_order", F.array("row.*").alias("cells")
        )
    names = [f"c{i}" for i in range(width)]
    narrow = ", ".join(f"{c} string" for c in names)
    both = _with_filled(found, width).select(
        "file_path", "row_order",
        read(F.col("filled"), narrow).alias("few"),
        read(F.when(F.col("filled").isNull(), F.col("record")), schema).alias("row"),
    )
    return both.select(
        "file_path", "row_order",
        F.when(F.col("row").isNull(), F.array(*[F.col("few")[c] for c in names])).otherwise(F.array("row.*")).alias("cells"),
    )


def placed_cells(spark: SparkSession, path: str, schema: str, options: dict[str, str]) -> DataFrame:
    """file_path, row_order, cells of all CSV files under ``path``, as the CSV reader with the options gives them.

    A file is cut into blocks like any text. A cell that is never closed takes the rest of its file.
    """
    return cells_of(stored_lines(spark, path), schema, options)
