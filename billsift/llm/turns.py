"""Repair of the turn structure of conversations at least cost.

A conversation's rows are read by turn (null turns first; rows of one turn by role, then by a digest of
their text). Each row is kept, given another role, or deleted, and empty turns may be inserted, until
the initials of the roles read ``(s?(ua)+)?``. Of all cheapest repairs the one whose edits, written as
letters in order, come first in ASCII is taken.

How it is found:

* Rows are cut into blocks of bounded length in one global sort, so a conversation of any length is
  spread over tasks. A block's costs are a 4 x 4 table from the state before it to the state behind
  it. Costs to the end follow by doubling over the blocks of a conversation: joins of block b with
  block b + 2^k.
* With the costs behind a block known, the edits that lie on a cheapest repair are arcs of a graph of
  (row, state). Its nodes are ranked by the least audit of 1, 2, 4, ... letters: the rank of 2^(k+1)
  letters is that of the pair (rank of the node, rank of the node 2^k letters on), and of a node's arcs
  the one with the least letter, then least rank of its target, stays. The doubled pointers then give
  the nodes of the least path from every state in which a block may begin.
* Which state a block does begin in follows from the blocks before it, again by doubling.

Repeated rows (same conversation, turn, role and text) are one element with a number of copies: all but
the first are deletions, and a deletion comes before an insertion of the same audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billsift.llm.common import WORD_GAPS, stored

# Edits, their costs, and the states between two rows of a repaired conversation.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
LETTERS = ("", DELETE, INSERT, KEEP, REROLE)
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
CLEAN, BLANK, DUPLICATE, TRUNCATED, CLOSING = range(5)

#: Elements of one conversation that one task walks through at a time.
BLOCK = 4096
#: Elements handled side by side in a task.
SLICE = 65_536

_FAR = 1 << 40
#: State after a user or assistant turn where that is the only legal one.
_FORWARD = np.array([AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER])
_ENDS = [0, _FAR, _FAR, 0]
_SAME = [0 if i % 5 == 0 else _FAR for i in range(16)]


# --- damage, for trials ---------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by the checksum of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, question and exclamation marks, 3
    repeats it, 4 makes it a user's. A null in the checksum, the role or the text is one blank.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), fate.alias("fate"))
        .filter("fate <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("fate") == 1, F.lit(""))
            .when(F.col("fate") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


# --- elements in blocks ---------------------------------------------------------------------------


def elements(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Distinct rows in blocks: block, at, conv_id, turn, role, text, initial, fault, copies.

    A last element without text closes every conversation of the rows and of ``conv_ids``. Stored, so
    that blocks stay as they are.
    """
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    ids = rows.select("conv_id")
    if conv_ids is not None:
        ids = ids.unionByName(conv_ids.select("conv_id"))
    # First place of a text in its conversation; turns without a number come first.
    when = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    held = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    held = held.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    firsts = (
        rows.select("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("text_key"), when.alias("when"))
        .groupBy("conv_id", "role", "text_key")
        .agg(F.min("when").alias("first"))
        .select(
            F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("text_key").alias("f_key"), "first"
        )
    )
    sign = F.right(F.rtrim("text", F.lit(WORD_GAPS)), F.lit(1))
    fault = (
        F.when(sign == "", BLANK)
        .when(when > F.col("first"), DUPLICATE)
        .when(~sign.isin(".", "!", "?"), TRUNCATED)
        .otherwise(CLEAN)
    )
    mark = F.substring("role", 1, 1)
    initial = F.when(mark == "s", 1).when(mark == "u", 2).when(mark == "a", 3).otherwise(0)
    told = held.join(
        firsts,
        held.conv_id.eqNullSafe(F.col("f_conv")) & (held.role == F.col("f_role")) & (held.text_key == F.col("f_key")),
    ).select(
        "conv_id", F.lit(False).alias("closing"), "turn", "role", "text_key", "text", "copies",
        initial.cast("tinyint").alias("initial"), fault.cast("tinyint").alias("fault"),
    )
    closings = ids.distinct().select(
        "conv_id", F.lit(True).alias("closing"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("text_key"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"),
        F.lit(0).cast("tinyint").alias("initial"), F.lit(CLOSING).cast("tinyint").alias("fault"),
    )
    order = ["conv_id", "closing", "turn", "role", "text_key"]
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = told.unionByName(closings).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    # Rank in the sorted partition: the partition's number above, the place below.
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, at = object(), 0, 0
        for batch in batches:
            blocks, ats = [], []
            for conv, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != current or at + 1 == BLOCK:
                    current, block, at = conv, place, 0
                else:
                    at += 1
                blocks.append(block)
                ats.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(ats, pa.int32()), batch.column(0), *batch.columns[2:]],
                names=["block", "at", "conv_id", *batch.schema.names[2:]],
            )

    return stored(
        ordered.select("conv_id", "place", "turn", "role", "text", "initial", "fault", "copies").mapInArrow(
            cut,
            f"block long, at int, conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string, "
            "initial tinyint, fault tinyint, copies long",
        )
    )


# --- one block ------------------------------------------------------------------------------------


class _Lanes:
    """Blocks of about the same length, walked side by side from their ends."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, copies: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.starts, self.sizes = starts, sizes
        states = np.arange(4)
        forced = (fault == BLANK) | (fault == DUPLICATE)
        closing = fault == CLOSING
        rest = DELETE_COST * np.maximum(copies - 1, 0) + TRUNCATED_COST * (fault == TRUNCATED)
        who = initial[:, None]
        legal = np.where(states == START, (who == 1) | (who == 2), np.where(states == AFTER_USER, who == 3, who == 2))
        self.keep_to = np.where((who == 1) & (states == START), AFTER_SYSTEM, _FORWARD)
        barred = (forced | closing)[:, None]
        self.delete = np.where(closing, _FAR, DELETE_COST * copies)
        self.close = np.where(closing, 0, _FAR)
        self.keep = np.where(legal & ~barred, rest[:, None], _FAR)
        self.rerole = np.where(barred[:, 0], _FAR, rest + REROLE_COST)

    def _options(self, rows: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
        """Costs to the end without an insertion before the row: (close, delete, keep, rerole)."""
        wide = (slice(None), None) + (None,) * (after.ndim - 2)
        lane = np.arange(len(rows))[:, None]
        keep = self.keep[rows].reshape(len(rows), 4, *([1] * (after.ndim - 2)))
        return (
            self.close[rows][wide] + after,
            self.delete[rows][wide] + after,
            keep + after[lane, self.keep_to[rows]],
            self.rerole[rows][wide] + after[:, _FORWARD],
        )

    def _walk(self, behind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lanes, rows, costs behind the row, costs before it), from the last rows to the first."""
        costs = behind.copy()
        ends = self.starts + self.sizes
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            lanes = np.flatnonzero(self.sizes >= step)
            rows = ends[lanes] - step
            after = costs[lanes]
            before = np.minimum.reduce(self._options(rows, after))
            for _ in range(2):
                before = np.minimum(before, INSERT_COST + before[:, _FORWARD])
            costs[lanes] = np.minimum(before, _FAR)
            yield lanes, rows, after, costs[lanes]

    def table(self) -> np.ndarray:
        """Costs from each state before the block to each state behind it, per lane."""
        identity = np.array(_SAME, np.int64).reshape(4, 4)
        costs = np.repeat(identity[None], len(self.starts), 0)
        for lanes, _, _, before in self._walk(costs):
            costs[lanes] = before
        return costs.reshape(-1, 16)

    def least_paths(self, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of every row and the state before them, by entry state, and the exit states per lane.

        ``behind`` holds the costs from each state behind a block to the conversation's end.
        """
        count = int(self.sizes.sum())
        base = int(self.starts[0]) if len(self.starts) else 0
        total = count * 4
        # Arcs on a cheapest repair: letter by letter, the target or -1. Exits follow the rows' nodes.
        targets = np.full((5, count, 4), -1, np.int64)
        exits = total + 4 * np.arange(len(self.starts))
        ends = self.starts + self.sizes
        for lanes, rows, after, before in self._walk(behind):
            close, delete, keep, rerole = self._options(rows, after)
            at = rows - base
            below = np.where(rows + 1 == ends[lanes], exits[lanes], 4 * (at + 1))[:, None]
            reachable = before < _FAR
            for letter, cost, target in (
                (0, close, below + np.arange(4)),
                (1, delete, below + np.arange(4)),
                (2, INSERT_COST + before[:, _FORWARD], 4 * at[:, None] + _FORWARD),
                (3, keep, below + self.keep_to[rows]),
                (4, rerole, below + _FORWARD),
            ):
                targets[letter, at] = np.where(reachable & (cost == before), target, -1)
        nodes = total + 4 * len(self.starts)
        jump, letter = _ranked(targets.reshape(5, total), nodes)
        paths = _path_nodes(jump, (4 * (self.starts - base))[:, None] + np.arange(4))
        # Nodes of one row follow each other on a path: insertions first, then the row's own letter.
        entry = np.nonzero(paths < total)[1]
        node = paths[paths < total]
        row, own = node // 4, letter[node]
        words = np.full((count, 4), "", object)
        first = np.full((count, 4), 0, np.int8)
        place = row * 4 + entry
        fresh = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        inserts = np.add.reduceat(own == 2, heads) if len(heads) else heads
        tails = np.append(heads[1:], len(place)) - 1
        made = [INSERT * int(n) + LETTERS[w] for n, w in zip(inserts, np.where(own[tails] == 2, 0, own[tails]), strict=True)]
        words.reshape(-1)[place[heads]] = made
        first.reshape(-1)[place[heads]] = node[heads] % 4
        leaving = paths[:, :, -1] - exits[:, None]
        return words, first, np.where((leaving >= 0) & (leaving < 4), leaving, START).astype(np.int8)


def _ranked(targets: np.ndarray, nodes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers over 1, 2, 4, ... letters of the least audit of every node, and each node's first letter.

    ``targets`` holds per letter the nodes that optimal arcs lead to, -1 without an arc. Nodes without
    arcs, the exits, point to themselves.
    """
    total = targets.shape[1]
    letters = np.full(nodes, 0, np.int64)
    step = np.arange(nodes)
    has = targets >= 0
    first = has.argmax(0)
    some = has.any(0)
    own = np.arange(total)
    letters[:total] = np.where(some, first, 0)
    step[:total] = np.where(some, targets[first, own], own)
    # Rank 0 is an exit: an audit that has ended comes before one that goes on.
    rank = np.zeros(nodes, np.int64)
    rank[:total] = np.where(some, first + 1, 0)
    jumps = [step]
    while True:
        last = jumps[-1]
        if (last == last[last]).all():
            return jumps, letters
        # Arcs of one letter lead to one node at most, so the choice of the first round stays; the ranks
        # of twice as many letters order whole audits across nodes.
        width = int(rank.max()) + 1
        _, rank = np.unique(rank * width + rank[last], return_inverse=True)
        order = np.where(has, targets, 0)
        keys = np.where(has, np.arange(len(targets))[:, None] * nodes + rank[order], np.iinfo(np.int64).max)
        best = keys.argmin(0)
        step[:total] = np.where(some, targets[best, own], step[:total])
        jumps.append(last[last])


def _path_nodes(jumps: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """The nodes of the paths from the starts, in order; the last one is an exit."""
    path = starts[..., None]
    for jump in reversed(jumps):
        path = np.stack([path, jump[path]], -1).reshape(*path.shape[:-1], -1)
    return np.concatenate([path, jumps[0][path[..., -1:]]], -1)


def _classes(block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, starts, sizes) of the blocks of rows in order, by length up to a power of two."""
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    sizes = np.diff(np.append(heads, len(block)))
    level = np.ceil(np.log2(sizes)).astype(int)
    for k in np.unique(level):
        chosen = np.flatnonzero(level == k)
        rows = np.concatenate([np.arange(heads[c], heads[c] + sizes[c]) for c in chosen])
        yield rows, np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole blocks, about ``SLICE`` at a time, from rows in order of block and at."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= SLICE:
            rows = pa.Table.from_batches(held)
            block = rows.column("block").to_numpy()
            cut = int(np.searchsorted(block == block[-1], True)) if block[0] != block[-1] else 0
            if cut:
                yield rows.slice(0, cut)
                held, count = rows.slice(cut).to_batches(), len(block) - cut
    if count:
        yield pa.Table.from_batches(held)


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy().astype(np.int64) for n in names]


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "at")


def _tables(rows: DataFrame) -> DataFrame:
    """block, costs (16) of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_blocks(batches):
            block, initial, fault, copies = _numbers(part, "block", "initial", "fault", "copies")
            for at, starts, sizes in _classes(block):
                costs = _Lanes(initial[at], fault[at], copies[at], starts, sizes).table()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[at][starts]), pa.array(list(costs), pa.list_(pa.int64()))], names=["block", "costs"]
                )

    return _by_block(rows.select("block", "at", "initial", "fault", "copies")).mapInArrow(
        run, "block long, costs array<bigint>"
    )


def _letters(rows: DataFrame, behind: DataFrame) -> DataFrame:
    """block, at, words (4), before (4) by entry state; exits (4) on the first element of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_blocks(batches):
            block, at_no, initial, fault, copies = _numbers(part, "block", "at", "initial", "fault", "copies")
            costs = np.stack(_numbers(part, "b0", "b1", "b2", "b3"), 1)
            for at, starts, sizes in _classes(block):
                lanes = _Lanes(initial[at], fault[at], copies[at], starts, sizes)
                words, before, exits = lanes.least_paths(costs[at][starts])
                leaving: list = [None] * len(at)
                for s, e in zip(starts, exits.tolist(), strict=True):
                    leaving[s] = e
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[at]),
                        pa.array(at_no[at].astype(np.int32)),
                        pa.array(words.tolist(), pa.list_(pa.string())),
                        pa.array(before.tolist(), pa.list_(pa.int8())),
                        pa.array(leaving, pa.list_(pa.int8())),
                    ],
                    names=["block", "at", "words", "before", "exits"],
                )

    told = rows.select("block", "at", "initial", "fault", "copies").join(
        behind.select("block", *(F.col("behind")[i].alias(f"b{i}") for i in range(4))), "block"
    )
    return _by_block(told).mapInArrow(
        run, "block long, at int, words array<string>, before array<tinyint>, exits array<tinyint>"
    )


# --- across blocks --------------------------------------------------------------------------------


def _doubled(blocks: DataFrame, value: str, most: int, backward: bool, joined: Column) -> DataFrame:
    """Combines each block's value with those of 1, 2, 4, ... blocks on: behind it, or before it."""
    reach = 1
    while reach < most:
        shift = reach if backward else -reach
        other = blocks.select(
            F.col("conv_key").alias("o_conv"), (F.col("nth") - shift).alias("o_nth"), F.col(value).alias("other")
        )
        blocks = blocks.join(
            other, (F.col("conv_key") == F.col("o_conv")) & (F.col("nth") == F.col("o_nth")), "left"
        ).drop("o_conv", "o_nth")
        blocks = stored(
            blocks.withColumn(value, F.when(F.col("other").isNull(), F.col(value)).otherwise(joined)).drop("other")
        )
        reach *= 2
    return blocks


def planned(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """The elements with their edits: those of :func:`elements`, edits (letters), before (state).

    The closing element of a conversation has the insertions at its end. Other columns of the rows play
    no part. A null role or text is one blank. Null conv_ids are one conversation.
    """
    parts = elements(rows, conv_ids)
    closing = F.col("fault") == CLOSING
    heads = parts.groupBy("block").agg(F.min("conv_id").alias("conv_id"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("block"))
    # One row per block of up to BLOCK elements; a conversation is known by its last block.
    blocks = heads.select("block", "conv_id", nth.alias("nth"))
    last = blocks.groupBy("conv_id").agg(F.max("block").alias("conv_key"), F.max("nth").alias("n"))
    blocks = blocks.join(last.withColumnRenamed("conv_id", "l_conv"), F.col("conv_id").eqNullSafe(F.col("l_conv")))
    blocks = stored(blocks.select("block", "conv_key", "nth", "n").join(_tables(parts), "block"))
    most = blocks.agg(F.max("n")).first()[0] or 1
    product = F.expr(
        f"transform(sequence(0, 15), i -> least(cast({_FAR} as bigint), array_min(transform(sequence(0, 3), "
        "k -> costs[(i div 4) * 4 + k] + other[k * 4 + i % 4]))))"
    )
    suffix = _doubled(blocks, "costs", most, True, product)
    # Costs behind a block: the least of the next block's table to the ends 0 and 3.
    to_end = F.expr("transform(sequence(0, 3), i -> least(costs[i * 4], costs[i * 4 + 3]))")
    following = suffix.filter("nth > 1").select("conv_key", (F.col("nth") - 1).alias("nth"), to_end.alias("behind"))
    ends = F.array(*(F.lit(v).cast("bigint") for v in _ENDS))
    behind = blocks.select("block", "conv_key", "nth").join(following, ["conv_key", "nth"], "left")
    behind = behind.withColumn("behind", F.coalesce("behind", ends))
    letters = stored(_letters(parts, behind))
    # State in which a block begins: the exits of all blocks before it, from the start.
    exits = blocks.select("block", "conv_key", "nth").join(
        letters.filter("exits is not null").select("block", "exits"), "block"
    )
    chained = _doubled(stored(exits), "exits", most, False, F.expr("transform(other, s -> exits[s])"))
    entries = chained.select("conv_key", (F.col("nth") + 1).alias("nth"), F.col("exits")[START].alias("entry"))
    entries = blocks.select("block", "conv_key", "nth").join(entries, ["conv_key", "nth"], "left")
    told = letters.join(entries.select("block", F.coalesce("entry", F.lit(START)).alias("entry")), "block").select(
        "block", "at", F.expr("words[entry]").alias("words"), F.expr("before[entry]").alias("before")
    )
    more = F.when(closing | (F.col("copies") < 2), F.lit("")).otherwise(
        F.repeat(F.lit(DELETE), (F.col("copies") - 1).cast("int"))
    )
    return parts.join(told, ["block", "at"]).select(
        *parts.columns, F.concat("words", more).alias("edits"), "before"
    )


def repaired(rows: DataFrame) -> DataFrame:
    """One row per edit: conv_id, block, at, nth (their order), turn, edit, role, text after the repair.

    Deleted rows have no role and no text, inserted ones no turn and an empty text. An empty table gives
    no rows.
    """
    state = F.expr("case when nth = 0 then before when nth % 2 = 1 then case when before = 2 then 3 else 2 end "
                   "else case when before = 2 then 2 else 3 end end")  # fmt: skip
    given = F.when(state == AFTER_USER, "assistant").otherwise("user")
    return (
        planned(rows)
        .filter("edits <> ''")
        .select("*", F.posexplode(F.split("edits", "")).alias("nth", "edit"))
        .filter("edit <> ''")
        .select(
            "conv_id", "block", "at", "nth",
            F.when(F.col("edit") != INSERT, F.col("turn")).alias("turn"),
            "edit",
            F.when(F.col("edit") == KEEP, F.col("role")).when(F.col("edit") != DELETE, given).alias("role"),
            F.when(F.col("edit") == INSERT, "").when(F.col("edit") != DELETE, F.col("text")).alias("text"),
        )
    )


# --- digests --------------------------------------------------------------------------------------

_LEGAL = {(1, 2), (2, 3), (3, 2)}


class _Digest:
    """Counters of one conversation, fed in order; keeps the audit and a running hash."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial: int | None = None
        self.parts: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, turn, role, text, initial, fault, copies, edits, before) -> None:
        state = before
        truncated = fault == TRUNCATED
        for edit in edits:
            if edit == DELETE:
                self.cost += DELETE_COST
                continue
            self.cost += {INSERT: INSERT_COST, KEEP: 0, REROLE: REROLE_COST}[edit]
            if edit != INSERT and truncated:
                self.cost += TRUNCATED_COST
            given = role if edit == KEEP else "assistant" if state == AFTER_USER else "user"
            line = given + ":" + ("" if edit == INSERT else text)
            self.hash.update((("\n" if self.begun else "") + line).encode())
            self.begun = True
            state = AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER
        self.parts.append(edits)
        if fault == CLOSING:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += self.high != turn
            self.high = turn
        if fault == BLANK:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + (fault == DUPLICATE)
            self.truncated += truncated
        self.illegal += copies - 1
        if self.initial is not None:
            self.illegal += (self.initial, initial) not in _LEGAL
        self.initial = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
            "".join(self.parts), self.hash.hexdigest(),
        )


def digests(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations of ``conv_ids`` without rows have zeros, an empty audit and the hash of nothing. The
    hash of a conversation is one sequential sum, so the rows of one conversation stream through one task
    here, in order; only its audit is held. An empty table gives no rows.
    """
    kind = dict(rows.dtypes)["conv_id"]
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        kind_of = None

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [kind_of, *([pa.int64()] * len(names)), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", *names, "audit", "repaired_sha256"],
            )

        for batch in batches:
            kind_of = batch.column(0).type
            done = []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv_id != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv)
                current.add(*rest)
            if done:
                yield made(done)
        if current is not None:
            yield made([current.row()])

    return (
        planned(rows, conv_ids)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "block", "at")
        .select("conv_id", "turn", "role", "text", "initial", "fault", "copies", "edits", "before")
        .mapInArrow(
            run,
            f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", audit string, repaired_sha256 string",
        )
    )
