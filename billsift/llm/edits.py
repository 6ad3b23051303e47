"""Token counts of edited documents.

Every document keeps a tree over the stretches of its text: leaves of about ``LEAF`` characters that end
behind white space, with the sums of characters and tokens above them. An edit is found by descending
along the character sums. Only the leaves it touches are encoded again, and the leaf behind them if
the white space between is gone, since tokens never reach across white space; then the sums on the
way up are mended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billsift.llm import bpe, words

#: Characters of a leaf, about.
LEAF = 256
EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"

_LEAF = re.compile(
    rf"(?s:.){{1,{LEAF}}}(?<=[{words.WHITE_SPACE}])(?![{words.WHITE_SPACE}])"
    rf"|(?s:.){{1,{LEAF}}}[^{words.WHITE_SPACE}]*[{words.WHITE_SPACE}]*"
)
_ENDS_OPEN = re.compile(rf"[^{words.WHITE_SPACE}]\Z")


class CountTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, count):
        self._count = count
        self.leaves = _LEAF.findall(text) or [""]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.leaves += [""] * (size - len(self.leaves))
        self.size = size
        self.chars = [0] * (2 * size)
        self.tokens = [0] * (2 * size)
        for n, leaf in enumerate(self.leaves):
            if leaf:
                self.chars[size + n], self.tokens[size + n] = len(leaf), count(leaf)
        for node in range(size - 1, 0, -1):
            self._sum(node)
        self.recounted = 0

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, place: int) -> tuple[int, int]:
        """Leaf of a character and its place in the leaf; the end of the text is in the last leaf in use."""
        node = 1
        place = min(place, self.chars[1])
        while node < self.size:
            left = self.chars[2 * node]
            if place < left or not self.chars[2 * node + 1]:
                node *= 2
            else:
                place -= left
                node = 2 * node + 1
        return node - self.size, place

    def _put(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        self.chars[node] = len(text)
        self.tokens[node] = self._count(text) if text else 0
        self.recounted += len(text)
        node //= 2
        while node:
            self._sum(node)
            node //= 2

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces ``length`` characters from ``start`` on; both are cut to the text as it is."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        stop = min(start + max(length, 0), total)
        first, at = self.find(start)
        last, end = (first, at) if stop == start else self.find(stop - 1)
        end += stop > start
        text = self.leaves[first][:at] + replacement + self.leaves[last][end:]
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._put(leaf, "")
        # Without white space at its end the stretch goes on in the next leaf in use.
        following = last + 1
        while following < self.size and (not text or _ENDS_OPEN.search(text)):
            if self.leaves[following]:
                text += self.leaves[following]
                self._put(following, "")
            following += 1
        self._put(first, text)


@lru_cache(maxsize=2)
def _counter(path: str):
    known = bpe.vocabulary(path)
    counts = words.Kept(lambda chunk: len(known._chunk_bytes(chunk)) // 4)
    return lambda text: sum([counts[c] for c in words.chunks(text)])


def counts(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, n_edits, n_before, n_after, n_recounted (characters) for rows of (doc_id, text, edits).

    Edits are applied in their order, each to the text as the ones before left it; places count code
    points. A null text is empty, null edits are none, a null replacement is empty, a null place or
    length is zero, places outside the text are moved to its end. Repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in bpe.slices(batches, 1):
            out = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = CountTree(text, count)
                before = tree.tokens[1]
                for change in changes:
                    tree.edit(change["start"] or 0, change["length"] or 0, change["replacement"] or "")
                out.append((len(changes), before, tree.tokens[1], tree.recounted))
            columns = [pa.array([row[k] for row in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["doc_id", "n_edits", "n_before", "n_after", "n_recounted"]
            )

    ready = rows.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("edits").cast(EDITS), F.array().cast(EDITS)).alias("edits"),
    )
    kind = dict(ready.dtypes)["doc_id"]
    return ready.mapInArrow(run, f"doc_id {kind}, n_edits bigint, n_before bigint, n_after bigint, n_recounted bigint")


def planned_edits(docs: DataFrame, every: int = 2000) -> DataFrame:
    """Rows with edits that follow from their doc_id and length: one, and one more per ``every`` characters.

    By turns a few words are put in, seven characters are cut out and five are replaced, at hashed places.
    """
    length = F.length(F.coalesce("text", F.lit("")))
    numbers = F.sequence(F.lit(0), F.floor(length / every).cast("int"))
    edits = F.transform(
        numbers,
        lambda j: F.struct(
            F.pmod(F.xxhash64(F.col("doc_id"), j), F.greatest(length, F.lit(1))).alias("start"),
            F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (0, 7, 5)]), j % 3 + 1).alias("length"),
            F.element_at(F.array(F.lit(" three new words "), F.lit(""), F.lit("Swap")), j % 3 + 1)
            .alias("replacement"),
        ),
    )
    return docs.select("doc_id", "text", edits.alias("edits"))
