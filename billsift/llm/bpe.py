"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one last token in its BPE encoding. It is the one vocabulary
token that ends the prefix and is compatible with the last token of the prefix before it: no merge
across their border would come before the merges that made the two. A suffix automaton over the
vocabulary gives the tokens that end a prefix; back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billsift.llm import words, workers

#: Characters of text that go into one batch of results.
BATCH_CHARS = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class SuffixAutomaton:
    """Accepts every substring of the given words; walked along a text it holds the longest suffix
    that is such a substring. ``ends`` leads from a state to the words that are suffixes of it."""

    def __init__(self, entries: dict[str, int]):
        following: list[dict[str, int]] = [{}]
        links, lengths = [-1], [0]

        def copy_state(source: int, length: int) -> int:
            following.append(dict(following[source]))
            links.append(links[source])
            lengths.append(length)
            return len(links) - 1

        def redirect(state: int, letter: str, old: int, new: int) -> None:
            while state != -1 and following[state].get(letter) == old:
                following[state][letter] = new
                state = links[state]

        def extend(state: int, letter: str) -> int:
            known = following[state].get(letter)
            if known is not None:
                if lengths[known] == lengths[state] + 1:
                    return known
                copied = copy_state(known, lengths[state] + 1)
                links[known] = copied
                redirect(state, letter, known, copied)
                return copied
            following.append({})
            lengths.append(lengths[state] + 1)
            links.append(0)
            made = len(links) - 1
            while state != -1 and letter not in following[state]:
                following[state][letter] = made
                state = links[state]
            if state != -1:
                known = following[state][letter]
                if lengths[known] == lengths[state] + 1:
                    links[made] = known
                else:
                    copied = copy_state(known, lengths[state] + 1)
                    links[known] = links[made] = copied
                    redirect(state, letter, known, copied)
            return made

        final: dict[int, int] = {}
        for entry, number in entries.items():
            state = 0
            for letter in entry:
                state = extend(state, letter)
            final[state] = number
        # A later word may have copied a final state: the word then ends in the copy of its length.
        for entry, number in entries.items():
            state = 0
            for letter in entry:
                state = following[state][letter]
            final[state] = number
        self.links, self.lengths = links, lengths
        self.following = {(s << 9) | ord(c): t for s, row in enumerate(following) for c, t in row.items()}
        following.clear()
        self.words = {s: n for s, n in final.items()}
        # Nearest state on the way to the root, itself included, in which a word ends.
        order = sorted(range(len(links)), key=lengths.__getitem__)
        self.ends = [0] * len(links)
        for s in order[1:]:
            self.ends[s] = s if s in final else self.ends[links[s]]

    def chosen(self, codes: list[int], fits: Callable[[int], bool]) -> list[tuple[int, int]]:
        """For each prefix of the letters, the empty one included, (length, number) of the longest word that ends it and
        goes with the word chosen for the prefix before it: (0, -1) if there is none."""
        state, held = 0, 0
        following, links, lengths, ends, numbers = self.following, self.links, self.lengths, self.ends, self.words
        last = [(0, -1)]
        for end, code in enumerate(codes, 1):
            target = following.get((state << 9) | code)
            while target is None and state:
                state = links[state]
                held = lengths[state]
                target = following.get((state << 9) | code)
            choice = last[0]
            if target is not None:
                state, held = target, held + 1
                s = ends[state]
                while s:
                    length = lengths[s]
                    if length <= held:
                        number, before = numbers[s], last[end - length][1]
                        if length == end or before >= 0 and fits((before << 32) | number):
                            choice = (length, number)
                            break
                    s = ends[links[s]]
            last.append(choice)
        return last


class LibrarySplitter:
    """Pieces of a chunk by the file's own normaliser and splitter, with the library's character tables."""

    def __init__(self, content: dict):
        from tokenizers import Tokenizer

        # The rules alone: the library needs a model to load them, but none is asked.
        rules = {k: content.get(k) for k in ("version", "normalizer", "pre_tokenizer")}
        none = {"truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None}
        self._rules = Tokenizer.from_str(json.dumps(rules | none | {"model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self._bytes = {letter: b for b, letter in enumerate(byte_letters())}

    def pieces(self, chunk: str) -> list[str]:
        found = self._rules.pre_tokenizer.pre_tokenize_str(self._rules.normalizer.normalize_str(chunk))
        return [bytes([self._bytes[c] for c in letters]).decode() for letters, _ in found]


class Vocabulary:
    """A BPE vocabulary file with byte letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self._splitter = LibrarySplitter(content)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self._plain = words.plain(self.special)
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        suffix = model.get("end_of_word_suffix") or ""
        bytes_of = {letter: b for b, letter in enumerate(byte_letters())}
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Ranks: position in the merge list; -1 for single symbols, which no merge makes.
        self.rank: dict[int, int] = dict.fromkeys(ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair_rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            merged = ids[left + right]
            if merged not in self.parts:
                self.rank[merged], self.parts[merged] = rank, (ids[left], ids[right])
            self.pair_rank[(ids[left] << 32) | ids[right]] = rank

        def symbols(token: str) -> str:
            ended = suffix and token.endswith(suffix) and len(token) > len(suffix)
            codes = [bytes_of[c] for c in (token[: -len(suffix)] if ended else token)]
            if ended:
                codes[-1] += 256
            return "".join(map(chr, codes))

        # Only tokens that the merges can reach take part.
        reached = {
            t: i for t, i in ids.items()
            if i not in self.parts or self._agree(*self.parts[i], self.rank[i])
        }
        self.automaton = SuffixAutomaton({symbols(t): i for t, i in reached.items()})
        self._pairs: dict[int, bool] = words.Kept(
            lambda key: self._agree(key >> 32, key & 0xFFFFFFFF, len(merges))
        )
        self.pieces = words.Kept(self._piece_bytes)
        self.chunks = words.Kept(self._chunk_bytes)

    def _agree(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge across the border of two tokens comes before the limit.

        The later of the two tokens' own merges is undone, again and again; a merge across the
        border counts only if it comes before everything undone so far. Of equal merges the left one
        comes first.
        """
        rank, parts, pair_rank = self.rank, self.parts, self.pair_rank
        while True:
            across = pair_rank.get((left << 32) | right)
            if across is not None and across < limit:
                return False
            made_left, made_right = rank[left], rank[right]
            if made_left > made_right:
                limit, left = made_left, parts[left][1]
            elif made_right >= 0:
                limit, right = made_right + 1, parts[right][0]
            else:
                return True

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece of the splitter."""
        codes = list(piece.encode())
        codes[-1] += 256
        last = self.automaton.chosen(codes, self._pairs.__getitem__)
        ids = []
        end = len(codes)
        while end:
            length, token = last[end]
            ids.append(token)
            end -= length
        ids.reverse()
        return ids

    def _piece_bytes(self, piece: str) -> bytes:
        ids = self.piece_ids(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk_bytes(self, chunk: str) -> bytes:
        if self._plain(chunk):
            known = self.pieces
            return b"".join([known[p] for p in words.pieces(chunk)])
        out = []
        for part, number in words.special_parts(chunk, self.special):
            if number is None:
                found = words.pieces(part) if self._plain(part) else self._splitter.pieces(part)
                out += [self.pieces[p] for p in found]
            else:
                out.append(number.to_bytes(4, "little"))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known = self.chunks
        return b"".join(map(known.__getitem__, words.chunks(text)))

    def forget(self) -> None:
        """Drops what was kept for pieces and chunks of earlier texts."""
        for kept in (self._pairs, self.pieces, self.chunks):
            kept.forget()

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks; the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker."""
    return Vocabulary(path)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one have about so many bytes at most."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for n, size in enumerate(sizes):
            held += size or 0
            if held >= most:
                yield batch.slice(start, n + 1 - start)
                start, held = n + 1, 0
        if start < len(sizes):
            yield batch.slice(start)


def transcode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string), one row per input row.

    A null text counts as empty and has no ids. Rows are independent: repeated rows and ids repeat
    in the result, a null doc_id stays null, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in slices(batches, 1):
            ids = [known.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [known.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and hashes of what ``transcode`` gives."""
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array), ids_sha256, decoded_sha256 for every row; nulls as in ``transcode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in slices(batches, 1):
            ids = [known.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    lists,
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(known.decode(i).encode()).hexdigest() for i in ids]),
                ],
                names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )
        known.forget()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return workers.mapped(
        rows, run, f"doc_id {kind}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"
    )
