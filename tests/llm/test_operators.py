import hashlib
import os
import random
import tempfile
import time
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from billsift import session
from billsift.llm import ann, bpe, edits, line_dedup, linking, mixing, packed, pii, quality, repeats, shingle_join, sketch, words
from billsift.llm.common import components
from billsift.llm.queries import VOCABULARY
from tests.llm import brute

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(VOCABULARY)


def by_id(frame):
    out = defaultdict(list)
    for row in frame.collect():
        out[row["doc_id"]].append(row)
    return out


def texts_of(corpus):
    """Distinct rows by id; the row without id last."""
    return {(d is None, d or 0): t for d, t, _, _ in corpus}


def test_components(spark):
    r = random.Random(2)
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    groups = brute.Groups()
    for a, b in edges:
        groups.link(a, b)
    r.shuffle(edges)
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {n: groups.root(n) for n in groups.parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bpe_equals_the_library(clashing, corpus, none, library):
    found = by_id(bpe.digests(bpe.transcode(clashing, VOCABULARY)))
    lists = by_id(bpe.encoded(clashing, VOCABULARY))
    assert sum(map(len, found.values())) == len(corpus)
    for d, text, _, _ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = found[d][0]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert lists[d][0]["ids"] == ids and lists[d][0]["decoded_sha256"] == row["decoded_sha256"]
    assert bpe.transcode(none, VOCABULARY).count() == 0


def test_bpe_of_random_letters(library):
    known = bpe.vocabulary(VOCABULARY)
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice("aeinrst'.,;!1ñéßABC \t\xa0") for _ in range(60))
        assert np.frombuffer(known.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_every_character(library):
    known = bpe.vocabulary(VOCABULARY)
    # All of the first two planes but surrogates, alone between letters and next to one another.
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in letters] + ["".join(letters[n : n + 7]) for n in range(0, len(letters), 7)]
    expected = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, expected, strict=True) if np.frombuffer(known.encode(t), "<u4").tolist() != e.ids]
    assert wrong == []


def test_plain_chunks_are_not_cut_at_special_strings(library, monkeypatch):
    known = bpe.Vocabulary(VOCABULARY)
    asked = []
    cut = words.special_parts
    monkeypatch.setattr(words, "special_parts", lambda chunk, special: asked.append(chunk) or cut(chunk, special))
    text = "Plain words, aԯ it's a<|endoftext|>b a԰ 日本語 a<|b"
    assert np.frombuffer(known.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == ["a<|endoftext|>b", "a԰", "日本語"]


def test_widths_of_ids():
    ids = np.array([0, 1, 2, 255, 256, 49_151, 65_535], np.uint64)
    for more in ([], [2**16], [2**63]):
        every = np.array([*ids.tolist(), *more], np.uint64)
        assert packed._widths(every)[:7].tolist() == [1, 1, 2, 8, 10, 20, 20]
    assert packed._widths(np.array([2**15 - 1, 2**15, 2**16, 2**63], np.uint64)).tolist() == [15, 20, 20, 64]


@pytest.mark.parametrize("most", [1, 2, 50, 70_000, 2**59, 2**64 - 1])
def test_packing_round_trip(most):
    r = np.random.default_rng(3)
    for n in (0, 1, 59, 61, 1023, 1024, 1025, 5000):
        ids = r.integers(0, most, n, dtype=np.uint64, endpoint=True)
        ids[: n // 3] //= np.uint64(1 + most // 7)
        starts, words = packed.pack(ids)
        assert (packed.unpack(starts, words, n) == ids).all()


def test_packed_files(spark, clashing, corpus, none, library):
    folder = packed.new_folder(spark)
    packed.write(clashing, VOCABULARY, folder, shards=3)
    rows = sorted(packed.digests(spark, folder).collect(), key=lambda x: x["start"])
    order = sorted(corpus, key=lambda c: (c[0] is not None, c[0] or 0, c[1] or ""))
    start = 0
    assert len(rows) == len(order)
    for row, (d, text, _, _) in zip(rows, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packed.END_ID]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (d, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = packed.new_folder(spark)
    packed.write(none, VOCABULARY, empty)
    assert packed.digests(spark, empty).count() == 0


def test_line_dedup(clashing, corpus, none):
    # A null doc_id comes first.
    texts = {(d is not None, d or 0): t for d, t, _, _ in corpus}
    expected = brute.removed_lines(texts)
    found = by_id(line_dedup.removals(clashing))
    cleaned = by_id(line_dedup.cleaned(clashing))
    for key, text in texts.items():
        d = key[1] if key[0] else None
        worded = [s for s in (text or "").split("\n") if s and not s.isspace()]
        for row in found[d]:
            assert row["removed_lines"] == ",".join(map(str, expected[key])), (d, text)
            assert (row["n_lines"], row["n_removed"]) == (len(worded), len(expected[key]))
        lines = [s for n, s in enumerate((text or "").split("\n")) if n not in expected[key]]
        gone = bool(worded) and len(expected[key]) == len(worded)
        assert [r["text"] for r in cleaned[d][:1]] == ([] if gone else [None if text is None else "\n".join(lines)])
    assert sum(map(len, found.values())) == len(corpus)
    assert line_dedup.cleaned(clashing).columns == clashing.columns
    assert line_dedup.removals(none).count() == 0 and line_dedup.cleaned(none).count() == 0


def test_line_dedup_links_inner_members(spark, monkeypatch):
    """Two groups of edited copies in one bucket that a single pair connects, neither line of it a group's first."""
    real = line_dedup.signatures

    def signed(lines):
        banded, agreed = real(lines)
        for n, line in enumerate(lines):
            banded[n] = shingle_join.mixed(np.arange(banded.shape[1], dtype=np.uint64) + np.uint64(zlib.crc32(line.encode()) << 8))
            banded[n, 0] = ord(line[0])
            if sum(c.isdigit() for c in line) > 2:
                banded[n, 1] = 1000 + ord(line[0])
        return banded, agreed * np.uint8(0)

    monkeypatch.setattr(line_dedup, "signatures", signed)
    r = random.Random(11)
    texts = {}
    for family in range(12):
        letters = [chr(ord("a") + family), *(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(99))]
        spots = list(range(5, 95, 5))
        r.shuffle(spots)
        p, q, u, s, *rest = spots
        edits = [(), (p,), (p, q, u), (p, q, u, s)]
        edits += [(e,) for e in rest[:7]] + [(p, q, u, s, e) for e in rest[7:]]
        r.shuffle(edits)
        for n, places in enumerate(edits):
            line = list(letters)
            for at in places:
                line[at] = str(at % 10)
            texts[family * 100 + n] = "".join(line)
    expected = brute.removed_lines({(True, d): t for d, t in texts.items()})
    assert len(expected) == 12 * 17
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = {x["doc_id"]: x["n_removed"] for x in line_dedup.removals(frame).collect()}
    assert found == {d: len(expected.get((True, d), [])) for d in texts}


def test_line_dedup_of_repeated_phrases(spark):
    """Lines of very different lengths with the same shingles."""
    r = random.Random(12)
    phrase = "".join(r.choice("abcdefgh ") for _ in range(60)).strip() + "; "
    texts = [
        "-" * 40 + "\n" + "-" * 80 + "\n-----", "ha " * 9 + "ha", "HA " * 30 + "ha", "+---" * 5 + "+\n" + "+---" * 20 + "+",
        phrase * 2, phrase * 5, phrase, "a" * 6 + "b", "a" * 9 + "c", "ab" * 4, "ab" * 400,
    ]
    lines = [line_dedup.normalized(s) for t in texts for s in t.split("\n")]
    assert line_dedup.distinct_counts(lines).tolist() == [len(line_dedup.grams(s)) for s in lines]
    expected = brute.removed_lines({(True, n): t for n, t in enumerate(texts)})
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {x["doc_id"]: x["removed_lines"] for x in line_dedup.removals(frame).collect()}
    assert expected[(True, 0)] == [1, 2] and expected[(True, 2)] == [0] and expected[(True, 5)] == [0]
    assert found == {n: ",".join(map(str, expected.get((True, n), []))) for n in range(len(texts))}


def test_repeated_passages(clashing, corpus, none):
    # Repeated rows are copies of each other, so each row counts.
    texts = {n: t for n, (_, t, _, _) in enumerate(corpus)}
    expected = brute.repeats(texts)
    found = by_id(repeats.digests(clashing))
    for n, (d, text, _, _) in enumerate(corpus):
        kept, removed, spans = expected[n]
        for row in found[d]:
            assert row["n_bytes"] == len((text or "").encode())
            assert (row["n_removed"], row["n_spans"]) == (removed, spans), (d, row)
            assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert repeats.digests(none).count() == 0


def test_repeated_passages_keep_the_first(spark, monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    other = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(1, text), (2, other + text[100:600]), (3, text), (4, other[:350] + "zz")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (repeats.MOST_PIECES, 0):
        monkeypatch.setattr(repeats, "MOST_PIECES", most)
        found = by_id(repeats.digests(frame, keep_first=True))
        assert [found[d][0]["n_removed"] for d in (1, 2, 3, 4)] == [0, 500, 900, 350]
        expected = brute.repeats(dict(rows))
        found = by_id(repeats.digests(frame))
        assert [found[d][0]["n_removed"] for d in (1, 2, 3, 4)] == [expected[d][1] for d in (1, 2, 3, 4)]


def test_repeated_passages_remove_measured_pieces(docs, monkeypatch):
    removed = []
    monkeypatch.setattr(repeats, "discard", lambda *frames: removed.extend(frames), raising=False)
    _, rows = repeats.removals(docs)
    assert [f.columns for f in removed] == [["doc_id", "digest", "n_bytes", "sha256", "anchors", "hashed", "first", "last"]]
    assert rows.columns == ["doc_id", "digest", "n_bytes"]


def test_previous_factors_of_periodic_text():
    for text in (b"ab" * 300, b"x" * 450, bytes(range(256)) * 3):
        symbols = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
        repeated, source = repeats.previous_factors(np.concatenate([symbols, np.zeros(1, np.uint64)]))
        n = len(text) - repeats.LENGTH + 1
        seen = set()
        for i in range(n):
            assert repeated[i] == (text[i : i + repeats.LENGTH] in seen)
            seen.add(text[i : i + repeats.LENGTH])


def test_nearest_vectors_of_clusters(spark):
    """Queries outside a tight cluster of a third of the vectors find theirs as well."""
    r = np.random.default_rng(6)
    matrix = r.standard_normal((2000, 64))
    matrix[r.permutation(2000)[:666]] = r.standard_normal(64) + 0.1 * r.standard_normal((666, 64))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(matrix)], "vec_id bigint, embedding array<double>")
    found = defaultdict(set)
    for x in ann.nearest(frame, F.col("vec_id") % 40 == 0).collect():
        found[x["query_id"]].add(x["vec_id"])
    recall = []
    for q in range(0, 2000, 40):
        scores = matrix @ matrix[q]
        scores[q] = -9
        recall.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


def test_nearest_vectors(spark):
    r = np.random.default_rng(1)
    matrix = r.standard_normal((600, 16)) * r.uniform(0.5, 2.0, (600, 1))
    matrix[200:400] = matrix[200]
    rows = [(n, [float(x) for x in v], 1) for n, v in enumerate(matrix)]
    odd = [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [None] + [1.0] * 15, 1),
           (None, [1.0] * 16, 1), rows[7]]
    schema = "vec_id bigint, embedding array<double>, entry int"
    found = defaultdict(list)
    for x in ann.nearest(spark.createDataFrame(rows + odd, schema), F.col("vec_id") % 20 == 0).collect():
        found[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    hits = total = 0
    assert sorted(found) == list(range(0, 600, 20))
    for q, hit in found.items():
        hit.sort()
        scores = matrix @ matrix[q]
        assert [h[0] for h in hit] == list(range(1, len(hit) + 1)) and q not in {h[1] for h in hit}
        assert [(-s, i) for _, i, s in hit] == sorted((-s, i) for _, i, s in hit)
        best = [i for i in sorted(range(600), key=lambda i: (-round(scores[i], 9), i)) if i != q][:20]
        hits += len(set(best) & {h[1] for h in hit})
        total += 20
    assert hits >= 0.9 * total
    few = ann.nearest(spark.createDataFrame(rows[:3], schema), F.col("vec_id") % 20 == 0)
    assert {x["vec_id"] for x in few.collect()} <= {1, 2}
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_counts(spark, clashing, corpus, none):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(20)] + [(None, 1, 0), (3, None, 0)], LABELS)
    found = by_id(quality.verdicts(clashing, labels))
    for d, text, _, _ in corpus:
        row = found[d][0]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute.counts(text)
        assert row["base_failed"] == (row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"])
        # Too few labels for any cutoff.
        assert row["kept"] == (not row["base_failed"])
    assert quality.filtered(clashing, labels).columns == clashing.columns
    empty_labels = spark.createDataFrame([], LABELS)
    assert quality.verdicts(none, labels).count() == 0
    assert quality.verdicts(clashing, empty_labels).filter("not kept and not base_failed").count() == 0


def test_binomial_tail_and_cutoffs():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((10, 3, 0.2), (500, 4, 0.01), (2000, 0, 0.003), (7, 7, 0.5), (3000, 300, 0.09)):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert abs(float(exact) - quality.binomial_at_most(k, n, p)) < 1e-11
    bins = np.arange(10)
    good = np.array([4000, 900, 60, 20, 10, 5, 3, 1, 1, 0])
    bad = np.array([50, 20, 20, 20, 20, 20, 20, 20, 20, 200])
    cutoff = quality.choose_cutoff(bins, good, bad, 0.01, 0.001)
    lost = int(good[cutoff:].sum())
    assert quality.binomial_at_most(lost, 5000, 0.01) <= 0.001
    assert quality.choose_cutoff(bins, good // 100, bad, 0.01, 0.001) is None
    assert quality.choose_cutoff(bins, good, bad * 0, 0.01, 0.001) is None


def test_false_rejection_keeps_its_bound():
    r = np.random.default_rng(9)
    broken = 0
    for _ in range(200):
        values = np.minimum(r.geometric(0.05, 3000), 400)
        bins, good = np.unique(values, return_counts=True)
        bad = np.ones(len(bins), np.int64)
        cutoff = quality.choose_cutoff(bins, good, bad, 0.02, 0.05, price=0.0)
        broken += cutoff is not None and 0.95 ** (cutoff - 1) > 0.02
    assert broken <= 200 * 0.05 * 2


def test_personal_data(clashing, corpus, none):
    names = [*pii.KINDS, pii.TERM]
    found = by_id(pii.reported(clashing))
    for d, text, _, _ in corpus:
        base = brute.personal(text)
        row = found[d][0]
        written = [f"{names[k]}:{s}:{e}" for s, k, e, _ in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest(), (text or "")[:80]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == n for b in base) for n in range(4)]
        assert [s for s in row["spans"].split(",") if s and not s.startswith(pii.TERM)] == written
        if not base:
            assert row["spans"] == ""
    assert sum(map(len, found.values())) == len(corpus)
    assert pii.reported(none).count() == 0


def test_revealing_terms(spark):
    rows = [(n, f"notes {n} of the day: zanzibarium wrote to anna.b@example.org today number{n}") for n in range(6)]
    rows += [(10 + n, f"the day was notes today wrote number{n}") for n in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = by_id(pii.reported(frame))
    for d, text in rows:
        start = text.find("zanzibarium")
        spans = found[d][0]["spans"]
        assert (f"term:{start}:{start + 11}" in spans) == (start >= 0)
        assert found[d][0]["n_term"] == int(start >= 0)
    clean = by_id(pii.sanitised(frame))
    assert clean[2][0]["text"] == "notes 2 of the day:  wrote to [email] today number2"
    assert clean[12][0]["text"] == rows[8][1]


def test_revealing_terms_of_copied_texts(spark):
    """Copies of a text are one text for the entity, its terms and the total."""
    text = "of the day: zanzibarium wrote to anna.b@example.org today number1"
    rows = [(n, text) for n in range(40)] + [(50, text.replace("number1", "number2"))]
    rows += [(100 + n, f"the day was notes today wrote number{n}") for n in range(60)]
    found = by_id(pii.reported(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for d, text in rows:
        start = text.find("zanzibarium")
        assert (f"term:{start}:{start + 11}" in found[d][0]["spans"]) == (start >= 0)
        assert found[d][0]["n_term"] == int(start >= 0)


def test_revealing_terms_beside_other_numbers(spark):
    """Numbers that are no card, and long words, do not end the context of one."""
    long = "zanzibarium" * 12
    rows = [(n, f"note{n} quaggaville 2024 card 4111 1111 1111 1111 until 12 2031 {long} number{n}") for n in range(4)]
    rows += [(10 + n, f"the card was 2024 until 12 2031 number{n}") for n in range(60)]
    found = by_id(pii.reported(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for d, text in rows:
        written = [f"term:{text.find(t)}:{text.find(t) + len(t)}" for t in ("quaggaville", long) if t in text]
        assert [s for s in found[d][0]["spans"].split(",") if s.startswith("term")] == written
        assert found[d][0]["n_card"] == len(written) // 2


def test_edit_counts(spark, clashing, corpus, none, library):
    def size(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    r = random.Random(3)
    rows, expected = [], {}
    for n, (_, text, _, _) in enumerate(corpus):
        after, changes = text or "", []
        for _ in range(25):
            start, length = r.randint(0, len(after) + 3), r.choice([0, 1, 3, 7, 400])
            put = r.choice(["", " ", "ab", " new word ", "\x1c<|endoftext|>", " é"])
            changes.append((start, length, put))
            start = min(start, len(after))
            after = after[:start] + put + after[start + length :]
        rows.append((n, text, changes))
        expected[n] = (25, size(text or ""), size(after))
    rows += [(900, "some text", None), (901, "some text", [(None, None, None), (2, 1, None)])]
    expected |= {900: (0, size("some text"), size("some text")), 901: (2, size("some text"), size("soe text"))}
    frame = spark.createDataFrame(rows, f"doc_id bigint, text string, edits {edits.EDITS}").withColumn("id", F.lit(1))
    for row in edits.counts(frame, VOCABULARY).collect():
        assert (row["n_edits"], row["n_before"], row["n_after"]) == expected[row["doc_id"]], row
    planned = edits.counts(edits.planned_edits(clashing), VOCABULARY)
    assert planned.count() == len(corpus) and planned.filter("n_edits < 1").count() == 0
    assert edits.counts(edits.planned_edits(none), VOCABULARY).count() == 0


def test_an_edit_counts_little_of_a_long_text():
    text = "some words of a text " * 5000
    tree = edits.CountTree(text, edits._counter(VOCABULARY))
    tree.edit(50_000, 4, "other")
    assert tree.recounted < 4 * edits.LEAF


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("frequent", [shingle_join.FREQUENT, 1])
def test_shingle_join(clashing, corpus, none, width, percent, frequent, monkeypatch):
    # With the lower bounds nearly all shingles are indexed as combinations.
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    monkeypatch.setattr(shingle_join, "VERY_FREQUENT", frequent * 4)
    sets = {k: brute.shingle_set(t, width) for k, t in texts_of(corpus).items()}
    roots = brute.jaccard_components(sets, percent)
    found = by_id(shingle_join.joined(clashing, width, percent))
    for (null, d), root in roots.items():
        for row in found[None if null else d]:
            assert row["n_shingles"] == len(sets[(null, d)])
            assert row["component_id"] == (None if root[0] else root[1]), (d, root)
    if frequent > 1:
        kept = shingle_join.one_per_component(clashing, width, percent)
        gone = {d for (null, d), root in roots.items() if root != (null, d) and not null}
        assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _, _ in corpus} - gone
        assert kept.columns == clashing.columns
        assert shingle_join.joined(none, width, percent).count() == 0


def test_index_finds_every_similar_pair():
    r = random.Random(11)
    words = [f"w{n}" for n in range(4000)]
    levels = np.random.default_rng(2).choice(np.array([1, 5, 12], np.uint8), 1 << shingle_join.ORDER_BITS)
    for percent in (80, 85, 95):
        for n in (4, 5, 6, 7, 8, 13, 15, 16, 31, 60, 63, 64, 130, 500):
            for _ in range(6):
                one = r.sample(words, n)
                change = r.randint(0, max(1, n * (100 - percent) // 100))
                two = one[: n - change] + [f"x{k}" for k in range(r.randint(0, change))]
                a = np.unique([shingle_join.shingles(w, 1)[0] for w in one])
                b = np.unique([shingle_join.shingles(w, 1)[0] for w in two])
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
                    continue
                x, y = (shingle_join.entries(g, levels, shingle_join.ORDER_BITS, 0.0, percent) for g in (a, b))
                assert len(np.intersect1d(x, y)), (percent, n)


def test_source_mix(clashing, corpus, none):
    rows = mixing.taken(clashing, block_words=16).collect()
    again = mixing.taken(clashing.repartition(5), block_words=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(corpus)
    sizes, source = defaultdict(int), {}
    for d, text, _, s in corpus:
        sizes[s] += len(brute.WORD.findall(text or ""))
        source[(d, len(brute.WORD.findall(text or "")))] = s
    targets = brute.mix_targets(sizes)
    got = defaultdict(int)
    for row in rows:
        s = source[(row["doc_id"], row["size"])]
        assert row["source_size"] == sizes[s] and abs(row["target"] - targets[s]) < 1e-6
        assert 0 <= row["taken"] <= 3 * row["size"]
        got[s] += row["taken"]
    assert all(abs(got[s] - targets[s]) <= 1 for s in sizes)
    assert mixing.taken(none).count() == 0
    assert mixing.repeated(clashing).columns == clashing.columns and mixing.repeated(none).count() == 0


def test_schedule_is_even(spark):
    sources = spark.createDataFrame(
        [("a", 0, 4000, 5000.0), ("b", 1, 9000, 2500.0), ("c", 2, 10, 30.0), ("d", 3, 2, 1.0)],
        "source string, source_no int, source_size bigint, target double",
    )
    slots = sorted((r["slot"], r["source_no"], r["rank"]) for r in mixing.schedule(sources, 1).collect())
    total = 7531.0
    seen = defaultdict(int)
    for n, (_, s, rank) in enumerate(slots, 1):
        assert rank == seen[s]
        seen[s] += 1
        for no, target in ((0, 5000.0), (1, 2500.0), (2, 30.0)):
            assert abs(seen[no] - n * target / total) < 6
    assert set(seen) == {0, 1, 2, 3}


def test_counted_hashes(spark):
    from billsift.llm import sketch

    r = np.random.default_rng(5)
    hashes = np.concatenate([r.integers(0, 2**64, 3000, dtype=np.uint64), np.full(400, 77, np.uint64), np.full(2, 2**64 - 1, np.uint64)])
    hashes = np.concatenate([hashes, np.repeat(r.integers(0, 2**46, 20_000, dtype=np.uint64), 2)])
    frame = spark.createDataFrame([(int(h.view(np.int64)),) for h in hashes], "h bigint").repartition(3)

    def of(batch):
        return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    for bits in (16, 20, 24):
        expected = np.bincount(sketch.slots_of(hashes, bits).astype(np.int64), minlength=1 << bits)
        assert (sketch.levels(frame, of, bits).value == np.ceil(np.log2(expected + 1))).all()
        table = sketch.repeated(frame, of, bits).value
        assert (sketch.is_repeated(table, hashes, bits) == (expected[sketch.slots_of(hashes, bits)] > 1)).all()
    kept = sketch.probably(frame, "h", frame.limit(10), 24)
    assert {x["h"] for x in frame.limit(10).collect()} <= {x["h"] for x in kept.collect()}


def test_signs_lose_nothing():
    """Signs may exclude only pairs below the similarity, and exclude most of those far below it."""
    rng = np.random.default_rng(7)
    for bits, percent in ((512, 80), (1024, 85)):
        excluded = 0
        for n in (3, 40, 160, 3000):
            base = rng.integers(0, 1 << 64, 2 * n, np.uint64)
            for share in (0.1, 0.5, 0.8, 0.9, 1.0):
                a, b = np.unique(base[:n]), np.unique(base[n - int(share * n) : 2 * n - int(share * n)])
                both = len(np.intersect1d(a, b))
                differing = int(np.bitwise_count(linking.sign(a, bits) ^ linking.sign(b, bits)).sum())
                similar = 100 * both >= percent * (len(a) + len(b) - both)
                may = differing * (100 + percent) <= (len(a) + len(b)) * (100 - percent)
                assert may or not similar
                excluded += not may and n in (40, 160) and share <= 0.5
        assert excluded == 4


def test_signs_of_lines(spark):
    lines = ["a", "abcdefg", "ha " * 40, "the quick brown fox jumps", "the quick brown dog jumps", "x" * 900 + "y"]
    _, signs = line_dedup.signatures(lines)
    assert [linking.sign(line_dedup.grams(s), line_dedup.SIGN_BITS).tolist() for s in lines] == signs.tolist()
    rows = [(n, s.view(np.int64).tolist(), len(line_dedup.grams(lines[n]))) for n, s in enumerate(signs)]
    frame = spark.createDataFrame(rows, "n int, sign array<bigint>, size bigint")
    pairs = frame.alias("x").crossJoin(frame.alias("y"))
    may = linking.may_be_similar(
        F.col("x.sign"), F.col("y.sign"), F.col("x.size") + F.col("y.size"), line_dedup.SIGN_BITS, line_dedup.PERCENT
    )
    found = {(r[0], r[1]): r[2] for r in pairs.select("x.n", "y.n", may).collect()}
    expected = {
        (n, m): int(np.bitwise_count(signs[n] ^ signs[m]).sum()) * (100 + line_dedup.PERCENT) <= (one + other) * (100 - line_dedup.PERCENT)
        for n, _, one in rows for m, _, other in rows
    }
    assert found == expected and list(found.values()).count(False) >= 20


def test_crossing_pairs_are_excluded_in_their_join(spark, monkeypatch):
    """Texts that share a bucket and little else are never handed on as pairs."""
    r = random.Random(3)
    texts = {n: " ".join(f"w{r.randrange(10 ** 9)}" for _ in range(60)) for n in range(200)}
    texts[200] = texts[5] + " end"
    signs = [(n, linking.sign(shingle_join.shingles(t)).view(np.int64).tolist()) for n, t in texts.items()]
    buckets = spark.createDataFrame([(1, n, len(shingle_join.shingles(t))) for n, t in texts.items()], "bucket bigint, id bigint, size bigint")
    compared = []
    real = linking.compared
    monkeypatch.setattr(linking, "compared", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    roots = linking.linked(
        buckets, spark.createDataFrame(signs, "id bigint, sign array<bigint>"),
        lambda ids: frame.join(ids, "id", "left_semi"), shingle_join.shingles, 85,
    )
    assert {x["node"]: x["root"] for x in roots.collect()} == {5: 5, 200: 5}
    assert sum(compared) <= 3


def test_pairs_of_large_buckets_are_told_once(spark):
    """Near copies that share many large buckets, some of them only small or late ones, give the brute-force components."""
    r = random.Random(5)
    base = [f"w{r.randrange(10 ** 9)}" for _ in range(80)]

    def edited(places):
        return " ".join(f"e{r.randrange(10 ** 9)}" if n in places else w for n, w in enumerate(base))

    texts = {0: edited(set(range(0, 80, 9)))} | {n: edited({r.randrange(1, 79)}) for n in range(1, 61)}
    texts |= {n: edited(set(r.sample(range(1, 79), 3))) for n in range(61, 91)}
    sets = {n: set(shingle_join.shingles(t).tolist()) for n, t in texts.items()}
    places = {n: set(r.sample(range(60), 25)) for n in texts} | {7: {100}, 8: {100, *range(30)}, 9: {*range(60)}}
    groups = brute.Groups()
    for a in texts:
        for b in range(a + 1, len(texts)):
            if places[a] & places[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                groups.link(a, b)
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    roots = linking.linked(
        spark.createDataFrame([(k, n, len(sets[n])) for n in texts for k in places[n]], "bucket bigint, id bigint, size bigint"),
        spark.createDataFrame([(n, linking.sign(shingle_join.shingles(t)).view(np.int64).tolist()) for n, t in texts.items()], "id bigint, sign array<bigint>"),
        lambda ids: frame.join(ids, "id", "left_semi"), shingle_join.shingles, 85,
    )
    assert {x["node"]: x["root"] for x in roots.collect()} == {n: groups.root(n) for n in groups.parent}


def test_stored_rows_leave_no_shuffle_files(spark):
    """What is shuffled for a stored table goes with the statement that stores it."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in files.getAllFiles().mkString("|").split("|") if "/shuffle_" in name}

    setting = spark.conf.get(session._SHUFFLE_CLEANUP, None)
    old = shuffled()
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"))
    kept = session.cut_lineage(rows.repartition(5, "k").groupBy("k").count())
    deadline = time.time() + 20
    while shuffled() - old and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffled() - old
    assert kept.agg(F.sum("count")).first()[0] == 2000
    assert spark.conf.get(session._SHUFFLE_CLEANUP, None) == setting


def test_line_dedup_signs_a_line_once(spark, monkeypatch):
    """Copies of a line need no signature of their own, and tables of a line's bands go when they are read."""
    folder = tempfile.mkdtemp()
    real = line_dedup.signatures

    def counted(lines):
        for line in lines:
            with open(os.path.join(folder, f"{uuid.uuid4().hex}"), "w") as out:
                out.write(line)
        return real(lines)

    monkeypatch.setattr(line_dedup, "signatures", counted)
    texts = {d: f"a line that all of them have\nanother line of number {d // 4} alone" for d in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = {x["doc_id"]: x["removed_lines"] for x in line_dedup.removals(frame).collect()}
    signed = [open(os.path.join(folder, name)).read() for name in os.listdir(folder)]
    assert sorted(signed) == sorted({line for text in texts.values() for line in text.split("\n")})
    expected = brute.removed_lines({(True, d): t for d, t in texts.items()})
    assert found == {d: ",".join(map(str, expected.get((True, d), []))) for d in texts}


def test_hashes_in_ranges(spark, monkeypatch):
    """All values that recur stay, whatever the ranges; few others do although they are many more than the slots of one table."""
    r = np.random.default_rng(3)
    once = r.integers(0, 2**64, 200_000, dtype=np.uint64).view(np.int64)
    twice = r.integers(0, 2**64, 500, dtype=np.uint64).view(np.int64)
    values = np.concatenate([once, twice, twice])
    r.shuffle(values)
    rows = [(n, part.tolist()) for n, part in enumerate(np.array_split(values, 400))] + [(400, [])]
    frame = spark.createDataFrame(rows, "id bigint, h array<bigint>").repartition(3)
    parts = sketch.recurring(frame, "h", "bucket", len(values), 16)
    assert len(parts) == -(-sketch.SPARE * len(values) >> 16)
    found = [(x["bucket"], x["id"]) for part in parts for x in part.collect()]
    known = {(v, n) for n, part in rows for v in part}
    assert set(found) <= known
    again = set(twice.tolist())
    assert {(v, n) for v, n in known if v in again} <= set(found)
    assert len(found) < 0.3 * len(values)


def test_cleaned_lines_shuffle_a_text_once(clashing):
    rows = line_dedup.cleaned(clashing)._jdf.queryExecution().analyzed().toString()
    assert "struct(doc_id" in rows and "text, text#" not in rows
