import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from billsift.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _check(rows, docs, library):
    """Every id in one piece, sequences without holes, full or a power of two."""
    expected = defaultdict(int)
    for doc_id, text in docs:
        expected[doc_id, np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    sequences, of_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        of_doc[r["doc_id"], r["doc_tokens"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for held in sequences.values():
        end = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end & (end - 1) == 0 and end <= packing.WINDOW
    # Repeated documents share an id: their pieces start at the same places as often as they occur.
    for (doc_id, ids), times in expected.items():
        got = np.zeros(len(ids) // 4, int)
        for r in of_doc[doc_id, len(ids) // 4]:
            assert r["ids"] == ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
            got[r["start"] : r["start"] + r["length"]] += 1
        assert (got == times).all()
    assert sum(r["length"] for r in rows) == sum(len(i) // 4 * n for (_, i), n in expected.items())
    return sequences


@pytest.mark.parametrize("shard", [4_000_000, 3000])
def test_pieces_hold_every_id_once(spark, clashing, corpus, library, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_IDS", shard)
    rows = packing.packed(clashing, PATH).collect()
    _check(rows, [(d, t) for d, t, _, _ in corpus], library)


def test_related_documents_share_sequences(spark, library):
    """A seed is followed by those that share its rare words, whatever the order of the documents."""
    topics = ["zebra quagga savanna", "turbine rotor blade", "sonata fugue cello", "glacier moraine icefall"]
    docs = [(n, f"{topics[n % 4]} and the of to {topics[n % 4]} " + "the of and to a in " * 50) for n in range(400)]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id bigint, text string"), PATH).collect()
    sequences = _check(rows, docs, library)
    mixed = sum(len({r["doc_id"] % 4 for r in held}) > 1 for held in sequences.values())
    assert len(sequences) > 50 and mixed <= 8


def test_a_large_group_of_copies_and_many_short_documents(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 20_000)
    docs = [(n, "the same words in every copy of this text " * 7) for n in range(1500)] + [(5000 + n, None if n % 2 else "x") for n in range(1500)]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id bigint, text string"), PATH).collect()
    sequences = _check(rows, docs, library)
    short = sum(sum(r["length"] for r in held) < packing.WINDOW for held in sequences.values())
    assert short <= 10 * 16


def test_encoder_equals_the_library(library):
    known = packing.encoder(PATH)
    texts = ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", " " * 3000, "x" * 20_000, "  \x1c\x85 \xa0 é日本 😀 don't'll", "",
             "^" * 50_000, "1 234 \n\n  \t"]
    texts += ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 4096)]
    for text in texts:
        assert known.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, docs, none, tmp_path):
    docs.limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_retrieval_packing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = {(r["doc_id"], r["start"], r["doc_tokens"]): r["ids_crc32"] for r in found.collect()}
    for r in packing.packed(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH).collect():
        assert sums[r["doc_id"], r["start"], r["doc_tokens"]] == zlib.crc32(r["ids"])
    assert packing.packed(none, PATH).count() == 0
