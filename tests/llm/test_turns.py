import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from billsift.llm import queries, turns
from tests.llm import brute

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _ordered(rows):
    def key(row):
        return row[0] is not None, row[0] or 0, row[1], hashlib.md5(row[2].encode()).hexdigest()

    return sorted(rows, key=key)


def _expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: brute.repaired_conversation(_ordered(held)) for conv, held in groups.items()}


def _found(frame):
    rows = frame.collect()
    out = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def _rows(r, convs, most):
    texts = ["Fine.", "Good!", "Is it?", "cut off", "", " \t\n", "Fine. \n", "日本。", "x" * 5000 + ".", None]
    roles = ["user", "assistant", "system", "tool", "", None, "unicorn", "User"]
    out = []
    for conv in convs:
        for turn in range(r.randint(1, most)):
            text = r.choice(texts) if r.random() < 0.4 else f"Text {r.random()}" + r.choice([".", "!", "", "?"])
            turn = r.choice([turn, turn, turn, turn + 3, None])
            row = (conv, turn, r.choice(roles[:3] if r.random() < 0.8 else roles), text)
            out += [row] * r.choice([1, 1, 1, 1, 2, 3])
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_repairs_equal_brute_force(spark, monkeypatch, block):
    """Also with conversations that span many blocks."""
    monkeypatch.setattr(turns, "BLOCK", block)
    rows = _rows(random.Random(4), [*range(60), None], 9) + _rows(random.Random(5), [100, 101], 40)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({n: F.lit(1) for n in ("block", "at", "nth", "place")})
    assert _found(turns.digests(frame)) == _expected(rows)


def test_one_conversation_of_many_rows(spark):
    r = random.Random(8)
    rows = [(7, t, r.choice(["user", "assistant", "user", "assistant", "tool"]), f"Line {t}" + r.choice("..!,")) for t in range(9000)]
    rows += [(7, 5000, "user", "again.")] * 3000 + [(8, 0, "user", "a.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert _found(turns.digests(frame))[7][0] == 0
    small = [x for x in rows if x[1] < 600] + [(7, 700, "user", "again.")] * 200
    assert _found(turns.digests(spark.createDataFrame(small, SCHEMA))) == _expected(small)
    found = _found(turns.digests(frame))
    assert found[7][2] == 2999 and len(found[7][6]) >= 12000


def test_repaired_rows_follow_the_grammar(spark):
    rows = _rows(random.Random(6), range(30), 8)
    out = turns.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = _expected(rows)
    by_conv = defaultdict(list)
    for x in sorted(out, key=lambda x: (x["block"], x["at"], x["nth"])):
        by_conv[x["conv_id"]].append(x)
    for conv, held in by_conv.items():
        assert "".join(x["edit"] for x in held) == expected[conv][6]
        lines = [f"{x['role']}:{x['text']}" for x in held if x["edit"] != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == expected[conv][7]
        assert all((x["turn"] is None) for x in held if x["edit"] == "I")


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. {c}! {t}? end.") for c in range(40) for t in range(8)] + [(None, None, None, None), (3, None, "user", "x.")]
    found = sorted(map(tuple, turns.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    expected = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        fate = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        expected += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    assert found == sorted(expected, key=str)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turns.digests(none).count() == 0 and turns.repaired(none).count() == 0
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id bigint")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert _found(turns.digests(none, ids)) == {1: empty, None: empty}


def test_query_equals_its_sql(spark, tmp_path):
    # One row per conversation and turn: the statement leaves the order of others to the engine.
    rows = list({x[:2]: x for x in _rows(random.Random(9), [*range(80), None], 9)}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = _found(queries.op13_turn_repair(spark, str(tmp_path)))
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    relation = connection.sql(queries.STATEMENTS["op13_turn_repair"])
    expected = {x[0]: x[1:] for x in relation.select(", ".join(("conv_id", *NAMES))).fetchall()}
    assert found == expected and len(found) == 81
