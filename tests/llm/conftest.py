import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ("id", "root", "bucket", "counts", "row", "digest", "place", "edits", "size", "text_key", "kind_no")


def _prose(r: random.Random, words: int) -> str:
    return " ".join("".join(r.choice("abcdeéßñ") for _ in range(r.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): near copies, shared passages and lines, personal data, odd texts."""
    r = random.Random(7)
    base = _prose(r, 120)
    passage = _prose(r, 60)
    line = "A line that many documents have, with some words in it"
    texts = [base, base]
    for n in range(12):
        words = base.split(" ")
        words[10 * n % 110] = f"changed{n}"
        texts.append(" ".join(words))
    texts += [_prose(r, 30) + " " + passage + " " + _prose(r, 20) for _ in range(6)]
    texts += [line + "\n" + _prose(r, 25) + "\n\n" + line.upper() + "\n" + line.replace("many", "most") for _ in range(4)]
    texts += [
        None, "", "   \n\t ", "one", "one two three", "ONE Two three", "a" * 700, "ab " * 900, "x\x1cy\x85z w",
        "write to bob.smith@example.com or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.1 and 999.1.1.1",
        "Bob Smithson at bob.smith@example.com\ncall +1 2 3", "..a@b.co..d@e.f_g@h.ij 1.2.3.4.5.6.7.8 0000000000000000",
        "<|endoftext|> İΣ 日本語 😀 it's don't", "#*$%&|<>" * 4, "word " * 25 + "!",
        "long " + _prose(r, 6000),
    ]
    rows = [(n, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s10", None])) for n, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base + " end", "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(d, t, lang, source, len(t or "")) for d, t, lang, source in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with more columns, named as the operators name theirs."""
    return docs.withColumns({name: F.lit(n) for n, name in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
