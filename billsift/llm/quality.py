"""Quality rules whose cutoffs keep a bound on false rejection.

Base rules need no labels. The learned rules compare one measure with a cutoff per stratum (language).
A cutoff is admissible if an exact binomial bound over the labelled holdout shows that it rejects at
most its share of good documents. Cutoffs of one measure are tested from the loosest to the
strictest and testing stops at the first that fails, which needs no correction; over measures and strata
the error level is divided by their number. So with probability ``1 - DELTA`` no stratum loses more than
``ALPHA`` of its good documents to the learned rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billsift.llm import workers
from billsift.llm.common import stored

#: Largest share of good documents a stratum may lose to all learned rules together.
ALPHA = 0.02
#: Probability that some stratum loses more.
DELTA = 0.05
#: Rejected share of bad documents that one rejected share of good ones must buy.
PRICE = 10.0
#: Measures are whole numbers from 0 to this; larger values count as this one.
TOP = 5000

MEASURES = ("symbols", "duplicate_lines", "repeated_words", "capitals", "long_words", "short_words")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))


def _repeat_words(found: list[bytes], width: int = 8) -> int:
    """Words in windows of eight words that the text holds twice or more."""
    n = len(found)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, n)
    if len(numbers) == n:
        return 0
    # Numbers of pairs, of fours and of eights: equal numbers mean equal windows.
    step = 1
    while step < width:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        step *= 2
    often = np.bincount(ids)[ids] > 1
    covered = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of the result columns."""
    content = (text or "").encode("utf-8", "surrogatepass")
    found = content.split()
    lines = [line for line in content.split(b"\n") if line.strip()]
    return (
        len(found),
        len(content.translate(None, _NOT_COUNTED)),
        len(content) - len(content.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(found),
        len(lines),
        len(content) - len(content.translate(None, _CAPITALS)),
    )


@F.pandas_udf(_COUNTS)
def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([counts_of(t) for t in texts], columns=list(COUNTS), dtype="int64")
    workers.give_back()


def counted(docs: DataFrame, name: str = "counts") -> DataFrame:
    """The rows with a struct of their counts. A null text has no word."""
    return docs.withColumn(name, _counts(F.col("text")))


def base_failed(counts: str = "counts") -> Column:
    c = F.col(counts)
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def measures(counts: str = "counts") -> dict[str, Column]:
    """Whole-number measures; higher means worse."""
    c = F.col(counts)

    def share(part: Column, whole: Column, scale: int) -> Column:
        return F.least(F.floor(part * scale / F.greatest(whole, F.lit(1))), F.lit(TOP)).cast("int")

    length = share(c["word_chars"], c["n_words"], 100)
    return {
        "symbols": share(c["n_symbols"], c["word_chars"], 1000),
        "duplicate_lines": share(c["n_dup_lines"], c["n_lines"], 1000),
        "repeated_words": share(c["n_repeat_words"], c["n_words"], 1000),
        "capitals": share(c["n_capitals"], c["word_chars"], 1000),
        "long_words": length,
        "short_words": F.lit(TOP).cast("int") - length,
    }


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, exact up to rounding, by the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, 1.0 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def choose_cutoff(
    bins: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, price: float = PRICE
) -> int | None:
    """Cutoff from which on a measure rejects, or None. Bins ascending, with their labelled counts."""
    all_good, all_bad = int(good.sum()), int(bad.sum())
    lost = np.cumsum(good[::-1])[::-1]
    caught = np.cumsum(bad[::-1])[::-1]
    # The tail shrinks as the cutoff grows, so the admissible cutoffs are the last bins.
    low, high = 0, len(bins)
    while low < high:
        middle = (low + high) // 2
        if binomial_at_most(int(lost[middle]), all_good, alpha) <= delta:
            high = middle
        else:
            low = middle + 1
    if low == len(bins) or not all_bad or not all_good:
        return None
    gain = caught[low:] / all_bad - price * lost[low:] / all_good
    best = int(np.argmax(gain))
    return int(bins[low + best]) if gain[best] > 0 else None


def cutoffs(
    rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE
) -> DataFrame:
    """(stratum, measure, cutoff) from counted rows (doc_id, lang, counts) and all labels (doc_id, quality).

    The holdout is every labelled document that passes the base rules. A doc_id with several labels
    counts once for each different one. Labels that are null, and a null doc_id, take no part.
    """
    known = labels.select("doc_id", "quality").filter("quality is not null").distinct()
    holdout = rows.filter(~base_failed()).join(known, "doc_id")
    columns = measures()
    long = holdout.select(
        F.col("lang").alias("stratum"),
        F.col("quality"),
        F.explode(F.create_map(*[x for n, c in columns.items() for x in (F.lit(n), c)])).alias("measure", "bin"),
    )
    histogram = stored(
        long.groupBy("stratum", "measure", "bin").agg(
            F.sum((F.col("quality") == 1).cast("bigint")).alias("good"),
            F.sum((F.col("quality") == 0).cast("bigint")).alias("bad"),
        )
    )
    tests = max(1, histogram.select("stratum").distinct().count()) * len(MEASURES)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        found = choose_cutoff(
            group["bin"].to_numpy(), group["good"].to_numpy(), group["bad"].to_numpy(),
            alpha / len(MEASURES), delta / tests, price,
        )
        first = group.iloc[0]
        return pd.DataFrame({"stratum": [first["stratum"]], "measure": [first["measure"]], "cutoff": [found]})

    # A group has one row per value of a measure: TOP + 1 rows at most.
    kind = dict(histogram.dtypes)["stratum"]
    return histogram.groupBy("stratum", "measure").applyInPandas(
        choose, f"stratum {kind}, measure string, cutoff double"
    )


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Counted rows with ``base_failed`` and ``kept``. A stratum without labels has no learned rule."""
    by_stratum = limits.filter("cutoff is not null").groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("limits")
    )
    joined = rows.join(by_stratum, rows["lang"].eqNullSafe(by_stratum["stratum"]), "left")
    over = F.lit(False)
    for name, column in measures().items():
        over = over | F.coalesce(column >= F.col("limits")[name], F.lit(False))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~over)
        .drop("stratum", "limits")
    )


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of the documents.

    A null or empty text has no word and fails the base rules. Repeated rows repeat. An empty table
    gives no row, empty labels give no learned rule.
    """
    rows = stored(counted(docs.select("doc_id", "lang", "text")).drop("text"))
    done = judged(rows, cutoffs(rows, labels))
    return done.select(
        "doc_id",
        *[F.col(f"counts.{n}").alias(n) for n in
          ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. The texts are stored once with their counts."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = stored(counted(docs.select(F.struct(*columns).alias("row"), "doc_id", "lang", "text")).drop("text"))
    limits = cutoffs(rows.select("doc_id", "lang", "counts"), labels)
    return judged(rows, limits).filter("kept").select("row.*")
