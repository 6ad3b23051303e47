"""Personal data and the terms that give it away.

Patterns find the base kinds. The values found are the protected entities of the corpus. How much a term
reveals an entity is measured from the whole corpus: with N documents, the information of entity c is
log(N / df(c)) and a term t next to it tells log(N * df(c, t) / (df(c) * df(t))) of that. A term that tells
the share ``GENERALISE`` or more is replaced by its class in every document that holds the entity, one
that tells ``REMOVE`` or more is taken out. Evidence counts once per distinct text and asks for ``SUPPORT``
different contexts, so that copies of one text prove nothing.

All work is DataFrame expressions. Places of matches come from the lengths of the matches and of the texts between
them, added up by a window over the rows of a document, so a text may hold any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billsift.llm.common import stored, text_or_empty

# Kinds in order and the patterns that define them.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# The same matches as the definitions give. Possessive repeats and the look at the character before keep
# the search linear: where a run of characters fails at its start, it fails at every later start too.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words on either side of a value that count as its context.
CONTEXT_WORDS = 5
SUPPORT = 2
GENERALISE = 0.85
REMOVE = 0.95
#: Letters or digits a term has at least.
TERM_CHARS = 3

_WORD = r"[\p{L}\p{N}]++"
_NOT_WORD = r"[^\p{L}\p{N}]++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit counts double, less nine above nine."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    parts = F.transform(figures, lambda d, n: F.when(n % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    count = F.length(digits)
    octets = F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(count.between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(count.between(9, 15))
    )


def _placed(rows: DataFrame, keys: list[str], values: str, gaps: str) -> DataFrame:
    """One row per match with its place and the text before it; ``values`` are the matches, ``gaps`` the texts around
    them. The last row of a text has no value."""
    zipped = rows.select(*keys, F.posexplode(F.arrays_zip(F.col(values).alias("value"), F.col(gaps).alias("gap")))
                         .alias("nth", "pair")).select(*keys, "nth", "pair.value", "pair.gap")
    order = Window.partitionBy(*keys).orderBy("nth")
    upto = F.sum(F.length("gap") + F.coalesce(F.length("value"), F.lit(0))).over(order)
    return (
        zipped.withColumn("end", upto.cast("bigint"))
        .withColumn("start", F.col("end") - F.length("value"))
    )


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))


def _holds(kind: str) -> Column:
    """A cheap necessary condition of a match."""
    if kind in ("email", "phone"):
        return F.contains("text", F.lit("@" if kind == "email" else "+"))
    return F.lit(True)


def findings(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, kind_no, start, end, value, before, after for every base span of the documents.

    ``before`` and ``after`` are the neighbouring words, nearest first, as far as the span's kind has none in between.
    A match that is not valid is ordinary text.
    """
    matched = texts.withColumns({
        k: F.when(_holds(k), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS
    }).filter(" or ".join(f"size({k}) > 0" for k in KINDS))
    split = [
        F.when(F.size(k) > 0, F.struct(
            F.lit(n).alias("kind_no"), F.col(k).alias("found"), F.split("text", PATTERNS[k], -1).alias("gaps")))
        for n, k in enumerate(KINDS)
    ]
    per_kind = matched.select("doc_id", "text_key", F.explode(F.array(*split)).alias("m")).filter("m is not null")
    rows = per_kind.select("doc_id", "text_key", "m.kind_no", "m.found", "m.gaps").dropDuplicates(
        ["doc_id", "text_key", "kind_no"]
    )
    keys = ["doc_id", "text_key", "kind_no"]
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    order = Window.partitionBy(*keys).orderBy("nth")
    earlier = F.sum(F.col("valid").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        _placed(rows, keys, "found", "gaps")
        .withColumn("valid", F.col("value").isNotNull() & F.coalesce(_valid(kind, F.col("value")), F.lit(False)))
        .withColumn("taken", F.max("valid").over(Window.partitionBy(*keys)))
        .filter("taken")
        .withColumn("stretch", F.coalesce(earlier, F.lit(0)))
    )
    # A stretch is the text up to a valid span or to the end.
    piece = F.when(F.col("valid") | F.col("value").isNull(), F.col("gap")).otherwise(F.concat("gap", "value"))
    stretches = placed.groupBy(*keys, "stretch").agg(
        F.array_sort(F.collect_list(F.struct("nth", piece.alias("piece")))).alias("pieces"),
        F.max(F.when(F.col("valid"), F.struct("start", "end", "value"))).alias("span"),
    ).select(*keys, "stretch", "span", _words(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("near"))
    onward = Window.partitionBy(*keys).orderBy("stretch")
    return (
        stretches.withColumn("after", F.lead(F.slice("near", 1, CONTEXT_WORDS)).over(onward))
        .filter("span is not null")
        .select(
            *keys, "span.start", "span.end", "span.value",
            F.slice(F.reverse("near"), 1, CONTEXT_WORDS).alias("before"), "after",
        )
    )


def _entity() -> Column:
    return F.concat(
        F.col("kind_no").cast("string"), F.lit(":"),
        F.when(F.col("kind_no") == 0, F.lower("value")).when(F.col("kind_no") == 1, F.col("value"))
        .otherwise(_digits(F.col("value"))),
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NOT_WORD, -1), lambda w: F.length(w) >= TERM_CHARS)


def revealing(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, told): terms next to an entity that tell ``GENERALISE`` of it or more."""
    near = F.concat("before", "after")
    contexts = found.select("text_key", _entity().alias("entity"), F.array_distinct(near).alias("near"))
    per_entity = contexts.groupBy("entity").agg(F.count_distinct("text_key").alias("entity_docs"))
    pairs = (
        contexts.withColumn("context", F.xxhash64("near"))
        .select("entity", "text_key", "context", F.explode("near").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count_distinct("text_key").alias("both"), F.count_distinct("context").alias("contexts"))
        .filter(F.col("contexts") >= SUPPORT)
    )
    candidates = stored(pairs.join(per_entity, "entity"))
    # Documents, entities and terms are all counted by distinct texts.
    per_term = (
        texts.dropDuplicates(["text_key"]).select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    )
    total = texts.select("text_key").distinct().count()
    told = F.log(F.lit(float(total)) * F.col("both") / (F.col("entity_docs") * F.greatest("term_docs", "both"))) / F.log(
        F.lit(float(total)) / F.col("entity_docs")
    )
    return (
        candidates.filter(F.col("entity_docs") < total)
        .join(per_term, "term")
        .select("entity", "term", told.alias("told"))
        .filter(F.col("told") >= GENERALISE)
    )


def term_spans(texts: DataFrame, found: DataFrame, reveal: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end, value, told: places of revealing terms in documents with their entity."""
    wanted = (
        found.select("doc_id", "text_key", _entity().alias("entity")).distinct()
        .join(reveal, "entity").groupBy("doc_id", "text_key", "term").agg(F.max("told").alias("told"))
    )
    wanted = stored(wanted)
    keys = wanted.select(F.col("doc_id").alias("held_doc"), F.col("text_key").alias("held_key")).distinct()
    held = texts.join(
        keys, (F.col("text_key") == F.col("held_key")) & F.col("doc_id").eqNullSafe(F.col("held_doc")), "left_semi"
    ).dropDuplicates(["doc_id", "text_key"])
    cut = held.select(
        "doc_id", "text_key",
        F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("found"),
        F.split("text", _WORD, -1).alias("gaps"),
    )
    words = _placed(cut, ["doc_id", "text_key"], "found", "gaps").select(
        "doc_id", "text_key", "start", "end", "value", F.lower("value").alias("term")
    )
    renamed = wanted.select(
        F.col("doc_id").alias("held_doc"), F.col("text_key").alias("held_key"), F.col("term").alias("held_term"), "told"
    )
    hits = words.join(
        renamed,
        (F.col("text_key") == F.col("held_key")) & F.col("doc_id").eqNullSafe(F.col("held_doc"))
        & (F.col("term") == F.col("held_term")),
    ).select("doc_id", "text_key", "start", "end", "value", "told")
    # What a base span covers already is not a term span.
    both = hits.withColumn("kind_no", F.lit(len(KINDS))).unionByName(
        found.select("doc_id", "text_key", "start", "end", "value", F.lit(None).cast("double").alias("told"), "kind_no")
    )
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "kind_no", "end")
    is_base = F.col("kind_no") < len(KINDS)
    before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (
        both.withColumn("covered_to", before).withColumn("next_from", onward)
        .filter(~is_base)
        .filter("(covered_to is null or covered_to <= start) and (next_from is null or next_from >= end)")
        .select("doc_id", "text_key", "start", "end", "value", "told", "kind_no")
    )


def all_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): spans have doc_id, text_key, kind_no, start, end, value, told (null for base kinds)."""
    texts = _documents(docs)
    found = stored(findings(texts))
    terms = term_spans(texts, found, revealing(texts, found))
    base = found.select("doc_id", "text_key", "start", "end", "value", F.lit(None).cast("double").alias("told"), "kind_no")
    return texts, base.unionByName(terms)


def reported(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans for every row.

    A null or empty text has no span. Rows with equal doc_id and text get equal results; a null doc_id is a
    document of its own. Other columns are not looked at; an empty table gives no row.
    """
    texts, spans = all_spans(docs)
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    written = F.concat_ws(":", F.element_at(names, F.col("kind_no") + 1), F.col("start").cast("string"), F.col("end").cast("string"))
    per_doc = spans.groupBy("doc_id", "text_key").agg(
        *[F.sum((F.col("kind_no") == n).cast("bigint")).alias(f"n_{k}") for n, k in enumerate((*KINDS, TERM))],
        F.array_sort(F.collect_list(F.struct("start", "kind_no", written.alias("written")))).alias("all"),
    )
    listed = per_doc.select(
        F.col("doc_id").alias("held_doc"), F.col("text_key").alias("held_key"), *[f"n_{k}" for k in (*KINDS, TERM)],
        F.array_join(F.transform(F.filter("all", lambda s: s["kind_no"] < len(KINDS)), lambda s: s["written"]), ",")
        .alias("base"),
        F.array_join(F.transform("all", lambda s: s["written"]), ",").alias("spans"),
    )
    rows = texts.select("doc_id", "text_key")
    return rows.join(
        listed, (F.col("text_key") == F.col("held_key")) & F.col("doc_id").eqNullSafe(F.col("held_doc")), "left"
    ).select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in (*KINDS, TERM)],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced: base kinds and generalised terms by their class in brackets,
    removed terms by nothing. Of spans that overlap, the stretch they cover is replaced by the first one's class."""
    texts, spans = all_spans(docs)
    sign = (
        F.when(F.col("told") >= REMOVE, F.lit(""))
        .when(F.col("kind_no") < len(KINDS), F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1), F.lit("]")))
        .when(F.regexp_like("value", F.lit(r"^\p{N}+$")), F.lit("[number]"))
        .when(F.regexp_like("value", F.lit(r"^\p{Lu}")), F.lit("[name]"))
        .otherwise(F.lit("[word]"))
    )
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "kind_no", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("sign", sign).withColumn("reached", reached).withColumn(
        "stretch", F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(order)
    )
    merged = fresh.groupBy("doc_id", "text_key", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("sign", F.struct("start", "kind_no", "end")).alias("sign")
    ).groupBy(F.col("doc_id").alias("held_doc"), F.col("text_key").alias("held_key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "sign"))).alias("cuts")
    )
    text, cuts = F.col("text"), F.col("cuts")
    parts = F.transform(
        cuts,
        lambda c, n: F.concat(
            F.substring(text, F.coalesce(F.get(cuts, n - 1)["end"], F.lit(0)).cast("int") + 1,
                        (c["start"] - F.coalesce(F.get(cuts, n - 1)["end"], F.lit(0))).cast("int")),
            c["sign"],
        ),
    )
    rest = F.substring(text, F.element_at(cuts, -1)["end"].cast("int") + 1, F.length(text))
    return texts.join(
        merged, (F.col("text_key") == F.col("held_key")) & F.col("doc_id").eqNullSafe(F.col("held_doc")), "left"
    ).select("doc_id", F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest)).alias("text"))
