"""SQL counterparts of the corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from billsift.llm import mixing, quality

_GAP = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def source_mix() -> str:
    """Targets by the highest level; words taken by cutting the repeated stream at the quota."""
    weight = " ".join(f"WHEN no % {len(mixing.WEIGHTS)} = {n} THEN {float(w)}" for n, w in enumerate(mixing.WEIGHTS))
    epochs = " + ".join(
        f"greatest(0, least(head + size + {e} * source_size, quota) - (head + {e} * source_size))"
        for e in range(mixing.MOST_EPOCHS)
    )
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS place
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
    FROM d GROUP BY source),
w AS (SELECT *, CASE {weight} END::DOUBLE AS weight, source_size * {float(mixing.MOST_EPOCHS)}::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota,
    sum(size) OVER (PARTITION BY t.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size AS head
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST({epochs} AS BIGINT) AS taken FROM p"""


def quality_rules() -> str:
    """Counts by lists and windows; cutoffs by summing the binomial terms."""
    alpha = quality.ALPHA / len(quality.MEASURES)
    top = quality.TOP

    def share(part: str, whole: str, scale: int) -> str:
        return f"CAST(least(floor({part} * {scale} / greatest({whole}, 1)), {top}) AS INTEGER)"

    values = {
        "symbols": share("n_symbols", "word_chars", 1000),
        "duplicate_lines": share("n_dup_lines", "n_lines", 1000),
        "repeated_words": share("n_repeat_words", "n_words", 1000),
        "capitals": share("n_capitals", "word_chars", 1000),
        "long_words": share("word_chars", "n_words", 100),
        "short_words": f"{top} - " + share("word_chars", "n_words", 100),
    }
    long = " UNION ALL ".join(f"SELECT row_no, doc_id, lang, '{n}' AS measure, {v} AS bin FROM b" for n, v in values.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d),
per_line AS (SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
places AS (SELECT row_no, words, unnest(range(1, len(words) + 1)) AS i FROM d),
grams AS (SELECT row_no, i, CASE WHEN i + 7 <= len(words) THEN array_to_string(words[i:i + 7], ' ') END AS gram FROM places),
marked AS (SELECT row_no, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY row_no, gram) > 1 AS again FROM grams),
covered AS (SELECT row_no, bool_or(again) OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
    FROM marked),
per_word AS (SELECT row_no, count(*) FILTER (WHERE hit) AS n_repeat_words FROM covered GROUP BY row_no),
b0 AS (SELECT d.row_no, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{_GAP}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN per_line USING (row_no) LEFT JOIN per_word USING (row_no)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b0),
m AS ({long}),
known AS (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL),
h AS (SELECT lang, measure, bin, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad
    FROM m JOIN known USING (doc_id) WHERE row_no IN (SELECT row_no FROM b WHERE NOT base_failed) GROUP BY ALL),
c AS (SELECT lang, measure, bin, sum(good) OVER up AS lost, sum(bad) OVER up AS caught,
    sum(good) OVER whole AS all_good, sum(bad) OVER whole AS all_bad
    FROM h WINDOW up AS (PARTITION BY lang, measure ORDER BY bin DESC ROWS UNBOUNDED PRECEDING),
        whole AS (PARTITION BY lang, measure)),
tail AS (SELECT *, lost >= all_good OR lost > all_good * {alpha} OR list_sum(list_transform(range(0, CAST(lost AS BIGINT) + 1),
        lambda k: exp(lgamma(all_good + 1) - (CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) - lgamma(all_good - k + 1)
            + k * ln({alpha}) + (all_good - k) * ln(1 - {alpha}))))
        > {quality.DELTA} / ({len(quality.MEASURES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM h))) AS fails
    FROM c WHERE all_good > 0 AND all_bad > 0),
gain AS (SELECT *, caught / all_bad - {quality.PRICE} * lost / all_good AS gain FROM tail t WHERE NOT fails),
best AS (SELECT lang, measure, arg_max(bin, (gain, -bin)) AS cutoff FROM gain GROUP BY ALL HAVING max(gain) > 0),
over AS (SELECT DISTINCT row_no FROM m JOIN best ON m.lang IS NOT DISTINCT FROM best.lang AND m.measure = best.measure
    WHERE m.bin >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND row_no NOT IN (SELECT row_no FROM over) AS kept FROM b"""


def shingle_join(width: int = 4, percent: int = 85) -> str:
    """Common shingles by a join on them; components by walking the links."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < {width} THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + {width - 1}], ' ') END AS gram
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_sides AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY ALL),
links AS (SELECT a, b FROM both_sides JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.seen = edges.a),
root AS (SELECT doc_id, min(seen) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)"""


def turn_repair() -> str:
    """Cheapest repairs from the last row of a conversation to its first, with their letters and lines."""

    def edit(after: str, letter: str, cost: str, line: str, allowed: str) -> str:
        return (f"{{'c': {after}.c + {cost} + CASE WHEN {allowed} THEN 0 ELSE 1000000000 END, "
                f"'a': '{letter}' || {after}.a, 't': {line} || {after}.t}}")  # fmt: skip

    def line(role: str, text: str) -> str:
        return f"chr(10) || {role} || ':' || {text}"

    def options(state: int) -> str:
        following, who = ("s3", "assistant") if state == 2 else ("s2", "user")
        found = [edit(f"s{state}", "D", "2", "''", "true")]
        for letter in {0: "su", 1: "u", 2: "a", 3: "u"}[state]:
            after = "s1" if letter == "s" else following
            found.append(edit(after, "K", "more", line("role", "text"), f"open AND role[1] = '{letter}'"))
        found.append(edit(following, "R", "1 + more", line(f"'{who}'", "text"), "open"))
        return f"list_sort([{', '.join(found)}])[1] AS b{state}"

    def inserted(state: int) -> str:
        following, who = ("b3", "assistant") if state == 2 else ("b2", "user")
        return f"list_sort([b{state}, {edit(following, 'I', '5', line(repr(who), repr('')), 'true')}])[1] AS s{state}"

    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split({key}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda acc, b:
        list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, b)), 4294967295), 4294967295) % 20 AS fate
    FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM hurt),
marked AS (SELECT conv_id, turn, role, text, n, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM placed),
told AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS open, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM marked),
walk AS (SELECT conv_id, max(n) AS n, {{'c': 0, 'a': '', 't': ''}} AS s0,
    {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1,
    {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}} AS s2, {{'c': 0, 'a': '', 't': ''}} AS s3 FROM told GROUP BY conv_id
    UNION ALL
    SELECT conv_id, n - 1, {', '.join(inserted(s) for s in range(4))} FROM (
        SELECT w.conv_id, w.n, {', '.join(options(s) for s in range(4))}
        FROM walk w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.n = t.n)),
best AS (SELECT conv_id, s0 FROM walk WHERE n = 0),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost,
    coalesce(s0.a, '') AS audit, sha256(substr(coalesce(s0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts f ON i.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id"""


def ranked_search(top: int = 50) -> str:
    """Scores by joining the items' terms with the documents' counts."""
    terms = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")  # fmt: skip
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS words FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT DISTINCT i, item_id, unnest({terms}) AS term FROM i),
tf AS (SELECT r, doc_id, len(words) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
p AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))
        AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {top}"""
