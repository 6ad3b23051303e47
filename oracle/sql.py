"""One SQL statement per registered query, over the same tables.

Every statement is the shared list of table expressions plus a final select. The
expressions are written from the operator definitions, not from the Spark plans:
duplicates, for example, are found by comparing candidate pairs with one CASE.
"""

from __future__ import annotations

NUDGE = "CAST(0.000000001 AS DECIMAL(10,9))"
CENT = "CAST(0.01 AS DECIMAL(3,2))"


def r2(x: str) -> str:
    return f"CAST(round({x} + {NUDGE}, 2) AS DECIMAL(18,2))"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def float_text(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0')"
    )


def mean2(total: str, n: str) -> str:
    """Mean of a sum of cents-valued decimals: six decimals, then two, halves up."""
    cents = f"CAST(({total}) * 100 AS HUGEINT)"
    six = f"(({cents} * 20000 + {n}) // (2 * {n}))"
    return f"CAST(({six} + 5000) // 10000 AS DOUBLE) / 100"


def half_up(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST((2 * {part} + {whole}) // (2 * {whole}) AS BIGINT) ELSE 0 END"


def clean(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def lcs(a: str, b: str) -> str:
    """Row-by-row longest common subsequence."""
    best = (
        f"greatest(done[len(done)], line[i[1] + 1], "
        f"line[i[1]] + CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN 1 ELSE 0 END)"
    )
    inner = (
        f"list_reduce(list_transform(range(1, length({a}) + 1), lambda p: [CAST(p AS BIGINT)]), "
        f"lambda done, i: list_append(done, {best}), [CAST(0 AS BIGINT)])"
    )
    outer = (
        f"list_reduce(list_transform(range(1, length({b}) + 1), lambda p: [CAST(p AS BIGINT)]), "
        f"lambda line, j: {inner}, "
        f"list_transform(range(0, length({a}) + 1), lambda z: CAST(0 AS BIGINT)))"
    )
    return f"({outer})[length({a}) + 1]"


def similarity(a: str, b: str) -> str:
    return f"round(200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})), 2)"


def _items(name: str, faulted: bool) -> str:
    quantity, price, percent, product = "quantity", "unit_price", "tax_percent", "product_name"
    if faulted:
        quantity = "CASE WHEN invoice_id % 59 = 0 THEN CAST(0 AS DECIMAL(12,3)) ELSE quantity END"
        price = "CASE WHEN invoice_id % 61 = 0 THEN -unit_price ELSE unit_price END"
        percent = "CASE WHEN invoice_id % 67 = 0 THEN CAST(tax_percent + 118 AS DECIMAL(5,2)) ELSE tax_percent END"
        product = "CASE WHEN invoice_id % 71 = 0 THEN '  ' ELSE product_name END"
    return f"""
{name}_0 AS (SELECT invoice_id, {product} AS product_name, {quantity} AS quantity, {price} AS unit_price,
  {percent} AS tax_percent FROM base_items),
{name}_1 AS (SELECT *, CAST({r2('quantity * unit_price')} AS DECIMAL(14,2)) AS line_subtotal FROM {name}_0),
{name}_2 AS (SELECT *, CAST({r2(f'line_subtotal * tax_percent * {CENT}')} AS DECIMAL(14,2)) AS line_tax FROM {name}_1),
{name} AS (SELECT *, CAST(line_subtotal + line_tax AS DECIMAL(14,2)) AS line_total FROM {name}_2)"""


def _heads(name: str, items: str, faulted: bool) -> str:
    number = "'PO-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"
    vendor, date = "o_custkey", "CAST(o_orderdate AS DATE)"
    total = "coalesce(s.total_amount, 0)"
    if faulted:
        number = f"CASE WHEN o_orderkey % 73 <> 0 THEN {number} END"
        vendor = "CASE WHEN o_orderkey % 79 <> 0 THEN o_custkey END"
        date = f"CASE WHEN o_orderkey % 83 <> 0 THEN {date} END"
        total = f"{total} + CASE WHEN o_orderkey % 53 = 0 THEN 10 ELSE 0 END"
    return f"""
{name} AS (SELECT o_orderkey AS invoice_id, CAST(c_nationkey AS BIGINT) AS company_id, {vendor} AS vendor_id,
  {number} AS invoice_number, o_orderkey % 10 AS batch_id, {date} AS invoice_date,
  CAST(coalesce(s.subtotal, 0) AS DECIMAL(14,2)) AS subtotal,
  CAST(coalesce(s.tax_amount, 0) AS DECIMAL(14,2)) AS tax_amount,
  CAST({total} AS DECIMAL(14,2)) AS total_amount,
  'Pending' AS status, CAST(0 AS DECIMAL(5,2)) AS risk_score, o_orderstatus AS order_status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT invoice_id, sum(line_subtotal) AS subtotal, sum(line_tax) AS tax_amount,
    sum(line_total) AS total_amount FROM {items} GROUP BY invoice_id) s ON s.invoice_id = o_orderkey)"""


_BLANK = "({0} IS NULL OR " + clean("{0}") + " = '')"


def blank(x: str) -> str:
    return _BLANK.replace("{0}", x)


LABEL = f"CASE WHEN {clean('product_name')} = '' THEN 'General' ELSE {clean('product_name')} END"

HEADER_RULES = [
    (1, "MISSING_FIELD", "CRITICAL", blank("invoice_number"), "'Missing required field: invoice_number.'"),
    (2, "MISSING_FIELD", "CRITICAL", blank("vendor_name"), "'Missing required field: vendor_name.'"),
    (3, "INVALID_DATE", "ERROR", "invoice_date IS NULL", "'Invoice date is empty or in an invalid format.'"),
    (4, "FUTURE_DATE", "WARNING", "invoice_date > DATE '2001-01-01'",
     "'Invoice dated in the future: ' || CAST(invoice_date AS VARCHAR) || '.'"),
    *[
        (5, "NEGATIVE_AMOUNT", "CRITICAL", f"{c} < 0",
         f"'Negative amount detected: {c}=' || {float_text(c)} || '.'")
        for c in ("subtotal", "tax_amount", "total_amount")
    ],
    (9, "TOTAL_MISMATCH", "CRITICAL", "abs(subtotal + tax_amount - total_amount) > 0.01",
     f"'Total mismatch: expected ' || {float_text('subtotal + tax_amount')} || ', got ' || "
     f"{float_text('total_amount')} || ' (tolerance 0.01).'"),
]
ITEM_RULES = [
    (6, "QUANTITY_INVALID", "ERROR", "quantity IS NULL OR quantity <= 0",
     f"'Line-item quantity must be greater than zero: ''' || {LABEL} || ''' (quantity=' || "
     f"{float_text('quantity')} || ').'"),
    (7, "UNIT_PRICE_INVALID", "ERROR", "unit_price IS NULL OR unit_price <= 0",
     f"'Line-item unit price must be greater than zero: ''' || {LABEL} || ''' (unit_price=' || "
     f"{float_text('unit_price')} || ').'"),
    (8, "GST_OUT_OF_RANGE", "ERROR", "tax_percent IS NULL OR tax_percent < 0 OR tax_percent > 100",
     f"'GST rate out of allowed range 0-100: ''' || {LABEL} || ''' (gst_percent=' || "
     f"{float_text('tax_percent')} || ').'"),
    (10, "EMPTY_PRODUCT_NAME", "WARNING", blank("product_name"),
     "'Line item has an empty product name; supplier data is incomplete for reporting.'"),
]


def _rule_selects() -> str:
    out = []
    for rules, source in ((HEADER_RULES, "named_faulted"), (ITEM_RULES, "fitems")):
        for number, code, severity, condition, message in rules:
            out.append(
                f"SELECT invoice_id, {number} AS rule_no, '{code}' AS validation_type, "
                f"'{severity}' AS severity, {message} AS message FROM {source} WHERE {condition}"
            )
    return " UNION ALL ".join(out)


def status_of(score: str) -> str:
    return (
        f"CASE WHEN {score} <= 0 THEN 'Valid' WHEN {score} <= 29 THEN 'Needs Review' "
        f"WHEN {score} <= 59 THEN 'High Risk' ELSE 'Critical' END"
    )


def _assessed(name: str, heads: str, findings: str) -> str:
    points = "CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'ERROR' THEN 20 WHEN 'WARNING' THEN 10 ELSE 2 END"
    return f"""
{name}_0 AS (SELECT invoice_id, count(*) AS n, sum({points}) AS p,
  bool_or(severity = 'CRITICAL' AND rule_no IN (1, 2, 5, 9)) AS crit FROM {findings} GROUP BY invoice_id),
{name} AS (SELECT h.*, coalesce(n, 0) AS issue_count, coalesce(crit, false) AS has_critical,
  CAST(least(coalesce(p, 0), 100) AS DECIMAL(5,2)) AS assessed_score,
  {status_of('least(coalesce(p, 0), 100)')} AS assessed_status
  FROM {heads} h LEFT JOIN {name}_0 f ON f.invoice_id = h.invoice_id)"""


_R = "invoice_id % 97"
_FOREIGN = "'ZX' || substr(md5(CAST(invoice_id + 10000000 AS VARCHAR)), 1, 14)"
_COPIES = f"""
copies AS (
  SELECT invoice_id, company_id, vendor_id, invoice_number, batch_id, invoice_date, subtotal, tax_amount,
    total_amount, status, risk_score FROM invoices
  UNION ALL
  SELECT invoice_id + 10000000, company_id,
    CASE WHEN {_R} = 5 THEN vendor_id + 1000000 ELSE vendor_id END,
    CASE {_R} WHEN 1 THEN invoice_number WHEN 3 THEN invoice_number || 'A' ELSE {_FOREIGN} END,
    (invoice_id // 97) % 10,
    invoice_date + CAST(CASE {_R} WHEN 1 THEN 30 WHEN 3 THEN 20 WHEN 4 THEN 2 ELSE 0 END AS INTEGER),
    subtotal, tax_amount,
    CAST(total_amount + CASE {_R} WHEN 1 THEN 500 WHEN 3 THEN 0.75 WHEN 5 THEN 500 ELSE 0 END AS DECIMAL(14,2)),
    status, risk_score
  FROM invoices WHERE {_R} BETWEEN 1 AND 5
  UNION ALL
  SELECT invoice_id + 20000000, 3, vendor_id, 'BULK-RESUBMISSION', invoice_id % 10, invoice_date, subtotal, tax_amount,
    total_amount, status, risk_score FROM invoices WHERE invoice_id BETWEEN 0 AND 100
  UNION ALL
  SELECT invoice_id + 30000000, 3, 1, 'ZX' || substr(md5(CAST(invoice_id + 30000000 AS VARCHAR)), 1, 14), invoice_id % 10,
    DATE '1998-01-05' + CAST(CASE WHEN invoice_id > 201 THEN 2 ELSE 0 END AS INTEGER), subtotal, tax_amount,
    CAST(CASE WHEN invoice_id > 160 THEN 777.78 ELSE 777.77 END AS DECIMAL(14,2)), status, risk_score
  FROM invoices WHERE invoice_id BETWEEN 101 AND 231),
copy_items AS (
  SELECT * FROM items UNION ALL
  SELECT invoice_id + 10000000, product_name, quantity, unit_price, tax_percent, line_subtotal, line_tax, line_total
  FROM items WHERE {_R} = 5),
signatures AS (
  SELECT invoice_id, string_agg(k, '|' ORDER BY k) AS sig FROM (
    SELECT invoice_id, lower(upper({LABEL})) || '~' || CAST(quantity AS VARCHAR) || '~' || CAST(unit_price AS VARCHAR)
      AS k FROM copy_items) GROUP BY invoice_id),
profiles AS (SELECT c.*, sig, lower({clean('invoice_number')}) AS nkey FROM copies c
  LEFT JOIN signatures s ON s.invoice_id = c.invoice_id),
candidates AS (
  SELECT a.invoice_id AS a_id, b.invoice_id AS b_id FROM profiles a JOIN profiles b
    ON a.nkey = b.nkey AND a.nkey <> '' AND a.company_id = b.company_id AND a.invoice_id < b.invoice_id
  UNION
  SELECT a.invoice_id, b.invoice_id FROM profiles a JOIN profiles b
    ON a.vendor_id = b.vendor_id AND a.company_id = b.company_id AND a.invoice_id < b.invoice_id
    AND abs(a.total_amount - b.total_amount) <= 1.00
  UNION
  SELECT a.invoice_id, b.invoice_id FROM profiles a JOIN profiles b
    ON a.sig = b.sig AND a.company_id = b.company_id AND a.invoice_id < b.invoice_id),
compared AS (
  SELECT a_id, b_id, a.batch_id AS a_batch, b.batch_id AS b_batch, a.nkey = b.nkey AND a.nkey <> '' AS same_number,
    a.vendor_id = b.vendor_id AS same_vendor, abs(a.total_amount - b.total_amount) AS gap,
    abs(a.invoice_date - b.invoice_date) AS days, coalesce(a.sig = b.sig, false) AS same_items,
    {similarity('a.invoice_number', 'b.invoice_number')} AS sim
  FROM candidates JOIN profiles a ON a.invoice_id = a_id JOIN profiles b ON b.invoice_id = b_id),
leveled AS (
  SELECT *, CASE WHEN same_number THEN 1
    WHEN same_vendor AND gap <= 0.01 AND days = 0 THEN 2
    WHEN same_vendor AND gap <= 1.00 AND sim >= 90 THEN 3
    WHEN same_vendor AND gap <= 0.01 AND days <= 3 THEN 4
    WHEN same_items THEN 5 END AS level FROM compared),
pairs AS (
  SELECT a_id, b_id, a_batch, b_batch, l.level, validation_type, severity, confidence, penalty,
    CASE WHEN l.level = 3 THEN sim END AS similarity
  FROM leveled l JOIN (VALUES
    (1, 'DUPLICATE_EXACT', 'CRITICAL', 100, 50), (2, 'DUPLICATE_VENDOR', 'CRITICAL', 98, 40),
    (3, 'DUPLICATE_NEAR', 'ERROR', 95, 30), (4, 'DUPLICATE_DATE', 'WARNING', 85, 15),
    (5, 'DUPLICATE_ITEM', 'ERROR', 92, 25)) v(level, validation_type, severity, confidence, penalty)
    ON v.level = l.level),
sides AS (
  SELECT a_id AS invoice_id, b_id AS match_id, * EXCLUDE (a_id, b_id) FROM pairs UNION ALL
  SELECT b_id, a_id, * EXCLUDE (a_id, b_id) FROM pairs),
prior AS (
  SELECT DISTINCT CASE WHEN a_id % 97 = 3 THEN 'DUPLICATE_DATE' ELSE validation_type END AS validation_type, a_id, b_id
  FROM pairs WHERE a_id % 97 IN (1, 3)),
charges AS (
  SELECT validation_type, a_id, b_id, bool_or(now) AS now FROM (
    SELECT validation_type, a_id, b_id, true AS now FROM pairs UNION ALL
    SELECT validation_type, a_id, b_id, false FROM prior) GROUP BY ALL),
charged AS (
  SELECT invoice_id, sum(penalty) AS penalty FROM (
    SELECT a_id AS invoice_id, * FROM charges UNION ALL SELECT b_id, * FROM charges) c
  JOIN (VALUES ('DUPLICATE_EXACT', 50), ('DUPLICATE_VENDOR', 40), ('DUPLICATE_NEAR', 30),
    ('DUPLICATE_DATE', 15), ('DUPLICATE_ITEM', 25)) v(validation_type, penalty) USING (validation_type)
  GROUP BY invoice_id HAVING bool_or(now)),
copy_scores AS (
  SELECT c.invoice_id, CASE WHEN vendor_id NOT IN (SELECT c_custkey FROM customer) THEN 40 ELSE 0 END
    + CASE WHEN invoice_date > DATE '2001-01-01' THEN 10 ELSE 0 END
    + CASE WHEN abs(subtotal + tax_amount - total_amount) > 0.01 THEN 40 ELSE 0 END AS rule_points FROM copies c),
rescored AS (
  SELECT invoice_id, CAST(least(rule_points, 100) AS DOUBLE) AS rule_score,
    CAST(least(least(rule_points, 100) + penalty, 100) AS DOUBLE) AS risk_score,
    {status_of('least(least(rule_points, 100) + penalty, 100)')} AS status
  FROM charged JOIN copy_scores USING (invoice_id)),
listing AS (
  SELECT p.a_id AS invoice_a_id, a.invoice_number AS invoice_a_number, p.b_id AS invoice_b_id,
    b.invoice_number AS invoice_b_number, coalesce(va.c_name, vb.c_name) AS vendor_name,
    a.total_amount AS amount_a, b.total_amount AS amount_b, a.invoice_date AS invoice_date_a,
    b.invoice_date AS invoice_date_b, validation_type, severity, confidence AS confidence_score, similarity
  FROM pairs p JOIN copies a ON a.invoice_id = a_id JOIN copies b ON b.invoice_id = b_id
  LEFT JOIN customer va ON va.c_custkey = a.vendor_id LEFT JOIN customer vb ON vb.c_custkey = b.vendor_id)"""

_NUMBER = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"


def number(x: str) -> str:
    raw = f"regexp_replace({clean(x)}, '[,%]', '', 'g')"
    return f"CASE WHEN regexp_matches({raw}, '{_NUMBER}') THEN TRY_CAST({raw} AS DECIMAL(18,6)) END"


def date_text(x: str) -> str:
    raw = clean(x)
    return (
        f"coalesce(CAST(try_strptime({raw}, '%Y-%m-%d') AS DATE), "
        f"CAST(try_strptime({raw}, '%d/%m/%Y') AS DATE), CAST(try_strptime({raw}, '%m/%d/%Y') AS DATE))"
    )


_LINES = f"""
priced AS (
  SELECT l_orderkey AS k, l_linenumber, l_partkey, CAST(round(l_quantity * 1000) AS BIGINT) AS m,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS a, l_tax FROM lineitem),
texts AS (
  SELECT p.*, o_orderdate, c_name, p_name,
    CAST(((2 * a * 1000 + m) // (2 * m)) // 100 AS VARCHAR) || '.' ||
      lpad(CAST(((2 * a * 1000 + m) // (2 * m)) % 100 AS VARCHAR), 2, '0') AS price_text
  FROM priced p JOIN orders ON o_orderkey = k LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN part ON p_partkey = l_partkey),
lines AS (
  SELECT k, k % 10 AS batch_id, l_linenumber, l_partkey, m, a,
    CASE WHEN k % 73 = 0 THEN '  ' ELSE ' PO-' || lpad(CAST(k AS VARCHAR), 8, '0') || chr(9) END AS invoice_number,
    CASE WHEN k % 79 = 0 OR (k % 11 = 0 AND l_linenumber % 2 = 0) THEN '' ELSE c_name END AS vendor_name,
    CASE WHEN k % 83 = 0 THEN '2024-02-30' WHEN k % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN k % 3 = 2 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
    CASE WHEN k % 71 = 0 THEN '  ' ELSE p_name END AS product_name,
    CASE WHEN k % 59 = 0 THEN 'abc' ELSE CAST(m // 1000 AS VARCHAR) END AS quantity,
    CASE WHEN k % 7 = 0 THEN substr(price_text, 1, 1) || ',' || substr(price_text, 2)
      WHEN k % 61 = 0 THEN '1_000' ELSE price_text END AS unit_price,
    CASE WHEN k % 67 = 0 THEN '' ELSE CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) || '%' END AS gst_percent
  FROM texts),
grouped AS (SELECT * EXCLUDE (invoice_number), {clean('invoice_number')} AS invoice_number FROM lines
  WHERE {clean('invoice_number')} <> ''),
heads AS (
  SELECT batch_id, invoice_number, {date_text('invoice_date')} AS invoice_date, {clean('vendor_name')} AS vendor_name
  FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, invoice_number
    ORDER BY l_linenumber, l_partkey, m, a) AS rn FROM grouped) WHERE rn = 1),
accepted AS (SELECT * FROM heads WHERE vendor_name <> '' AND invoice_date IS NOT NULL),
cells AS (
  SELECT batch_id, invoice_number, {LABEL} AS product_name, {number('quantity')} AS q, {number('unit_price')} AS p,
    CASE WHEN {clean('gst_percent')} = '' THEN CAST(0 AS DECIMAL(18,6)) ELSE {number('gst_percent')} END AS g
  FROM grouped),
line_items AS (
  SELECT *, CAST(round(line_subtotal * CAST(g AS DECIMAL(9,2)) * {CENT} + {NUDGE}, 2) AS DECIMAL(18,2)) AS line_tax FROM (
    SELECT *, CAST(round(CAST(q AS DECIMAL(14,3)) * CAST(p AS DECIMAL(14,2)) + {NUDGE}, 2) AS DECIMAL(18,2))
      AS line_subtotal FROM cells WHERE q IS NOT NULL AND p IS NOT NULL AND g IS NOT NULL)),
loaded AS (
  SELECT h.batch_id, h.invoice_number, vendor_name, invoice_date, coalesce(s.subtotal, 0) AS subtotal,
    coalesce(s.tax_amount, 0) AS tax_amount, coalesce(s.total_amount, 0) AS total_amount
  FROM accepted h LEFT JOIN (SELECT batch_id, invoice_number, sum(line_subtotal) AS subtotal,
    sum(line_tax) AS tax_amount, sum(line_subtotal + line_tax) AS total_amount FROM line_items GROUP BY ALL) s
  ON s.batch_id = h.batch_id AND s.invoice_number = h.invoice_number),
line_counts AS (
  SELECT batch_id, coalesce(groups, 0) AS groups, coalesce(ungrouped, 0) AS ungrouped, coalesce(processed, 0) AS processed
  FROM (SELECT batch_id, count(*) AS groups,
      count(*) FILTER (WHERE vendor_name <> '' AND invoice_date IS NOT NULL) AS processed FROM heads GROUP BY batch_id) h
  FULL OUTER JOIN (SELECT batch_id, count(*) AS ungrouped FROM lines
      WHERE {clean('invoice_number')} = '' GROUP BY batch_id) u USING (batch_id)),
vendor_ids AS (
  SELECT vendor_id, company_id, vendor_name FROM vendors UNION ALL
  SELECT (SELECT max(vendor_id) FROM vendors) + row_number() OVER (ORDER BY vendor_name), 1, vendor_name
  FROM (SELECT DISTINCT vendor_name FROM accepted) n
  WHERE vendor_name NOT IN (SELECT vendor_name FROM vendors WHERE company_id = 1))"""

_FLAT = f"""
flat AS (
  SELECT content || '-' || CAST(row_number() OVER (PARTITION BY content ORDER BY i.invoice_id) AS VARCHAR) AS row_id,
    'INV-' || CAST(i.invoice_id AS VARCHAR) || '-' || CAST(quantity AS VARCHAR) AS invoice_id,
    i.invoice_id AS order_key, vendor_name, invoice_date,
    CASE WHEN i.invoice_id % 89 <> 0 THEN quantity END AS quantity, unit_price, tax_percent AS gst_percent,
    CAST(line_total + CASE WHEN i.invoice_id % 53 = 0 THEN 10 ELSE 0 END AS DECIMAL(14,2)) AS total_amount
  FROM (SELECT *, md5(concat_ws('|', CAST(invoice_id AS VARCHAR), coalesce(product_name, ''), CAST(quantity AS VARCHAR),
      CAST(unit_price AS VARCHAR), CAST(tax_percent AS VARCHAR))) AS content FROM fitems) i
    JOIN faulted h ON h.invoice_id = i.invoice_id LEFT JOIN vendors v ON v.vendor_id = h.vendor_id),
flat_expected AS (
  SELECT *, round(quantity * unit_price + quantity * unit_price * coalesce(gst_percent, 0) * {CENT}, 2) AS expected
  FROM flat),
coded AS (
  SELECT *, list_filter([
      CASE WHEN count(*) OVER (PARTITION BY invoice_id) > 1 THEN 'DUPLICATE_INVOICE' END,
      CASE WHEN abs(expected - total_amount) > 1.0 THEN 'TOTAL_MISMATCH' END,
      CASE WHEN {blank('vendor_name')} OR quantity IS NULL OR unit_price IS NULL OR total_amount IS NULL
        THEN 'MISSING_FIELD' END,
      CASE WHEN unit_price > 3000 THEN 'PRICE_OUTLIER' END,
      CASE WHEN invoice_date > DATE '2001-01-01' THEN 'FUTURE_DATE' END,
      CASE WHEN invoice_date IS NULL THEN 'INVALID_DATE' END], lambda c: c IS NOT NULL) AS codes
  FROM flat_expected),
ruled AS (
  SELECT *, CASE WHEN list_contains(codes, 'TOTAL_MISMATCH') THEN 40 ELSE 0 END
    + CASE WHEN list_contains(codes, 'MISSING_FIELD') THEN 15 ELSE 0 END
    + CASE WHEN list_contains(codes, 'PRICE_OUTLIER') THEN 15 ELSE 0 END
    + CASE WHEN list_contains(codes, 'FUTURE_DATE') OR list_contains(codes, 'INVALID_DATE') THEN 10 ELSE 0 END
    AS rule_score FROM coded)"""


def _blend(name: str, anomaly: str, flag: str, source: str = "ruled") -> str:
    mixed = f"greatest(CAST(rule_score AS DECIMAL(9,2)), CAST({anomaly} AS DECIMAL(9,2)) * CAST(0.6 AS DECIMAL(2,1)) + rule_score * CAST(0.4 AS DECIMAL(2,1)))"
    return f"""
{name}_0 AS (SELECT *, round(least(CAST(100 AS DECIMAL(9,2)), {mixed}), 1) AS combined FROM {source}),
{name}_1 AS (SELECT *, list_contains(codes, 'DUPLICATE_INVOICE') AS dup,
  list_contains(codes, 'TOTAL_MISMATCH') OR combined >= 50 OR {flag} AS high FROM {name}_0),
{name} AS (SELECT *, CASE WHEN dup THEN 'Duplicate' WHEN high THEN 'High Risk' WHEN len(codes) > 0 THEN 'Needs Review'
    ELSE 'Valid' END AS status,
  CAST(CASE WHEN dup THEN 100 WHEN high THEN greatest(combined, 60) ELSE combined END AS DOUBLE) AS risk_score
  FROM {name}_1)"""


PRELUDE = "WITH " + ",".join(
    [
        f"""
companies AS (SELECT CAST(n_nationkey AS BIGINT) AS company_id, n_name AS company_name,
  '27AACCA' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || CASE WHEN n_nationkey % 9 = 4 THEN 'R1Y' ELSE 'R1Z' END || 'M'
    AS gst_number, 'accounts' || CAST(n_nationkey % 20 AS VARCHAR) || '@ledger.example' AS email FROM nation),
vendors_0 AS (SELECT *, lpad(CAST(c_custkey % 37 AS VARCHAR), 2, '0') || 'VENDR' ||
  lpad(CAST(c_custkey % 5000 AS VARCHAR), 4, '0') || 'F1Z5' AS gst FROM customer),
vendors AS (SELECT c_custkey AS vendor_id, CAST(c_nationkey AS BIGINT) AS company_id, c_name AS vendor_name,
  CASE WHEN c_custkey % 19 = 3 THEN NULL WHEN c_custkey % 23 = 5 THEN substr(gst, 1, 14) ELSE gst END AS gst_number,
  CASE WHEN c_custkey % 29 = 7 THEN 'vendor' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 31 = 2 THEN NULL
    ELSE 'vendor' || CAST(c_custkey AS VARCHAR) || '@mail.example' END AS email,
  CASE WHEN c_custkey % 41 = 6 THEN 'Suspended' WHEN c_custkey % 7 = 1 THEN 'Inactive'
    WHEN c_custkey % 13 = 1 THEN 'Blacklisted' ELSE 'Active' END AS status FROM vendors_0),
base_items_0 AS (SELECT l_orderkey, p_name, CAST(round(l_quantity * 1000) AS BIGINT) AS m,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(round(l_tax * 10000) AS BIGINT) AS r
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
base_items AS (SELECT l_orderkey AS invoice_id, p_name AS product_name,
  CAST(CAST(m AS DECIMAL(15,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(12,3)) AS quantity,
  CAST(CAST((2 * a * 1000 + m) // (2 * nullif(m, 0)) AS DECIMAL(15,0)) * {CENT} AS DECIMAL(14,2)) AS unit_price,
  CAST(CAST(r AS DECIMAL(15,0)) * {CENT} AS DECIMAL(5,2)) AS tax_percent FROM base_items_0)""",
        _items("items", False),
        _items("fitems", True),
        _heads("invoices", "items", False),
        _heads("faulted", "fitems", True),
        """
named_faulted AS (SELECT f.*, v.vendor_name FROM faulted f LEFT JOIN vendors v ON v.vendor_id = f.vendor_id)""",
        f"""
findings AS ({_rule_selects()})""",
        _assessed("assessed", "faulted", "findings"),
        """
reported AS (SELECT invoice_id, company_id, vendor_id, invoice_number, batch_id, invoice_date, subtotal, tax_amount,
  total_amount, CASE WHEN invoice_id % 97 = 1 THEN 'Duplicate' WHEN order_status = 'F' THEN 'Paid'
    WHEN order_status = 'P' THEN 'Pending' ELSE assessed_status END AS status, assessed_score AS risk_score
  FROM assessed),
invoice_rows AS (SELECT r.invoice_id, r.invoice_date, r.total_amount, r.risk_score, r.status, v.vendor_name
  FROM reported r LEFT JOIN vendors v ON v.vendor_id = r.vendor_id),
batches AS (SELECT batch_id, 'orders_' || CAST(batch_id AS VARCHAR) || '.csv' AS file_name,
  CASE WHEN batch_id % 3 = 0 THEN 'ap_team' ELSE 'admin' END AS uploaded_by,
  strftime(TIMESTAMP '2001-01-01 09:00:00' + to_days(CAST(batch_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS uploaded_at,
  count(*) AS total_invoices,
  count(*) FILTER (WHERE vendor_id IS NOT NULL AND invoice_date IS NOT NULL) AS processed_invoices,
  count(*) FILTER (WHERE vendor_id IS NULL OR invoice_date IS NULL) AS failed_invoices,
  CASE WHEN batch_id % 5 = 3 THEN 'Failed' WHEN batch_id % 5 = 4 THEN 'Processing' ELSE 'Completed' END AS status
  FROM faulted GROUP BY batch_id),
profile AS (SELECT coalesce(vendor_name, 'Unknown Vendor') AS name, count(*) AS "count",
  sum(coalesce(total_amount, 0)) AS amount,
  count(*) FILTER (WHERE status IN ('High Risk', 'Critical')) AS high_risk,
  count(*) FILTER (WHERE risk_score >= 40) AS risky FROM invoice_rows GROUP BY 1),
history AS (SELECT * FROM batches ORDER BY batch_id DESC LIMIT 50)""",
        _COPIES,
        _LINES,
        _FLAT,
        _blend("given", "order_key % 101", "order_key % 10 = 0"),
        _blend("unaided", "0", "false"),
        """
ratios AS (SELECT f.*, CASE WHEN mean = 0 THEN CASE WHEN unit_price <> 0 THEN 1.0 END
    ELSE CAST(unit_price AS DOUBLE) / mean END AS ratio
  FROM flat f LEFT JOIN (SELECT vendor_name, avg(CAST(unit_price AS DOUBLE)) AS mean FROM flat
    WHERE vendor_name IS NOT NULL GROUP BY vendor_name) m ON m.vendor_name = f.vendor_name),
filled AS (SELECT row_id, {_filled}
  FROM ratios)""".replace("{_filled}", ", ".join(
            f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM ratios)) AS {n}"
            for c, n in (("quantity", "quantity"), ("unit_price", "unit_price"), ("total_amount", "total_amount"),
                         ("ratio", "vendor_avg_price_ratio"))
        )),
    ]
)

_FEATURES = ("quantity", "unit_price", "total_amount", "vendor_avg_price_ratio")
_LEVELS, _TREES, _SAMPLE = 8, 200, 256


def _share(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _forest() -> str:
    """The forest level by level: samples, splits of the nodes of each level, and the way of each row through all trees."""
    scaled = ", ".join(
        f"coalesce(round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 9), 0) + 0.0::DOUBLE AS f{n}"
        for n, c in enumerate(_FEATURES)
    )
    features = ", ".join(f"f{n}" for n in range(4))

    def own(row: str, node: str) -> str:
        return f"CASE {node}.feature WHEN 0 THEN {row}.f0 WHEN 1 THEN {row}.f1 WHEN 2 THEN {row}.f2 ELSE {row}.f3 END"

    ranges = ", ".join(f"min(f{n}) AS low{n}, max(f{n}) AS high{n}" for n in range(4))
    wide = ", ".join(f"CASE WHEN high{n} > low{n} THEN {n} END" for n in range(4))
    bounds = "[low0, low1, low2, low3][feature + 1] AS low, [high0, high1, high2, high3][feature + 1] AS high"
    feature = _share("'42'", "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)", "'feature'")
    threshold = _share("'42'", "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)", "'threshold'")
    cut = f"low + {threshold} / 4294967296.0::DOUBLE * (high - low)"
    parts = [f"""
ml AS (SELECT row_id, {scaled} FROM filled),
ml_sizes AS (SELECT count(*) AS total, least(1.0::DOUBLE, 2.0::DOUBLE * {_TREES} * {_SAMPLE} / count(*)) AS kept,
  least(1.0::DOUBLE, 1.3::DOUBLE * {_SAMPLE} / count(*)) AS share FROM ml),
pool AS (SELECT row_id, {features} FROM ml, ml_sizes WHERE {_share("'42'", 'row_id')} < floor(kept * 4294967296)),
draws AS (SELECT * FROM (SELECT row_id, {features}, CAST(t AS INTEGER) AS tree,
    {_share('row_id', 'CAST(t AS VARCHAR)')} AS draw FROM pool, range({_TREES}) r(t)), ml_sizes
  WHERE draw < floor(least(1.0::DOUBLE, share / kept) * 4294967296)),
grown0 AS MATERIALIZED (SELECT tree, {features}, 1 AS node FROM draws
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, row_id) <= {_SAMPLE})"""]
    for level in range(_LEVELS + 1):
        chosen = "wide[1 + CAST(floor(pick / 4294967296.0::DOUBLE * len(wide)) AS INTEGER)]" if level < _LEVELS else "NULL"
        parts.append(f"""
nodes{level} AS MATERIALIZED (SELECT tree, node, n, feature, CASE WHEN cut >= high THEN low ELSE cut END AS threshold FROM (
  SELECT *, {cut} AS cut FROM (SELECT *, {bounds} FROM (
    SELECT *, {chosen} AS feature FROM (
      SELECT *, list_filter([{wide}], lambda x: x IS NOT NULL) AS wide, {feature} AS pick FROM (
        SELECT tree, node, count(*) AS n, {ranges} FROM grown{level} GROUP BY tree, node))))))""")
        if level < _LEVELS:
            parts.append(f"""
grown{level + 1} AS MATERIALIZED (SELECT g.tree, {features}, 2 * g.node + CASE WHEN {own('g', 'k')} <= k.threshold THEN 0 ELSE 1 END AS node
  FROM grown{level} g JOIN nodes{level} k ON g.tree = k.tree AND g.node = k.node WHERE k.feature IS NOT NULL)""")
    every = " UNION ALL ".join(
        f"""SELECT tree, node, feature, threshold, CAST(round(1000000 * ({level} + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
          ELSE 2 * (ln(n - 1) + 0.5772156649015329) - 2.0::DOUBLE * (n - 1) / n END)) AS BIGINT) AS path FROM nodes{level}"""
        for level in range(_LEVELS + 1)
    )
    parts.append(f"\nnodes AS MATERIALIZED ({every})")
    way = f"SELECT row_id, {features}, CAST(t AS INTEGER) AS tree, 1 AS node FROM ml, range({_TREES}) r(t)"
    for level in range(_LEVELS):
        step = f"CASE WHEN k.feature IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN {own('w', 'k')} <= k.threshold THEN 0 ELSE 1 END END"
        way = (f"SELECT row_id, {features}, w.tree, {step} AS node FROM ({way}) w "
               f"JOIN (SELECT * FROM nodes WHERE node < {2 ** (level + 1)}) k ON w.tree = k.tree AND w.node = k.node")
    mean = f"(-(depth / {1_000_000.0 * _TREES}::DOUBLE) / (2 * (ln({_SAMPLE} - 1) + 0.5772156649015329) - 2.0::DOUBLE * {_SAMPLE - 1} / {_SAMPLE}))"
    parts.append(f"""
depths AS MATERIALIZED (SELECT row_id, CAST(sum(path) AS BIGINT) AS depth FROM ({way}) w
  JOIN nodes k ON w.tree = k.tree AND w.node = k.node GROUP BY row_id),
isolated AS (SELECT *, pow(2.0::DOUBLE, {mean}) AS isolation, row_number() OVER (ORDER BY depth DESC) AS place FROM depths),
ml_scores AS (SELECT row_id, round((isolation - min(isolation) OVER ()) / (max(isolation) OVER () - min(isolation) OVER () + 1e-9) * 100, 1)
    AS ml_risk_score,
  depth < (SELECT depth FROM isolated WHERE place = (SELECT CAST(ceil((1.0::DOUBLE - 0.2::DOUBLE) * total) AS BIGINT) FROM ml_sizes)) AS ml_flag
  FROM isolated),
ruled_ml AS (SELECT r.*, ml_risk_score, ml_flag FROM ruled r JOIN ml_scores USING (row_id))""")
    return ",".join([*parts, _blend("aided", "ml_risk_score", "ml_flag", "ruled_ml")])


_TOTAL = "coalesce(total_amount, 0)"
_LOSS = "status IN ('High Risk', 'Critical', 'Duplicate')"
_KPIS = f"""SELECT (SELECT count(*) FROM batches) AS total_uploads, count(*) AS total_invoices,
  (SELECT CAST(coalesce(sum(processed_invoices), 0) AS BIGINT) FROM batches) AS processed,
  (SELECT CAST(coalesce(sum(failed_invoices), 0) AS BIGINT) FROM batches) AS failed,
  count(*) FILTER (WHERE status = 'Valid') AS valid,
  count(*) FILTER (WHERE status IN ('High Risk', 'Critical')) AS high_risk,
  count(*) FILTER (WHERE status = 'Duplicate') + (SELECT count(*) FROM pairs) AS duplicate,
  {dbl(f"coalesce(sum({_TOTAL}) FILTER (WHERE {_LOSS}), 0)")} AS potential_loss,
  {dbl(f"coalesce(sum({_TOTAL}), 0)")} AS total_value FROM invoice_rows"""


def _violation(check: str, table: str, key: str, source: str, condition: str) -> str:
    return (
        f"SELECT '{check}' AS check_name, '{table}' AS table_name, CAST({key} AS BIGINT) AS record_id "
        f"FROM {source} WHERE {condition}"
    )


def _repeated(check: str, table: str, key: str, source: str, columns: list[str]) -> str:
    cols = ", ".join(columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    counted = f"(SELECT *, count(*) OVER (PARTITION BY {cols}) AS n FROM {source} WHERE {known})"
    return _violation(check, table, key, counted, "n > 1")


_GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
_AMOUNTS = "least(subtotal, tax_amount, total_amount) < 0"
_STATE = f"'invoice_id=' || CAST(invoice_id AS VARCHAR) || ' status=' || assessed_status || ' risk_score=' || {float_text('assessed_score')}"

_MESSAGE_VENDOR = "coalesce(v.vendor_name, 'unknown')"
_OTHER = "'invoice #' || CAST(match_id AS VARCHAR) || ' (' || o.invoice_number || ')'"
_MESSAGE = f"""substr(CASE s.level
  WHEN 1 THEN 'Exact duplicate: ''' || c.invoice_number || ''' already exists as ' || {_OTHER} || '.'
  WHEN 2 THEN 'Vendor duplicate: same vendor ' || {_MESSAGE_VENDOR} || ' and amount ' || {float_text('c.total_amount')} ||
    ' and invoice date as ' || {_OTHER} || '.'
  WHEN 3 THEN 'Near duplicate: invoice number ' || CAST(CAST(floor(similarity) AS INTEGER) AS VARCHAR) || '% similar to ' ||
    {_OTHER} || ' (same vendor ' || {_MESSAGE_VENDOR} || ', amount differs by <= Rs.1).'
  WHEN 4 THEN 'Suspicious amount+date match: same vendor ' || {_MESSAGE_VENDOR} || ' and amount ' ||
    {float_text('c.total_amount')} || ' as ' || {_OTHER} || ' within 3 days.'
  ELSE 'Suspicious item-level duplicate: identical line items as ' || {_OTHER} || '.' END
  || ' | match_id=' || CAST(match_id AS VARCHAR) || ' | match_number=' || o.invoice_number ||
  CASE WHEN similarity IS NOT NULL THEN ' | similarity=' || {float_text('CAST(similarity AS DECIMAL(5,2))')} ELSE '' END, 1, 500)"""

_SPEND = "(SELECT sum(total_amount) FROM invoices)"


def _cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def _orphan(check: str, table: str, key: str, source: str, column: str, parent: str, parent_key: str) -> str:
    return _violation(
        check, table, key, source,
        f"{column} IS NOT NULL AND {column} NOT IN (SELECT {parent_key} FROM {parent})",
    )


_ITEMS_OUT = f"product_name, {dbl('quantity')} AS quantity, {dbl('unit_price')} AS unit_price"

_FINAL: dict[str, str] = {
    **dict.fromkeys(("a01_csv_lines", "a01_csv_files"), f"""SELECT {clean('invoice_number')} AS invoice_number, {clean('vendor_name')} AS vendor_name,
        {clean('invoice_date')} AS invoice_date, {clean('product_name')} AS product_name, {clean('quantity')} AS quantity,
        {clean('unit_price')} AS unit_price, {clean('gst_percent')} AS gst_percent, count(*) AS n FROM lines GROUP BY ALL"""),
    "a07_typed_csv": f"""SELECT row_id, vendor_name, CAST(invoice_date AS VARCHAR) AS invoice_date, {dbl('quantity')} AS quantity,
        {dbl('unit_price')} AS unit_price, {dbl('gst_percent')} AS gst_percent, {dbl('total_amount')} AS total_amount FROM flat""",
    "a08_batch_invoices": f"""SELECT i.invoice_id, vendor_name, {dbl('total_amount')} AS total_amount, {_ITEMS_OUT}
        FROM invoices i LEFT JOIN vendors v ON v.vendor_id = i.vendor_id LEFT JOIN items t ON t.invoice_id = i.invoice_id
        WHERE batch_id = 3""",
    "a09_company_invoices": """SELECT invoice_id, company_id FROM copies WHERE company_id IN
        (SELECT company_id FROM copies WHERE batch_id = 3)""",
    "a10_upload_history": "SELECT * FROM history",
    "a11_batch_detail": f"""SELECT b.*, invoice_id, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date, vendor_name,
        {dbl('subtotal')} AS subtotal, {dbl('tax_amount')} AS tax_amount, {dbl('total_amount')} AS total_amount,
        r.status AS invoice_status FROM batches b LEFT JOIN reported r ON r.batch_id = b.batch_id
        LEFT JOIN vendors v ON v.vendor_id = r.vendor_id WHERE b.batch_id = 3""",
    "a12_invoice_list": f"""SELECT invoice_id, CAST(invoice_date AS VARCHAR) AS invoice_date, {dbl('total_amount')} AS total_amount,
        {dbl('risk_score')} AS risk_score, status, vendor_name FROM invoice_rows""",
    "a13_invoice_detail": f"""SELECT r.invoice_id, CAST(invoice_date AS VARCHAR) AS invoice_date, {dbl('total_amount')} AS total_amount,
        {dbl('risk_score')} AS risk_score, r.status, r.vendor_id, vendor_name, gst_number, {_ITEMS_OUT},
        {dbl('quantity * unit_price')} AS amount FROM reported r LEFT JOIN vendors v ON v.vendor_id = r.vendor_id
        LEFT JOIN items t ON t.invoice_id = r.invoice_id""",
    "a14_export_rows": f"""SELECT invoice_id, vendor_name, {dbl('total_amount')} AS total_amount, status, risk_score,
        array_to_string(codes, '; ') AS issues_summary FROM unaided""",
    "a15_findings_trail": """SELECT run_id, batch_id, invoice_id, CAST(NULL AS BIGINT) AS match_id, validation_type, severity,
        message, CAST(NULL AS DOUBLE) AS confidence_score, CAST(NULL AS DOUBLE) AS similarity
        FROM findings JOIN faulted USING (invoice_id) JOIN (VALUES ('run-1', 10), ('run-2', 4)) r(run_id, last_rule)
        ON rule_no <= last_rule""",
    "a16_current_state": f"""SELECT c.invoice_id, coalesce(r.status, c.status) AS status,
        coalesce(r.risk_score, {dbl('c.risk_score')}) AS risk_score FROM copies c
        LEFT JOIN (SELECT * FROM rescored WHERE risk_score > 20) r ON r.invoice_id = c.invoice_id""",
    "a17_upload_events": """SELECT batch_id, position, CASE WHEN position = ended THEN 'Upload Failed' ELSE event END AS event,
        CASE WHEN position <> ended THEN details WHEN phase = 'policy' THEN
          'phase=policy file contains ' || CAST(groups AS VARCHAR) || ' invoices; use bulk upload'
          ELSE 'phase=' || phase || ' error=' || error END AS details FROM (
        SELECT c.batch_id, groups, phase, error, CASE phase WHEN 'parsing' THEN 2 WHEN 'policy' THEN 3
          WHEN 'database save' THEN 4 WHEN 'finalise' THEN 5 ELSE 6 END AS ended, unnest([
          {'position': 0, 'event': 'Upload Started', 'details': 'file=' || file_name || ' bytes=' || CAST(bytes AS VARCHAR) ||
            ' mode=' || CASE WHEN c.batch_id % 10 IN (1, 5, 9) THEN 'single' ELSE 'bulk' END},
          {'position': 1, 'event': 'Parsing Started', 'details': 'file=' || file_name},
          {'position': 2, 'event': 'Parsing Completed', 'details': 'rows=' || CAST(n AS VARCHAR)},
          {'position': 3, 'event': 'Database Save Started', 'details': 'invoice_groups=' || CAST(groups AS VARCHAR) ||
            ' ungrouped_rows=' || CAST(ungrouped AS VARCHAR)},
          {'position': 4, 'event': 'Database Save Completed', 'details': 'processed=' || CAST(processed AS VARCHAR) ||
            ' failed=' || CAST(groups - processed AS VARCHAR)},
          {'position': 5, 'event': 'Upload Completed', 'details': '{''batch_id'': ' || CAST(c.batch_id AS VARCHAR) ||
            ', ''file_name'': ''' || file_name || ''', ''total'': ' || CAST(groups + ungrouped AS VARCHAR) ||
            ', ''processed'': ' || CAST(processed AS VARCHAR) || ', ''failed'': ' ||
            CAST(groups - processed + ungrouped AS VARCHAR) || ', ''status'': ''Completed''}'}],
          recursive := true) FROM line_counts c JOIN batches b ON b.batch_id = c.batch_id
          JOIN (SELECT batch_id, CASE WHEN batch_id % 10 IN (3, 8) THEN 'parsing' WHEN batch_id % 10 IN (1, 5) THEN 'policy'
              WHEN batch_id % 10 = 6 THEN 'database save' WHEN batch_id % 10 = 7 THEN 'finalise' END AS phase,
            CASE WHEN batch_id % 10 IN (3, 8) THEN 'missing columns: unit_price'
              WHEN batch_id % 10 IN (6, 7) THEN 'connection lost' END AS error FROM batches) p ON p.batch_id = c.batch_id
          JOIN (SELECT batch_id, count(*) AS n, CAST(sum(strlen(coalesce(invoice_number, '')) + strlen(coalesce(vendor_name, '')) +
              strlen(coalesce(invoice_date, '')) + strlen(coalesce(product_name, '')) + strlen(coalesce(quantity, '')) +
              strlen(coalesce(unit_price, '')) + strlen(coalesce(gst_percent, '')) + 7) AS BIGINT) AS bytes
            FROM lines GROUP BY batch_id) l ON l.batch_id = c.batch_id)
        WHERE position <= ended""",
    "a17_validation_events": f"""
        SELECT a.batch_id, 0 AS position, 'Validation Started' AS event, 'file=' || file_name AS details
          FROM (SELECT DISTINCT batch_id FROM assessed) a JOIN batches b ON b.batch_id = a.batch_id
        UNION ALL SELECT batch_id, 1, 'Critical Issue Found', {_STATE} FROM assessed WHERE has_critical
        UNION ALL SELECT batch_id, 2, 'Validation Completed', {_STATE} || ' issues=' || CAST(issue_count AS VARCHAR) FROM assessed
        UNION ALL SELECT batch_id, 3, 'Batch Validation Completed', '{{''batch_id'': ' || CAST(batch_id AS VARCHAR) ||
          ', ''total_invoices'': ' || CAST(count(*) AS VARCHAR) ||
          ', ''valid'': ' || CAST(count(*) FILTER (WHERE assessed_status = 'Valid') AS VARCHAR) ||
          ', ''needs_review'': ' || CAST(count(*) FILTER (WHERE assessed_status = 'Needs Review') AS VARCHAR) ||
          ', ''high_risk'': ' || CAST(count(*) FILTER (WHERE assessed_status = 'High Risk') AS VARCHAR) ||
          ', ''critical'': ' || CAST(count(*) FILTER (WHERE assessed_status = 'Critical') AS VARCHAR) || '}}'
          FROM assessed GROUP BY batch_id""",
    "a17_duplicate_events": f"""SELECT * FROM (WITH chosen AS (SELECT batch_id, file_name FROM batches WHERE batch_id IN (0, 3, 7)),
        scan AS (SELECT CASE WHEN a_batch IN (0, 3, 7) THEN a_batch ELSE b_batch END AS batch_id,
          CASE WHEN a_batch IN (0, 3, 7) THEN a_id ELSE b_id END AS first_id,
          CASE WHEN a_batch IN (0, 3, 7) THEN b_id ELSE a_id END AS other_id, level, similarity
          FROM pairs WHERE a_batch IN (0, 3, 7) OR b_batch IN (0, 3, 7))
        SELECT batch_id, 0 AS position, 'Duplicate Detection Started' AS event, 'file=' || file_name AS details FROM chosen
        UNION ALL SELECT batch_id, 1, CASE level WHEN 1 THEN 'Exact Duplicate Found' WHEN 3 THEN 'Near Duplicate Found'
          ELSE 'Duplicate Match Found' END, 'invoice_id=' || CAST(first_id AS VARCHAR) || ' <-> invoice_id=' ||
          CAST(other_id AS VARCHAR) || CASE WHEN similarity IS NOT NULL THEN ' similarity=' ||
          {float_text('CAST(similarity AS DECIMAL(5,2))')} ELSE '' END FROM scan
        UNION ALL SELECT c.batch_id, 2, 'Batch Duplicate Scan Completed', '{{''batch_id'': ' || CAST(c.batch_id AS VARCHAR) ||
          ', ''exact_duplicates'': ' || CAST(count(*) FILTER (WHERE level = 1) AS VARCHAR) ||
          ', ''vendor_duplicates'': ' || CAST(count(*) FILTER (WHERE level = 2) AS VARCHAR) ||
          ', ''near_duplicates'': ' || CAST(count(*) FILTER (WHERE level = 3) AS VARCHAR) ||
          ', ''suspicious_duplicates'': ' || CAST(count(*) FILTER (WHERE level IN (4, 5)) AS VARCHAR) || '}}'
          FROM chosen c LEFT JOIN scan s ON s.batch_id = c.batch_id GROUP BY c.batch_id
        UNION ALL SELECT batch_id, 3, 'Upload Failed', 'phase=duplicates error=connection lost' FROM batches WHERE batch_id = 8)""",
    "b02_parsed_cells": f"""SELECT {clean('invoice_number')} AS invoice_number,
        CAST({date_text('invoice_date')} AS VARCHAR) AS invoice_date, {LABEL} AS product_name,
        {dbl(number('quantity'))} AS quantity, {dbl(number('unit_price'))} AS unit_price,
        {dbl(number('gst_percent'))} AS gst_percent FROM lines""",
    "b07_file_names": """SELECT page_id, substr(CASE WHEN n = '' THEN 'upload' ELSE n END, 1, 255) AS file_name FROM (
        SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(url, ''), '/+$', ''), '^.*/', '')),
        '[\\x00-\\x1f\\x7f]', '', 'g')) AS n FROM pages)""",
    "b08_expected_totals": f"""SELECT order_key, {dbl('quantity')} AS quantity, {dbl('unit_price')} AS unit_price,
        {dbl('gst_percent')} AS gst_percent, {dbl('total_amount')} AS total_amount, {dbl('expected')} AS expected_total,
        coalesce(abs(expected - total_amount) > 1.0, false) AS is_mismatch FROM flat_expected""",
    "b14_message_tokens": "SELECT invoice_id, validation_type, match_id, similarity FROM sides",
    "l01_ungrouped_lines": f"""SELECT batch_id, count(*) AS ungrouped FROM lines
        WHERE {clean('invoice_number')} = '' GROUP BY batch_id""",
    "l02_headers": "SELECT batch_id, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date, vendor_name FROM heads",
    "l03_rejected_invoices": """SELECT batch_id, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date, vendor_name
        FROM heads WHERE vendor_name = '' OR invoice_date IS NULL""",
    "l04_items": f"""SELECT batch_id, invoice_number, product_name, {dbl(r2('q'))} AS quantity, {dbl(r2('p'))} AS unit_price,
        {dbl(r2('g'))} AS tax_percent, {dbl('line_subtotal')} AS line_subtotal, {dbl('line_tax')} AS line_tax,
        {dbl('line_subtotal + line_tax')} AS line_total FROM line_items
        WHERE (batch_id, invoice_number) IN (SELECT (batch_id, invoice_number) FROM accepted)""",
    "l05_invoices": f"""SELECT batch_id, invoice_number, vendor_name, CAST(invoice_date AS VARCHAR) AS invoice_date,
        {dbl('subtotal')} AS subtotal, {dbl('tax_amount')} AS tax_amount, {dbl('total_amount')} AS total_amount,
        'Pending' AS status, 0.0::DOUBLE AS risk_score FROM loaded""",
    "l06_vendor_ids": "SELECT * FROM vendor_ids",
    "l06_linked_invoices": """SELECT batch_id, invoice_number, CAST(1 AS BIGINT) AS company_id, vendor_id FROM loaded
        LEFT JOIN (SELECT vendor_name, min(vendor_id) AS vendor_id FROM vendor_ids WHERE company_id = 1 GROUP BY 1) v
        USING (vendor_name)""",
    "l07_companies": """SELECT company_id, CASE WHEN company_id = 1 THEN 'Default of ' ELSE '' END || company_name AS company_name,
        gst_number, email FROM companies""",
    "l08_single_invoice_policy": """SELECT batch_id, count(DISTINCT invoice_number) AS invoice_groups,
        CASE WHEN count(DISTINCT invoice_number) > 1 THEN 'Failed' ELSE 'Completed' END AS status FROM grouped GROUP BY batch_id""",
    "l09_batch_counts": """SELECT batch_id, groups, ungrouped, groups + ungrouped AS total, processed,
        groups - processed + ungrouped AS failed FROM line_counts""",
    "l10_batch_rows": """SELECT batch_id, CASE WHEN batch_id % 5 = 3 THEN 0 ELSE groups + ungrouped END AS total_invoices,
        CASE WHEN batch_id % 5 = 3 THEN 0 ELSE processed END AS processed_invoices,
        CASE WHEN batch_id % 5 = 3 THEN 0 ELSE groups - processed + ungrouped END AS failed_invoices,
        CASE WHEN batch_id % 5 = 3 THEN 'Failed' ELSE 'Completed' END AS status FROM line_counts""",
    "l10_published_invoices": f"""SELECT batch_id, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date,
        {dbl('total_amount')} AS total_amount FROM loaded WHERE batch_id % 5 <> 3""",
    "r01_r10_findings": "SELECT invoice_id, CAST(rule_no AS BIGINT) AS rule_no, validation_type, severity, message FROM findings",
    "r11_r13_assessment": f"""SELECT invoice_id, issue_count, has_critical, {dbl('assessed_score')} AS assessed_score,
        assessed_status FROM assessed""",
    "r14_batch_summary": """SELECT batch_id, count(*) AS total_invoices,
        count(*) FILTER (WHERE assessed_status = 'Valid') AS valid,
        count(*) FILTER (WHERE assessed_status = 'Needs Review') AS needs_review,
        count(*) FILTER (WHERE assessed_status = 'High Risk') AS high_risk,
        count(*) FILTER (WHERE assessed_status = 'Critical') AS critical FROM assessed GROUP BY batch_id""",
    "k1_rule_component": """SELECT order_key, array_to_string(codes, ',') AS codes, CAST(rule_score AS BIGINT) AS rule_score
        FROM ruled""",
    "k2_blend": "SELECT order_key, CAST(rule_score AS BIGINT) AS rule_score, status, risk_score FROM given",
    "k3_scored_rows": "SELECT order_key, CAST(rule_score AS BIGINT) AS rule_score, status, risk_score FROM unaided",
    "k4_price_outliers": f"SELECT order_key, {dbl('unit_price')} AS unit_price FROM flat WHERE unit_price > 3000",
    "k5_summary": f"""SELECT count(*) AS total_invoices, count(*) FILTER (WHERE status = 'Valid') AS valid_count,
        count(*) FILTER (WHERE status = 'High Risk') AS high_risk_count,
        count(*) FILTER (WHERE status = 'Duplicate') AS duplicate_count,
        {dbl("coalesce(sum(coalesce(total_amount, 0)) FILTER (WHERE status <> 'Valid'), 0)")} AS total_flagged_amount FROM unaided""",
    "k5_results": f"""SELECT invoice_id, vendor_name, {dbl('total_amount')} AS total_amount, {dbl('expected')} AS expected_total,
        status, risk_score, array_to_string(codes, ',') AS codes FROM unaided""",
    "k6_gst_mismatch": f"""SELECT invoice_id, {dbl('tax_amount')} AS tax_amount, {dbl('item_tax')} AS item_tax,
        'GST_MISMATCH' AS validation_type FROM faulted JOIN (SELECT invoice_id, sum(line_tax) AS item_tax FROM items
        GROUP BY invoice_id) t USING (invoice_id) WHERE abs(item_tax - tax_amount) > 0.01""",
    "q1_gstin_format": _violation("gstin_format", "companies", "company_id", "companies",
                                  f"NOT regexp_matches(coalesce(gst_number, ''), '{_GSTIN}')")
    + " UNION ALL " + _violation("gstin_format", "vendors", "vendor_id", "vendors",
                                 f"NOT regexp_matches(gst_number, '{_GSTIN}')"),
    "q2_email_format": _violation("email_format", "vendors", "vendor_id", "vendors",
                                  "NOT regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$')"),
    "q3_batch_counters": _violation("batch_counters", "upload_batches", "batch_id", "batches",
                                    "least(total_invoices, processed_invoices, failed_invoices - 50) < 0"),
    "q4_invoice_money": _violation("invoice_money", "invoices", "invoice_id", "faulted",
                                   f"{_AMOUNTS} OR abs(subtotal + tax_amount - total_amount) > 0.01"),
    "q5_risk_range": _violation("risk_range", "invoices", "invoice_id", "reported",
                                "risk_score + invoice_id % 90 NOT BETWEEN 0 AND 100"),
    "q6_item_ranges": _violation("item_ranges", "invoice_items", "invoice_id", "fitems",
                                 "least(quantity, unit_price, line_total) < 0 OR tax_percent NOT BETWEEN 0 AND 100"),
    "q7_uniques": " UNION ALL ".join([
        _repeated("unique_gst", "companies", "company_id", "companies", ["gst_number"]),
        _repeated("unique_email", "companies", "company_id", "companies", ["email"]),
        _repeated("unique_gst", "vendors", "vendor_id", "vendors", ["company_id", "gst_number"]),
    ]),
    "q8_foreign_keys": " UNION ALL ".join([
        _orphan("vendor_company", "vendors", "vendor_id", "vendors", "company_id",
                "companies WHERE company_id <> 7", "company_id"),
        _orphan("invoice_company", "invoices", "invoice_id", "copies", "company_id",
                "companies WHERE company_id <> 7", "company_id"),
        _orphan("invoice_vendor", "invoices", "invoice_id", "copies", "vendor_id", "vendors", "vendor_id"),
        _orphan("invoice_batch", "invoices", "invoice_id", "copies", "batch_id", "batches WHERE batch_id <> 4", "batch_id"),
        _orphan("item_invoice", "invoice_items", "invoice_id", "copy_items", "invoice_id", "copies", "invoice_id"),
        _orphan("finding_invoice", "validation_results", "invoice_id", "findings", "invoice_id", "copies", "invoice_id"),
    ]),
    "q9_domains": " UNION ALL ".join([
        _violation("vendor_status", "vendors", "vendor_id", "vendors", "status NOT IN ('Active', 'Inactive', 'Blacklisted')"),
        _violation("finding_severity", "validation_results", "invoice_id", "findings", "rule_no = 8"),
    ]),
    "d04_number_similarity": f"""SELECT a.invoice_id, CASE WHEN a.invoice_number = b.invoice_number THEN 100.0
        ELSE {similarity('a.invoice_number', 'b.invoice_number')} END AS similarity
        FROM copies a JOIN copies b ON b.invoice_id = a.invoice_id + 10000000""",
    "d05_item_groups": """SELECT count(*) AS members, min(invoice_id) AS first_id FROM signatures GROUP BY sig
        HAVING count(*) > 1""",
    "d14_pairs": """SELECT a_id, b_id, CAST(level AS BIGINT) AS level, validation_type, severity,
        CAST(confidence AS BIGINT) AS confidence, CAST(penalty AS BIGINT) AS penalty, similarity FROM pairs""",
    "d15_batch_scan": "SELECT a_id, b_id, validation_type FROM pairs WHERE a_batch = 3 OR b_batch = 3",
    "d16_findings": f"""SELECT s.invoice_id, match_id, validation_type, severity, {_MESSAGE} AS message,
        {dbl('confidence')} AS confidence_score, similarity
        FROM sides s JOIN copies c ON c.invoice_id = s.invoice_id JOIN copies o ON o.invoice_id = match_id
        LEFT JOIN vendors v ON v.vendor_id = c.vendor_id""",
    "d18_prior_pairs": "SELECT validation_type, a_id, b_id FROM prior",
    "d19_rescore": "SELECT invoice_id, rule_score, risk_score, status FROM rescored",
    "d19_scan_scores": f"""SELECT s.invoice_id, CAST(least(rule_points, 100) AS DOUBLE) AS rule_score,
        CAST(least(least(rule_points, 100) + points, 100) AS DOUBLE) AS risk_score,
        {status_of('least(least(rule_points, 100) + points, 100)')} AS status
        FROM (SELECT invoice_id, sum(penalty) AS points FROM sides GROUP BY invoice_id) s JOIN copy_scores USING (invoice_id)""",
    "d20_scan_summary": """SELECT count(*) FILTER (WHERE level = 1) AS exact_duplicates,
        count(*) FILTER (WHERE level = 2) AS vendor_duplicates, count(*) FILTER (WHERE level = 3) AS near_duplicates,
        count(*) FILTER (WHERE level IN (4, 5)) AS suspicious_duplicates FROM pairs""",
    "d20_batch_scan_summary": """SELECT count(*) FILTER (WHERE level = 1) AS exact_duplicates,
        count(*) FILTER (WHERE level = 2) AS vendor_duplicates, count(*) FILTER (WHERE level = 3) AS near_duplicates,
        count(*) FILTER (WHERE level IN (4, 5)) AS suspicious_duplicates FROM pairs WHERE a_batch = 3 OR b_batch = 3""",
    "d21_pair_listing": f"""SELECT invoice_a_id, invoice_a_number, invoice_b_id, invoice_b_number, vendor_name,
        {dbl('amount_a')} AS amount_a, {dbl('amount_b')} AS amount_b, CAST(invoice_date_a AS VARCHAR) AS invoice_date_a,
        CAST(invoice_date_b AS VARCHAR) AS invoice_date_b,
        CAST(invoice_a_id AS VARCHAR) || ',' || CAST(invoice_b_id AS VARCHAR) AS matched_ids, validation_type, severity,
        {dbl('confidence_score')} AS confidence_score, similarity FROM listing""",
    "d22_badge_counts": """SELECT count(*) FILTER (WHERE level = 1) AS exact, count(*) FILTER (WHERE level = 3) AS near,
        count(*) FILTER (WHERE level IN (2, 4, 5)) AS suspicious FROM pairs""",
    "s01_duplicate_numbers": f"""SELECT invoice_number, submissions, {dbl('exposure')} AS exposure, invoice_id, status FROM copies
        JOIN (SELECT invoice_number, count(*) AS submissions, sum(total_amount) AS exposure FROM copies
        GROUP BY invoice_number HAVING count(*) > 1) g USING (invoice_number)""",
    "s02_vendor_spend": f"""SELECT vendor_name, count(*) AS invoice_count, {dbl('sum(total_amount)')} AS total_spend,
        CAST(({_cents('sum(total_amount)')} * 20000 + {_cents(_SPEND)}) // (2 * {_cents(_SPEND)}) AS DOUBLE) / 100 AS spend_pct
        FROM invoices JOIN vendors USING (vendor_id) GROUP BY vendor_id, vendor_name""",
    "s03_monthly_trend": f"""SELECT strftime(invoice_date, '%Y-%m') AS month, count(*) AS invoice_count,
        {dbl('sum(total_amount)')} AS invoiced_amount, {mean2('sum(total_amount)', 'count(*)')} AS avg_amount
        FROM invoices GROUP BY 1""",
    "s04_risky_invoices": f"""SELECT invoice_id, invoice_number, vendor_name, CAST(invoice_date AS VARCHAR) AS invoice_date,
        {dbl('total_amount')} AS total_amount, {dbl('risk_score')} AS risk_score, r.status
        FROM reported r JOIN vendors v ON v.vendor_id = r.vendor_id
        WHERE r.status IN ('High Risk', 'Needs Review', 'Duplicate') ORDER BY r.risk_score DESC, invoice_id LIMIT 25""",
    "s05_top_products": f"""SELECT product_name, count(*) AS line_count, {dbl('round(sum(quantity * unit_price), 2)')} AS gross_value,
        {mean2('sum(unit_price)', 'count(*)')} AS avg_unit_price, {dbl('max(unit_price)')} AS max_unit_price
        FROM items GROUP BY product_name ORDER BY round(sum(quantity * unit_price), 2) DESC, product_name LIMIT 10""",
    "s06_tax_summary": f"""SELECT {dbl('tax_percent')} AS gst_rate, count(*) AS line_count,
        {dbl('round(sum(quantity * unit_price), 2)')} AS taxable_base,
        {dbl(f'round(sum(quantity * unit_price * tax_percent * {CENT}), 2)')} AS tax_amount,
        {dbl('sum(line_total)')} AS billed_amount FROM items GROUP BY tax_percent""",
    "s07_pending_invoices": f"""SELECT invoice_number, vendor_name, CAST(invoice_date AS VARCHAR) AS invoice_date,
        {dbl('total_amount')} AS total_amount, r.status, CAST(DATE '2001-01-01' - invoice_date AS BIGINT) AS days_pending
        FROM reported r JOIN vendors v ON v.vendor_id = r.vendor_id WHERE r.status = 'Pending'""",
    "s08_invoices_per_vendor": """SELECT vendor_name, v.status, count(invoice_id) AS invoice_count FROM vendors v
        LEFT JOIN invoices i ON i.vendor_id = v.vendor_id GROUP BY v.vendor_id, vendor_name, v.status""",
    "s09_value_range": f"""SELECT {mean2('sum(total_amount)', 'count(*)')} AS avg_invoice_value,
        {dbl('min(total_amount)')} AS min_invoice_value, {dbl('max(total_amount)')} AS max_invoice_value FROM invoices""",
    "s10_vendor_average": f"""SELECT vendor_name, count(*) AS invoice_count, {mean2('sum(total_amount)', 'count(*)')}
        AS avg_invoice_value FROM invoices JOIN vendors USING (vendor_id) GROUP BY vendor_id, vendor_name""",
    "s11_finding_counts": "SELECT validation_type, severity, count(*) AS issue_count FROM findings GROUP BY 1, 2",
    "s12_potential_loss": f"""SELECT {dbl('sum(total_amount)')} AS potential_loss FROM reported
        WHERE status IN ('High Risk', 'Duplicate')""",
    "s13_paid_with_mismatch": f"""SELECT validation_type, severity, message, '2001-01-02 00:00:00' AS created_at, invoice_number,
        vendor_name, {dbl('total_amount')} AS total_amount, r.status FROM findings f JOIN reported r ON r.invoice_id = f.invoice_id
        JOIN vendors v ON v.vendor_id = r.vendor_id
        WHERE r.status = 'Paid' AND validation_type IN ('TOTAL_MISMATCH', 'GST_MISMATCH')""",
    "s14_repeated_ids": "SELECT invoice_id, count(*) AS submissions FROM flat GROUP BY 1 HAVING count(*) > 1",
    "s15_high_risk": f"""SELECT invoice_id, vendor_id, {dbl('total_amount')} AS total_amount, {dbl('risk_score')} AS risk_score,
        status FROM reported WHERE status = 'High Risk'""",
    "s16_monthly_anomalies": """SELECT strftime(invoice_date, '%Y-%m') AS month,
        count(*) FILTER (WHERE status = 'High Risk') AS high_risk_count,
        count(*) FILTER (WHERE status = 'Duplicate') AS duplicate_count, count(*) AS total_invoices FROM reported GROUP BY 1""",
    "s17_vendor_names": f"""SELECT substr(vendor_name, 1, 17) AS vendor_name, {mean2('sum(total_amount)', 'count(*)')}
        AS avg_invoice_amount, count(*) AS invoice_count FROM invoices JOIN vendors USING (vendor_id) GROUP BY 1""",
    "v01_monthly_series": """SELECT * FROM (SELECT strftime(invoice_date, '%Y-%m') AS label, count(*) AS value FROM invoice_rows
        WHERE invoice_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 10)""",
    "v02_amount_series": f"""SELECT strftime(invoice_date, '%Y-%m') AS label, CAST(floor(sum({_TOTAL}) + 0.5) AS BIGINT) AS value
        FROM invoice_rows WHERE invoice_date IS NOT NULL GROUP BY 1""",
    "v03_status_distribution": "SELECT coalesce(status, 'Pending') AS label, count(*) AS value FROM invoice_rows GROUP BY 1",
    "v04_vendor_profile": f'SELECT name, "count", {dbl("amount")} AS amount, high_risk, risky FROM profile',
    "v05_risk_buckets": """SELECT position, label, (SELECT count(*) FROM invoice_rows
        WHERE coalesce(risk_score, 0) >= low AND coalesce(risk_score, 0) < high) AS value
        FROM (VALUES (0::BIGINT, '0–25', 0, 25), (1, '25–50', 25, 50), (2, '50–75', 50, 75), (3, '75–100', 75, 101))
        b(position, label, low, high)""",
    "v06_duplicate_levels": f"""SELECT validation_type AS type, count(*) AS "count", {dbl('sum(abs(amount_a))')} AS amount,
        min(severity) AS severity, {dbl('max(confidence_score)')} AS confidence FROM listing GROUP BY 1""",
    "v07_executive_kpis": _KPIS,
    "v08_executive_shares": f"""SELECT {half_up('100 * valid', 'total_invoices')} AS valid_share,
        {half_up('100 * high_risk', 'total_invoices')} AS risk_share, total_value FROM ({_KPIS})""",
    "v09_vendor_kpis": f"""SELECT count(*) AS vendors, {dbl('sum(amount)')} AS spend,
        CAST(sum(high_risk) AS BIGINT) AS high_risk_invoices, count(*) FILTER (WHERE high_risk > 0) AS risky_vendors,
        {half_up(_cents('sum(amount)'), '(count(*) * 100)')} AS avg_per_vendor FROM profile""",
    "v10_spend_share": f"""SELECT name, {half_up(f"100 * {_cents('amount')}", _cents('(SELECT sum(amount) FROM profile)'))} AS value
        FROM profile ORDER BY amount DESC, name LIMIT 7""",
    "v10_vendor_heat": f"""SELECT name,
        {half_up('100 * "count"', '(SELECT greatest(max("count"), 1) FROM profile)')} AS invoices,
        {half_up('100 * high_risk', '(SELECT greatest(max(high_risk), 1) FROM profile)')} AS high_risk,
        {half_up(f"100 * {_cents('amount')}", _cents('(SELECT greatest(max(amount), 1) FROM profile)'))} AS spend
        FROM profile ORDER BY amount DESC, name LIMIT 8""",
    "v10_vendor_ranking": f"""SELECT name, "count", high_risk, {dbl('amount')} AS amount FROM profile
        ORDER BY profile.amount DESC, name LIMIT 10""",
    "v11_validation_kpis": f"""SELECT {half_up("100 * count(*) FILTER (WHERE status = 'Valid')", 'count(*)')} AS pass_rate,
        count(*) FILTER (WHERE status = 'Needs Review') AS needs_review,
        count(*) FILTER (WHERE status IN ('High Risk', 'Critical')) AS at_risk,
        {dbl("coalesce(sum(coalesce(total_amount, 0)) FILTER (WHERE status NOT IN ('Valid', 'Pending')), 0)")} AS flagged_value,
        {half_up("100 * count(*) FILTER (WHERE status IN ('High Risk', 'Critical'))", 'count(*)')} AS flagged_rate
        FROM invoice_rows""",
    "v12_duplicate_kpis": f"""SELECT count(*) AS pairs, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_pairs,
        {dbl('coalesce(sum(abs(amount_a)), 0)')} AS exposure, {dbl('max(confidence_score)')} AS max_confidence FROM listing""",
    "v13_audit_kpis": """SELECT count(*) AS batches, count(*) FILTER (WHERE status = 'Completed') AS completed,
        count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status = 'Processing') AS processing,
        CAST(sum(processed_invoices) AS BIGINT) AS processed_invoices, CAST(sum(failed_invoices) AS BIGINT) AS failed_invoices,
        max_by(uploaded_by, batch_id) AS latest_uploader FROM batches""",
    "v14_landing_kpis": f"""SELECT count(*) AS total_invoices, count(*) FILTER (WHERE status = 'High Risk') AS high_risk,
        count(*) FILTER (WHERE status = 'Duplicate') AS duplicates,
        {dbl("coalesce(sum(coalesce(total_amount, 0)) FILTER (WHERE status <> 'Valid'), 0)")} AS flagged_amount FROM invoice_rows""",
    "v15_flagged_invoices": f"""SELECT invoice_id, CAST(invoice_date AS VARCHAR) AS invoice_date, {dbl('total_amount')} AS total_amount,
        {dbl('risk_score')} AS risk_score, status, vendor_name FROM invoice_rows WHERE status <> 'Valid'""",
    "v16_status_share": """SELECT status AS label, count(*) AS value,
        round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM invoice_rows), 6) AS share FROM invoice_rows GROUP BY 1""",
    "m2_price_ratio": f"SELECT order_key, {dbl('unit_price')} AS unit_price, round(ratio, 6) AS ratio FROM ratios",
    "m3_medians": """SELECT feature, round(median(value), 6) AS median FROM (
        SELECT 'quantity' AS feature, CAST(quantity AS DOUBLE) AS value FROM ratios
        UNION ALL SELECT 'unit_price', CAST(unit_price AS DOUBLE) FROM ratios
        UNION ALL SELECT 'total_amount', CAST(total_amount AS DOUBLE) FROM ratios
        UNION ALL SELECT 'vendor_avg_price_ratio', ratio FROM ratios) GROUP BY feature""",
    "m3_filled_rows": """SELECT row_id, quantity, unit_price, total_amount, round(vendor_avg_price_ratio, 6) AS vendor_avg_price_ratio
        FROM filled""",
    "m4_scaled_rows": "SELECT row_id, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) + 0.0::DOUBLE AS {c}" for c in _FEATURES
    ) + " FROM filled",
}

# Statements that need the forest, which the others are spared.
_WITH_FOREST: dict[str, str] = {
    "m5_m7_anomaly_scores": "SELECT row_id, ml_risk_score, ml_flag FROM ml_scores",
    "k3_scored_with_ml": """SELECT row_id, invoice_id, CAST(rule_score AS BIGINT) AS rule_score, ml_risk_score, ml_flag, status, risk_score
        FROM aided""",
}


def statements() -> dict[str, str]:
    plain = {name: f"{PRELUDE}\n{final}" for name, final in _FINAL.items()}
    forest = f"{PRELUDE},{_forest()}"
    return plain | {name: f"{forest}\n{final}" for name, final in _WITH_FOREST.items()}
