import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billsift import schemas
from billsift.functions import similarity
from billsift.operators import duplicates, near
from tests import brute

EPOCH = date(1970, 1, 1)
INVOICES = (
    "invoice_id long, company_id long, vendor_id long, invoice_number string, batch_id long, "
    "invoice_date date, total_amount decimal(14,2)"
)
ITEMS = "invoice_id long, product_name string, quantity decimal(12,3), unit_price decimal(14,2)"


def frames(spark, invoices):
    rows = [
        (
            x["invoice_id"], x["company_id"], x["vendor_id"], x["invoice_number"], x["batch_id"],
            None if x["day"] is None else EPOCH + timedelta(days=x["day"]),
            None if x["cents"] is None else Decimal(x["cents"]).scaleb(-2),
        )
        for x in invoices
    ]
    lines = [
        (x["invoice_id"], name, Decimal(q), Decimal(p)) for x in invoices for name, q, p in x["items"]
    ]
    return spark.createDataFrame(rows, INVOICES), spark.createDataFrame(lines, ITEMS)


def random_invoices(seed, count, number, vendors=3, companies=2, nulls=True):
    rng = random.Random(seed)
    out = []
    for i in range(1, count + 1):
        company = rng.randrange(companies)
        out.append(
            {
                "invoice_id": i,
                "company_id": company,
                "vendor_id": None if nulls and rng.random() < 0.03 else company * 10 + rng.randrange(vendors),
                "invoice_number": number(rng),
                "batch_id": rng.randrange(3),
                "day": None if nulls and rng.random() < 0.03 else 10_000 + rng.randrange(12),
                "cents": rng.choice([10000, 10001, 10002, 10050, 10100, 10101, 10399, 10400, 25000]),
                "items": [(rng.choice("ab"), str(rng.randrange(1, 3)), "1.50") for _ in range(rng.randrange(4))],
            }
        )
    return out


def short_number(rng):
    return "INV-%04d" % rng.randrange(60) if rng.random() < 0.8 else "Inv %04d A" % rng.randrange(60)


def found(pairs):
    return {(r["a_id"], r["b_id"]): r["level"] for r in pairs.collect()}


@pytest.mark.parametrize("seed", [1])
def test_pairs_equal_brute_force(spark, seed):
    invoices = random_invoices(seed, 150, short_number)
    rows = duplicates.scan_rows(*frames(spark, invoices))
    assert found(duplicates.duplicate_pairs(rows)) == brute.all_pairs(invoices)


def test_unknown_companies_match_any(spark):
    invoices = random_invoices(5, 90, short_number)
    for x in invoices[::7]:
        x["company_id"] = None
    rows = duplicates.scan_rows(*frames(spark, invoices))
    pairs = duplicates.duplicate_pairs(rows)
    assert found(pairs) == brute.all_pairs(invoices)


def test_batch_scan_needs_a_scanned_side(spark):
    invoices = random_invoices(3, 150, short_number)
    scanned = {x["invoice_id"] for x in invoices if x["batch_id"] == 1}
    rows = duplicates.scan_rows(*frames(spark, invoices), batch_ids=[1])
    expected = brute.all_pairs(invoices, scanned)
    assert found(duplicates.duplicate_pairs(rows)) == expected
    totals = duplicates.pair_totals(rows).first()
    assert list(totals) == [list(expected.values()).count(n) for n in (1, 2, 3, 4, 5)]


@pytest.mark.parametrize("seed", [11])
def test_totals_count_hot_groups_exactly(spark, seed):
    """One vendor, one amount, one item list: every group is hot."""
    rng = random.Random(seed)
    invoices = random_invoices(seed, 120, short_number, vendors=1, companies=1, nulls=False)
    for x in invoices:
        if rng.random() < 0.7:
            x.update(cents=10000, day=10_000, items=[("hosting", "1", "9.99")])
    rows = duplicates.scan_rows(*frames(spark, invoices))
    expected = list(brute.all_pairs(invoices).values())
    totals = duplicates.pair_totals(rows).first()
    assert list(totals) == [expected.count(n) for n in (1, 2, 3, 4, 5)]


def _measures(rows):
    return {r["level"]: (r["pairs"], int(r["amount"] * 100)) for r in duplicates.pair_measures(rows).collect()}


def _expected_measures(invoices, pairs):
    cents = {x["invoice_id"]: abs(x["cents"] or 0) for x in invoices}
    out = {}
    for (a, _), level in pairs.items():
        n, amount = out.get(level, (0, 0))
        out[level] = (n + 1, amount + cents[a])
    return out


def _scores(pairs):
    partners = {}
    for (a, b), level in pairs.items():
        for i in (a, b):
            partners[i] = partners.get(i, 0) + brute.CODES[level]
    return {i: min(10.0 + p, 100.0) for i, p in partners.items()}


def _found_scores(spark, rows, frame):
    prior = spark.createDataFrame([], "validation_type string, a_id long, b_id long")
    assessed = frame.withColumn("assessed_score", F.lit(10))
    return {r["invoice_id"]: float(r["risk_score"]) for r in duplicates.scan_scores(rows, prior, assessed).collect()}


@pytest.mark.parametrize(("unknown", "batches"), [(False, None), (True, [1])])
def test_measures_and_scores_without_a_list(spark, unknown, batches):
    """Groups of all sizes, amounts a cent apart, unknown companies, blank numbers: no pair is listed."""
    rng = random.Random(21)
    invoices = random_invoices(21, 150, short_number, nulls=unknown)
    for x in invoices[:30]:
        x["invoice_number"] = "N/A"
    for x in invoices[30:60]:
        x.update(vendor_id=1, company_id=1, cents=777 + rng.randrange(2), day=5, invoice_number=short_number(rng))
    for x in invoices[60:80]:
        x["items"] = [("hosting", "1", "9.99")]
    for x in invoices[80:100]:
        x.update(vendor_id=2, company_id=1, cents=9_000 + rng.randrange(60), invoice_number="INV-2024-0000%d" % rng.randrange(3))
    for x in invoices[::9] if unknown else []:
        x["company_id"] = None
    frame, items = frames(spark, invoices)
    rows = duplicates.scan_rows(frame, items, batches)
    scanned = None
    if batches is not None:
        scanned = {x["invoice_id"] for x in invoices if x["batch_id"] in batches}
        # Other rows take part if their company is known to the scan.
        tenants = {x["company_id"] for x in invoices if x["invoice_id"] in scanned} - {None}
        invoices = [x for x in invoices if x["invoice_id"] in scanned or x["company_id"] in tenants]
    expected = brute.all_pairs(invoices, scanned)
    assert _measures(rows) == _expected_measures(invoices, expected)
    assert list(duplicates.pair_totals(rows).first()) == [list(expected.values()).count(n) for n in (1, 2, 3, 4, 5)]
    assert _found_scores(spark, rows, frame) == _scores(expected)
    assert found(duplicates.duplicate_pairs(rows)) == expected


@pytest.mark.parametrize("size", [101, 1000])
def test_groups_of_any_size(spark, size, monkeypatch):
    """One form of the result: all pairs are listed, and the measures agree with the list."""
    monkeypatch.setattr(duplicates, "MEMBERS_PER_TASK", 64)
    invoices = random_invoices(4, size + 20, lambda r: "N%07d" % r.randrange(10**7), vendors=1, companies=1, nulls=False)
    for n, x in enumerate(invoices):
        x.update(cents=10**6 * n, day=20_000 + 10 * n, items=[("p%d" % n, "1", "2")])
    for x in invoices[:size]:
        x["invoice_number"] = "N/A"
    frame, items = frames(spark, invoices)
    rows = duplicates.scan_rows(frame, items)
    pairs = found(duplicates.duplicate_pairs(rows))
    ids = [x["invoice_id"] for x in invoices[:size]]
    assert sum(level == 1 for level in pairs.values()) == size * (size - 1) // 2
    assert all(pairs[min(a, b), max(a, b)] == 1 for a, b in zip(ids, ids[1:], strict=False))
    assert _measures(rows) == _expected_measures(invoices, pairs)
    assert _found_scores(spark, rows, frame) == _scores(pairs)


def test_scores_list_few_pairs(spark):
    invoices = random_invoices(4, 600, lambda r: "N%07d" % r.randrange(10**7), vendors=1, companies=1, nulls=False)
    for n, x in enumerate(invoices):
        x.update(invoice_number="N/A", cents=10**6 * n, day=20_000 + 10 * n, items=[])
    rows = duplicates.scan_rows(*frames(spark, invoices))
    assert duplicates._matches(rows, duplicates.SATURATING_PARTNERS).count() < 601


def near_by_route(spark, numbers, hot_block, max_keys=near.MAX_KEYS):
    rows = [(i, i, 1, 1, 1, 1, n, n.lower(), 1000 + i % 90) for i, n in enumerate(numbers)]
    cells = spark.createDataFrame(
        rows,
        "cell long, anchor long, n long, n_scanned long, company_id long, vendor_id long, number string, "
        "number_key string, cents long",
    )
    out = near.near_cells(cells, hot_block=hot_block, max_keys=max_keys)
    out = similarity.with_number_similarity(out, "a_number", "b_number").collect()
    return {(r["a_cell"], r["b_cell"]): r["similarity"] for r in out}


@pytest.mark.parametrize("kind", ["digits", "long", "spaced", "mixed"])
def test_hot_blocks_find_the_same_pairs(spark, kind):
    rng = random.Random(kind)
    make = {
        "digits": lambda: "INV-2024-%05d" % rng.randrange(300),
        "long": lambda: "%030x" % rng.getrandbits(120),
        "spaced": lambda: " ".join(rng.sample(["AB12", "CD34", "EF%02d" % rng.randrange(20)], 3)),
        "mixed": lambda: "".join(rng.choice("01") for _ in range(rng.randrange(1, 24))),
    }[kind]
    numbers = [make() for _ in range(90)]
    for n in list(numbers[:30]):
        at = rng.randrange(len(n))
        numbers.append((n[:at] + rng.choice("xyz") + n[at + rng.randrange(2):]).strip())
    numbers = sorted(set(numbers))
    expected = {
        (i, j): brute.similarity(numbers[i], numbers[j])
        for i in range(len(numbers))
        for j in range(i + 1, len(numbers))
        if brute.similarity(numbers[i], numbers[j]) >= 90 and numbers[i].lower() != numbers[j].lower()
    }
    assert expected
    assert near_by_route(spark, numbers, hot_block=10_000) == expected
    assert near_by_route(spark, numbers, hot_block=2) == expected
    assert near_by_route(spark, numbers, hot_block=2, max_keys=1) == expected


def test_similarity_values(spark):
    cases = [
        ("INV-1024", "INV1024", 93.33), ("INV-1024", "INV-1025", 87.5), ("A B", "B A", 100.0),
        ("", "", 100.0), ("", "x", 0.0), ("abc", "ABC", 0.0),
        ("a" * 70 + "b", "a" * 70 + "c", brute.similarity("a" * 70 + "b", "a" * 70 + "c")),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r["similarity"] for r in similarity.with_number_similarity(df, "a", "b").collect()]
    assert got == [c[2] for c in cases]


def test_similarity_equals_definition(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab 1") for _ in range(rng.randrange(0, 14))).strip() for _ in range(200)]
    pairs = list(zip(texts[::2], texts[1::2]))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["similarity"] for r in similarity.with_number_similarity(df, "a", "b").collect()]
    assert got == [brute.similarity(a, b) for a, b in pairs]


def test_level_on_pair_rows(spark):
    invoices = random_invoices(8, 60, short_number)
    frame, items = frames(spark, invoices)
    full = frame.join(duplicates.item_fingerprint(items), "invoice_id", "left")
    a = full.select(*[F.col(c).alias(f"a_{c}") for c in full.columns])
    b = full.select(*[F.col(c).alias(f"b_{c}") for c in full.columns])
    pairs = a.join(b, F.col("a_invoice_id") < F.col("b_invoice_id"))
    got = duplicates.with_level(pairs, "a_", "b_").filter("level is not null").collect()
    assert {(r["a_invoice_id"], r["b_invoice_id"]): r["level"] for r in got} == brute.all_pairs(invoices)


def test_predicates(spark):
    df = spark.createDataFrame(
        [(Decimal("1.00"), Decimal("1.01"), date(2024, 1, 1), date(2024, 1, 4)),
         (Decimal("1.00"), Decimal("1.02"), date(2024, 1, 1), date(2024, 1, 5)),
         (Decimal("1.00"), Decimal("2.00"), date(2024, 1, 1), date(2024, 1, 1)),
         (Decimal("1.00"), Decimal("2.01"), None, date(2024, 1, 1)),
         (None, Decimal("1.00"), None, None)],
        "x decimal(14,2), y decimal(14,2), d date, e date",
    )
    x, y, d, e = (F.col(c) for c in "xyde")
    got = df.select(
        duplicates.amounts_equal(x, y), duplicates.amounts_near(x, y),
        duplicates.dates_close(d, e), duplicates.dates_equal(d, e),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, True, True, False), (False, True, False, False), (False, True, True, True),
        (False, False, False, False), (False, False, False, False),
    ]


def test_item_identity(spark):
    rows = [
        (1, "Straße", "1", "2.00"), (1, "b", "1", "2.00"),
        (2, "B ", "1", "2.00"), (2, "STRASSE", "1", "2.00"),
        (3, None, "1", "2.00"), (4, "General", "1", "2.00"),
        (5, "b", "1", "2.00"), (5, "b", "1", "2.00"), (6, "b", "1", "2.00"),
    ]
    items = spark.createDataFrame([(i, n, Decimal(q), Decimal(p)) for i, n, q, p in rows], ITEMS)
    prints = {r["invoice_id"]: r["fingerprint"] for r in duplicates.item_fingerprint(items).collect()}
    assert prints[1] == prints[2]
    assert prints[3] == prints[4]
    assert len({prints[5], prints[6], prints[1], prints[3]}) == 4


def test_equal_fingerprints_of_different_items(spark):
    rows = [
        (1, "a", "1", "2.00"), (1, "b", "1", "2.00"), (2, "B", "1", "2.00"), (2, "A", "1", "2.00"),
        (3, "a", "1", "2.00"), (4, "a", "1", "2.00"), (4, "a", "1", "2.00"),
        (5, "a", "1", "2.00"), (5, "b", "1", "2.00"), (5, "b", "1", "2.00"),
        (6, None, "1", None), (7, "general", "1", "0"), (8, " a", "1.0004", "2.00"), (9, "c", "1", "2.00"),
    ]
    items = spark.createDataFrame(
        [(i, n, Decimal(q), None if p is None else Decimal(p)) for i, n, q, p in rows],
        "invoice_id long, product_name string, quantity decimal(14,4), unit_price decimal(14,2)")
    # One fingerprint for all but the last.
    forced = duplicates.item_fingerprint(items).withColumn(
        "fingerprint", F.when(F.col("invoice_id") == 9, "other").otherwise("same"))
    for prints in (forced, None):
        groups = {}
        for r in duplicates.item_classes(items, prints).collect():
            groups.setdefault(r["fingerprint"], set()).add(r["invoice_id"])
        assert sorted(map(sorted, groups.values())) == [[1, 2], [3, 8], [4], [5], [6, 7], [9]]
    assert duplicates.item_classes(items.limit(0)).count() == 0


def test_rescore_adds_prior_levels_once(spark):
    pairs = spark.createDataFrame(
        [(1, 2, "DUPLICATE_DATE"), (3, 4, "DUPLICATE_EXACT")],
        "a_id long, b_id long, validation_type string",
    )
    stored = spark.createDataFrame(
        [(1, "DUPLICATE_DATE", 2), (2, "DUPLICATE_DATE", 1), (2, "DUPLICATE_ITEM", 1),
         (5, "DUPLICATE_EXACT", 6), (7, "DUPLICATE_EXACT", 7), (3, "TOTAL_MISMATCH", None)],
        "invoice_id long, validation_type string, match_id long",
    )
    prior = duplicates.prior_pairs(stored)
    assert {tuple(r) for r in prior.collect()} == {
        ("DUPLICATE_DATE", 1, 2), ("DUPLICATE_ITEM", 1, 2), ("DUPLICATE_EXACT", 5, 6)}
    assessed = spark.createDataFrame([(i, 60) for i in range(1, 8)], "invoice_id long, assessed_score int")
    got = {r["invoice_id"]: (float(r["risk_score"]), r["status"])
           for r in duplicates.rescore(pairs, prior, assessed).collect()}
    # 15 and 25 for the pair 1-2; 60 + 50 is capped; 5 and 6 are not matched in this scan.
    assert got == {1: (100.0, "Critical"), 2: (100.0, "Critical"), 3: (100.0, "Critical"), 4: (100.0, "Critical")}
    low = spark.createDataFrame([(i, 0) for i in range(1, 8)], "invoice_id long, assessed_score int")
    assert {r["invoice_id"]: float(r["risk_score"]) for r in duplicates.rescore(pairs, prior, low).collect()} == {
        1: 40.0, 2: 40.0, 3: 50.0, 4: 50.0}


def test_empty_input(spark):
    rows = duplicates.scan_rows(
        spark.createDataFrame([], INVOICES), spark.createDataFrame([], ITEMS)
    )
    assert duplicates.duplicate_pairs(rows).count() == 0
    assert list(duplicates.scan_summary(rows).first()) == [0, 0, 0, 0]
    assert schemas.FINDINGS.fieldNames()[0] == "invoice_id"


def test_one_short_number_leaves_the_keys_of_long_ones_alone(spark):
    rng = random.Random(8)
    numbers = ["".join(rng.choice("ABCDEFGHJK0123456789") for _ in range(40)) for _ in range(200)] + ["7"]
    cells = spark.createDataFrame(
        [(n, n, 1, 1, 1, 1, x, x.lower(), 5000) for n, x in enumerate(numbers)],
        "cell long, anchor long, n long, n_scanned long, company_id long, vendor_id long, number string, number_key string, "
        "cents long",
    )
    reached = near._reached(cells)
    blocks = near._block_stats(reached, 8, near.MAX_KEYS)
    keyed = near._keyed(near._own(cells).join(blocks, near._BLOCK), "a", near._CARRIED)
    assert keyed.groupBy(*near._BLOCK, "key").count().agg(F.max("count")).first()[0] <= 10
    similar = numbers[0][:-1] + "Z"
    more = cells.unionByName(cells.filter("cell = 0").selectExpr(
        "500L cell", "500L anchor", "n", "n_scanned", "company_id", "vendor_id", f"'{similar}' number",
        f"'{similar.lower()}' number_key", "cents"))
    found = near.near_cells(more, hot_block=8).select("a_cell", "b_cell").collect()
    assert [tuple(r) for r in found] == [(0, 500)]


def test_blank_numbers_and_unknown_companies(spark):
    invoices = random_invoices(6, 3, short_number, vendors=3, companies=1, nulls=False)
    for n, x in enumerate(invoices):
        x.update(invoice_number="", vendor_id=n, day=100 * n, cents=1000 * n + 7, items=[("p%d" % n, "1", "2")])
    rows = duplicates.scan_rows(*frames(spark, invoices))
    assert list(duplicates.pair_totals(rows).first()) == [0, 0, 0, 0, 0]
    assert duplicates.duplicate_pairs(rows).count() == 0
    for x in invoices:
        x.update(invoice_number="N-1", company_id=None)
    rows = duplicates.scan_rows(*frames(spark, invoices))
    assert found(duplicates.duplicate_pairs(rows)) == brute.all_pairs(invoices)


def test_rows_without_a_partner_leave_early(spark):
    # Own number, items and amounts: such rows take part in no layer of the counts.
    frame, items = frames(spark, [
        {"invoice_id": n, "company_id": 1, "vendor_id": 1, "invoice_number": f"N-{n}", "batch_id": 1, "day": n, "cents": 100_000 * n,
         "items": [(f"p{n}", "1", "2")]} for n in range(6)
    ])
    rows = duplicates.scan_rows(frame, items)
    assert {r["fingerprint"] for r in rows.collect()} == {None}
    marked = duplicates._with_same_number(rows)
    assert {r["same_number"] for r in marked.collect()} == {None}
    assert duplicates._layered(marked, True, duplicates._GROUP_LAYERS).count() == 0
    assert near.close_rows(rows).count() == 0
    close = rows.unionByName(rows.filter("id = 3").withColumns({"id": F.lit(9).cast("long"), "cents": F.col("cents") + 100}))
    assert sorted(r["id"] for r in near.close_rows(close).collect()) == [3, 9]


@pytest.mark.parametrize("bits", [1, 20])
def test_group_amounts_over_slices(spark, monkeypatch, bits):
    monkeypatch.setattr(duplicates, "_GROUP_SLICE_BITS", bits)
    rng = random.Random(3)
    data = [(n, rng.choice([None, 1, 2]), rng.randrange(100), rng.choice([None, 5, 6]), rng.choice([None, 7]), rng.random() < 0.6) for n in range(60)]
    rows = spark.createDataFrame(data, "id long, company_id long, cents long, same_number long, fingerprint long, scanned boolean")
    rows = rows.withColumns({"vendor_id": F.lit(None).cast("long"), "day": F.lit(None).cast("int")})
    got = {r["layer"]: (r["p"], r["a"]) for r in duplicates._group_sums(rows, True, True).groupBy("layer").agg(
        F.sum("pairs").alias("p"), F.sum("amount").alias("a")).collect()}
    counts = {r["layer"]: r["p"] for r in duplicates._group_sums(rows, True, False).groupBy("layer").agg(F.sum("pairs").alias("p")).collect()}
    for layer in duplicates._GROUP_LAYERS:
        kind, number, items = duplicates._LAYERS[layer]
        pairs = [
            (a, b) for a in data for b in data
            if a[0] < b[0] and (a[5] or b[5])
            and (a[1] == b[1] is not None if kind == "group" else a[1] is None or b[1] is None)
            and (not number or a[3] == b[3] is not None) and (not items or a[4] == b[4] is not None)
        ]
        assert got[layer] == (len(pairs), sum(a[2] for a, _ in pairs))
        assert counts[layer] == len(pairs)


def test_listing_groups_rows_with_a_partner_only(spark, monkeypatch):
    frame, items = frames(spark, [
        {"invoice_id": n, "company_id": 1, "vendor_id": 1, "invoice_number": f"N-{n}", "batch_id": 1, "day": n, "cents": 100_000 * n,
         "items": [(f"p{n}", "1", "2")]} for n in range(6)
    ])
    grouped, plain = [], duplicates._group_stats
    monkeypatch.setattr(duplicates, "_group_stats", lambda rows, keys: grouped.append(rows.count()) or plain(rows, keys))
    assert duplicates.duplicate_pairs(duplicates.scan_rows(frame, items)).count() == 0
    assert grouped and set(grouped) == {0}
