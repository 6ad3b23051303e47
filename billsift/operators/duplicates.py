"""Duplicate search at five levels.

Each level is found by its own equality join, never by one OR condition, and the
lowest level of a pair wins:

1 EXACT   same company and number          -> key (company, number)
2 VENDOR  same vendor, amount and date     -> key (vendor, amount bucket, date bucket)
3 NEAR    same vendor, similar number      -> key (vendor, amount bucket), see ``near``
4 DATE    same vendor, amount, <= 3 days   -> as level 2
5 ITEM    same company and line items      -> key (company, item fingerprint)

Three ways to use the relation:

* ``duplicate_pairs`` lists every pair, for groups of any size; the members of a large
  group are dealt to many tasks.
* ``pair_measures`` keeps the relation in factors: groups and pairs of cells with their
  sizes. Counts come from the sizes, the amount of the lower id from ranks inside a
  group, both in linear space.
* ``scan_scores`` charges penalties from lists only where an invoice has few partners;
  a handful of partners reaches the cap of 100 whatever their levels.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billsift.functions import money, similarity, text
from billsift.operators import near, rules
from billsift.session import cut_lineage

# Level -> code, severity, confidence, penalty.
LEVELS = {
    1: ("DUPLICATE_EXACT", "CRITICAL", 100, 50),
    2: ("DUPLICATE_VENDOR", "CRITICAL", 98, 40),
    3: ("DUPLICATE_NEAR", "ERROR", 95, 30),
    4: ("DUPLICATE_DATE", "WARNING", 85, 15),
    5: ("DUPLICATE_ITEM", "ERROR", 92, 25),
}
AMOUNT_TOLERANCE = Decimal("0.01")
NEAR_AMOUNT_TOLERANCE = Decimal("1.00")
DATE_WINDOW_DAYS = 3

# So many partners reach the score cap at any level.
SATURATING_PARTNERS = -(-100 // min(level[3] for level in LEVELS.values()))
#: Members of a group that one task meets with the others of the group.
MEMBERS_PER_TASK = 512

# Bucket widths: a row reaches at most two buckets in each direction.
_CENT_BUCKET = 5
_DAY_BUCKET = 7


# -- pair predicates ---------------------------------------------------------


def amounts_equal(a: Column, b: Column, tolerance: Decimal = AMOUNT_TOLERANCE) -> Column:
    return F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))


def amounts_near(a: Column, b: Column) -> Column:
    return amounts_equal(a, b, NEAR_AMOUNT_TOLERANCE)


def dates_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def dates_close(a: Column, b: Column, days: int = DATE_WINDOW_DAYS) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def same_company(a: Column, b: Column) -> Column:
    """Equal, or unknown on either side."""
    return F.coalesce(a == b, F.lit(True))


def same_vendor(a_vendor: Column, b_vendor: Column, a_company: Column, b_company: Column) -> Column:
    return F.coalesce(a_vendor == b_vendor, F.lit(False)) & same_company(a_company, b_company)


def number_key(col: Column) -> Column:
    return F.lower(text.clean(col))


def same_number(a: Column, b: Column) -> Column:
    return (number_key(a) != "") & (number_key(a) == number_key(b))


def with_level(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add the level of rows that carry both invoices under the prefixes ``a`` and ``b``.

    First match wins; null when the invoices are not duplicates.
    """

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"{a}{name}"), F.col(f"{b}{name}")

    company = same_company(*both("company_id"))
    vendor = same_vendor(*both("vendor_id"), *both("company_id"))
    amount = amounts_equal(*both("total_amount"))
    similar = F.col("_similarity") >= similarity.NEAR_THRESHOLD
    items = F.coalesce(F.equal_null(*both("fingerprint")) & F.col(f"{a}fingerprint").isNotNull(), F.lit(False))
    level = (
        F.when(same_number(*both("invoice_number")) & company, 1)
        .when(vendor & amount & dates_equal(*both("invoice_date")), 2)
        .when(vendor & amounts_near(*both("total_amount")) & similar, 3)
        .when(vendor & amount & dates_close(*both("invoice_date")), 4)
        .when(company & items, 5)
    )
    trimmed = df.withColumns(
        {"_a_number": text.clean(F.col(f"{a}invoice_number")), "_b_number": text.clean(F.col(f"{b}invoice_number"))}
    )
    return (
        similarity.with_number_similarity(trimmed, "_a_number", "_b_number", "_similarity")
        .withColumn("level", level)
        .withColumn("similarity", F.when(F.col("level") == 3, F.col("_similarity")))
        .drop("_a_number", "_b_number", "_similarity")
    )


# -- inputs ------------------------------------------------------------------


_LINE = ["name", "quantity", "price"]


def _compared_lines(items: DataFrame) -> DataFrame:
    """invoice_id and the parts of its lines that the item comparison sees."""
    zero = F.lit(0)
    return items.select(
        "invoice_id",
        text.casefold(text.product_or_default(F.col("product_name"))).alias("name"),
        F.round(F.coalesce(F.col("quantity"), zero), 3).cast("decimal(18,3)").alias("quantity"),
        F.round(F.coalesce(F.col("unit_price"), zero), 2).cast("decimal(18,2)").alias("price"),
    )


def item_fingerprint(items: DataFrame) -> DataFrame:
    """Order-free fingerprint of the lines of each invoice, from sums that combine
    before the shuffle.

    A line is its casefolded name, quantity and price; the fingerprint is a hash of the number
    of lines and of the sums of the two halves of a 64-bit hash of each. Invoices
    without lines have none. Equal lists have equal fingerprints; ``item_classes`` gives the converse.
    """
    hashed = _compared_lines(items).select("invoice_id", F.xxhash64(*_LINE).alias("h"))
    low = F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    high = F.sum(F.shiftrightunsigned("h", 32))
    return hashed.groupBy("invoice_id").agg(F.xxhash64(F.count(F.lit(1)), low, high).alias("fingerprint"))


def item_classes(items: DataFrame, prints: DataFrame | None = None, lone: bool = True) -> DataFrame:
    """invoice_id and fingerprint, where equal fingerprints mean equal lists of items: the lowest invoice of the class.

    Only invoices that share a fingerprint are looked at: their lines are joined with those of the first
    invoice of the group, line by line, so that a group costs its own lines however large it is. What
    differs from the first one forms a group again, until nothing is left; without a
    collision of fingerprints that is one round. ``prints`` may hold other fingerprints, which equal lists must share.
    Without ``lone``, invoices that share their fingerprint with none are left out.
    """
    prints = cut_lineage(item_fingerprint(items) if prints is None else prints)
    groups = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("invoice_id").alias("first_id"))
    # A table of its own: where few invoices share a fingerprint, its size lets their lines be picked without a shuffle.
    rest = cut_lineage(prints.join(groups.filter("n > 1"), "fingerprint").select("invoice_id", "first_id"))
    classes = groups.filter("n = 1").select(F.col("first_id").alias("invoice_id"), F.col("first_id").alias("fingerprint"))
    if not lone:
        classes = classes.limit(0)
    rows = lines = cut_lineage(
        _compared_lines(items).join(rest, "invoice_id")
        .groupBy("invoice_id", "first_id", *_LINE).agg(F.count(F.lit(1)).alias("times"))
    )
    while True:
        first = rows.filter(F.col("invoice_id") == F.col("first_id"))
        counterpart = first.select(
            F.col("first_id").alias("of"), *[F.col(c).alias(f"first_{c}") for c in (*_LINE, "times")]
        )
        same_line = (rows["first_id"] == counterpart["of"]) & (rows["times"] == counterpart["first_times"])
        for part in _LINE:
            same_line &= rows[part].eqNullSafe(counterpart[f"first_{part}"])
        compared = (
            rows.join(counterpart, same_line, "left")
            .groupBy("invoice_id", "first_id")
            .agg(F.count(F.lit(1)).alias("own"), F.count("of").alias("shared"))
        )
        wanted = first.groupBy("first_id").agg(F.count(F.lit(1)).alias("wanted"))
        compared = cut_lineage(
            compared.join(wanted, "first_id")
            .withColumn("equal", (F.col("own") == F.col("shared")) & (F.col("own") == F.col("wanted")))
        )
        classes = classes.unionByName(compared.filter("equal").select("invoice_id", F.col("first_id").alias("fingerprint")))
        others = compared.filter("not equal")
        if others.isEmpty():
            return classes
        rest = others.join(
            others.groupBy("first_id").agg(F.min("invoice_id").alias("next_id")), "first_id"
        ).select("invoice_id", F.col("next_id").alias("first_id"))
        rows = lines.drop("first_id").join(rest, "invoice_id")


def scan_rows(invoices: DataFrame, items: DataFrame, batch_ids: list[int] | None = None) -> DataFrame:
    """The columns the search compares, and whether the row belongs to the scanned batches.

    Without batch ids every invoice is scanned. With them, rows of other tenants are
    left out, unless the batches name no tenant at all.
    """
    rows = invoices
    if batch_ids is None:
        rows = rows.withColumn("scanned", F.lit(True))
    else:
        scanned = F.coalesce(F.col("batch_id").isin(list(batch_ids)), F.lit(False))
        rows = rows.withColumn("scanned", scanned)
        rows = tenant_rows(rows)
    # Items that no other invoice has match nothing.
    rows = rows.join(item_classes(items, lone=False), "invoice_id", "left")
    narrow = rows.select(
        F.col("invoice_id").alias("id"),
        "company_id",
        "vendor_id",
        text.clean(F.col("invoice_number")).alias("number"),
        number_key(F.col("invoice_number")).alias("number_key"),
        money.cents(F.col("total_amount")).alias("cents"),
        F.unix_date("invoice_date").alias("day"),
        "fingerprint",
        "scanned",
    )
    # Every level reads these rows again, each with its own columns.
    return cut_lineage(narrow)


def tenant_rows(rows: DataFrame) -> DataFrame:
    """Scanned rows, and the other rows of the companies they belong to."""
    tenants = (
        rows.filter(F.col("scanned") & F.col("company_id").isNotNull())
        .select("company_id").distinct()
        .withColumn("is_tenant", F.lit(True))
    )
    tenant_count = tenants.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = rows.join(tenants, "company_id", "left")
    keep = F.col("scanned") | F.col("is_tenant").isNotNull() | (tenant_count == 0)
    return joined.filter(keep).drop("is_tenant")


# -- listing -----------------------------------------------------------------


def _group_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size, scanned size, first member and anchor of each group.

    The anchor is scanned when any member is, so it pairs with every member.
    """
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("scanned").alias("n_scanned"),
        F.min("id").alias("cell"),
        F.coalesce(F.min(F.when(F.col("scanned"), F.col("id"))), F.min("id")).alias("anchor"),
    )


def _attach(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the numbers of their group; a null key matches a null key."""
    numbers = [c for c in stats.columns if c not in keys]
    side = stats.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *numbers)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return rows.join(side, condition).drop(*[f"_key_{k}" for k in keys])


def _pair_columns(x: Column, y: Column, level: Column, saturated: Column) -> list[Column]:
    return [
        F.least(x, y).alias("a_id"),
        F.greatest(x, y).alias("b_id"),
        level.cast("int").alias("level"),
        saturated.alias("saturated"),
    ]


def _more(size: Column, most: int | None) -> Column:
    """Whether a side is too large to be listed; without a limit none is."""
    return F.lit(False) if most is None else size > most


def _tasks(size: Column) -> Column:
    return F.ceil(size / MEMBERS_PER_TASK).cast("int")


def _dealt(member: Column, tasks: Column) -> Column:
    return F.pmod(F.xxhash64(member), tasks)


def _all_tasks(tasks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), tasks - 1)).alias("part")


def _side_pairs(live: DataFrame, x: Column, y: Column, n_x: Column, n_y: Column, level: int,
                most: int | None) -> DataFrame:
    """Pairs of a member of side x and one of side y, per group ``cell``; side x lies in side y or beside it.

    With a limit, groups in which both sides are larger give one row per member and an anchor instead:
    all their members reach the cap.
    """
    large = _more(F.least(n_x, n_y), most)
    tasks = _tasks(n_x)
    flagged = live.withColumns({"in_x": x, "in_y": y, "large": large, "tasks": tasks})
    small = flagged.filter(~F.col("large") & (F.col("tasks") > 0))
    xs = small.filter("in_x").select("cell", F.col("id").alias("x"), _dealt(F.col("id"), F.col("tasks")).alias("part"))
    ys = small.filter("in_y").select("cell", F.col("id").alias("y"), "in_x", _all_tasks(F.col("tasks")))
    once = (F.col("x") < F.col("y")) | (~F.col("in_x") & (F.col("x") != F.col("y")))
    listed = xs.join(ys, ["cell", "part"]).filter(once).select(
        *_pair_columns(F.col("x"), F.col("y"), F.lit(level), F.lit(False))
    )
    if most is None:
        return listed
    big = flagged.filter("large and (in_x or in_y)")
    anchors = big.groupBy("cell").agg(
        F.min(F.when(F.col("in_x"), F.col("id"))).alias("x_anchor"),
        F.min(F.when(F.col("in_y"), F.col("id"))).alias("y_anchor"),
    )
    partner = F.when(F.col("in_y"), F.col("x_anchor")).otherwise(F.col("y_anchor"))
    star = big.join(anchors, "cell").filter(F.col("id") != partner)
    return listed.unionByName(star.select(*_pair_columns(F.col("id"), partner, F.lit(level), F.lit(True))))


def _same_cell_pairs(rows: DataFrame, cells: DataFrame, keys: list[str], level: int,
                     most: int | None) -> DataFrame:
    """Pairs with a scanned side among the rows of a cell."""
    stats = cells.filter((F.col("n") > 1) & (F.col("n_scanned") > 0))
    live = _attach(rows.select("id", "scanned", *keys), stats, keys)
    return _side_pairs(live, F.col("scanned"), F.lit(True), F.col("n_scanned"), F.col("n"), level, most)


def _pairs_in_groups(rows: DataFrame, keys: list[str], level: int, most: int | None) -> DataFrame:
    """Pairs among rows equal on ``keys``, none of them null."""
    known = rows.dropna(subset=keys)
    return _same_cell_pairs(known, _group_stats(known, keys), keys, level, most)


_BAND_CELL = ["company_id", "vendor_id", "cents", "day"]


def _neighbour_buckets(value: Column, reach: int, width: int) -> Column:
    first = F.floor((value - reach) / width)
    last = F.floor((value + reach) / width)
    return F.array_distinct(F.array(first, last))


def _band_cells(rows: DataFrame, extra: list[str]) -> DataFrame:
    known = rows.filter(
        F.col("vendor_id").isNotNull() & F.col("cents").isNotNull() & F.col("day").isNotNull()
    )
    return _group_stats(known, _BAND_CELL + extra)


def _adjacent_cells(cells: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs of different cells within one cent and three days of each other.

    A cell meets a bounded number of others, however many rows it holds.
    """
    prefixed = ["cell", "anchor", "n", "n_scanned", "company_id", "cents", "day"]
    own = cells.select(
        "vendor_id", *extra,
        F.floor(F.col("cents") / _CENT_BUCKET).alias("cent_bucket"),
        F.floor(F.col("day") / _DAY_BUCKET).alias("day_bucket"),
        *[F.col(c).alias(f"a_{c}") for c in prefixed],
    )
    reached = cells.select(
        "vendor_id", *extra,
        F.explode(_neighbour_buckets(F.col("cents"), 1, _CENT_BUCKET)).alias("cent_bucket"),
        *[F.col(c).alias(f"b_{c}") for c in prefixed],
    ).withColumn(
        "day_bucket",
        F.explode(_neighbour_buckets(F.col("b_day"), DATE_WINDOW_DAYS, _DAY_BUCKET)),
    )
    keys = ["vendor_id", *extra, "cent_bucket", "day_bucket"]
    within = (
        (F.col("a_cell") < F.col("b_cell"))
        & (F.abs(F.col("a_cents") - F.col("b_cents")) <= 1)
        & (F.abs(F.col("a_day") - F.col("b_day")) <= DATE_WINDOW_DAYS)
        & (F.col("a_n_scanned") + F.col("b_n_scanned") > 0)
        & same_company(F.col("a_company_id"), F.col("b_company_id"))
    )
    return own.join(reached, keys).filter(within).withColumn(
        "level", F.when(F.col("a_day") == F.col("b_day"), 2).otherwise(4)
    )


def _expand_cells(cell_pairs: DataFrame, rows: DataFrame, cell_keys: list[str],
                  stats: DataFrame, most: int | None) -> DataFrame:
    """Member pairs of adjacent cells.

    Single-member cells need no lookup. With a limit a larger cell is represented by its anchor: its own
    members reach the cap inside it.
    """
    a_large, b_large = _more(F.col("a_n_scanned"), most), _more(F.col("b_n_scanned"), most)
    sized = cell_pairs.withColumns({
        "saturated": a_large | b_large,
        "a_whole": a_large | (F.col("a_n") == 1),
        "b_whole": b_large | (F.col("b_n") == 1),
    })
    direct = sized.filter("a_whole and b_whole")
    lookup = sized.filter("not (a_whole and b_whole)")
    wanted = stats.filter((F.col("n") > 1) & ~_more(F.col("n_scanned"), most))
    members = _attach(rows.select("id", "scanned", *cell_keys), wanted.select(*cell_keys, "cell", "n"), cell_keys)
    a_members = members.select(F.col("cell").alias("a_cell"), F.col("id").alias("x"), "scanned")
    b_members = members.select(
        F.col("cell").alias("b_cell"), F.col("id").alias("y"), "scanned",
        _dealt(F.col("id"), _tasks(F.col("n"))).alias("part"),
    )
    b_tasks = F.when(F.col("b_whole"), 1).otherwise(_tasks(F.col("b_n")))
    dealt = lookup.select("*", _all_tasks(b_tasks))

    def meet(a_scanned: bool, b_side: DataFrame, b_anchor: Column) -> DataFrame:
        a_side = a_members.filter(F.col("scanned") == a_scanned).drop("scanned")
        a_anchor = F.col("a_whole") & ((F.col("a_n_scanned") > 0) == a_scanned)
        return (
            dealt.join(a_side, "a_cell", "left").filter(F.col("x").isNotNull() | a_anchor)
            .join(b_side.drop("scanned"), ["b_cell", "part"], "left").filter(F.col("y").isNotNull() | b_anchor)
        )

    # Scanned with anything, and the rest with scanned only: unscanned rows never meet each other.
    expanded = meet(True, b_members, F.col("b_whole")).unionByName(
        meet(False, b_members.filter("scanned"), F.col("b_whole") & (F.col("b_n_scanned") > 0))
    )
    level, saturated = F.col("level"), F.col("saturated")
    return direct.select(
        *_pair_columns(F.col("a_anchor"), F.col("b_anchor"), level, saturated)
    ).unionByName(
        expanded.select(
            *_pair_columns(
                F.coalesce(F.col("x"), F.col("a_anchor")),
                F.coalesce(F.col("y"), F.col("b_anchor")),
                level,
                saturated,
            )
        )
    )


def _band_pairs(rows: DataFrame, most: int | None) -> DataFrame:
    """Levels 2 and 4."""
    known = rows.filter(
        F.col("vendor_id").isNotNull() & F.col("cents").isNotNull() & F.col("day").isNotNull()
    )
    cells = _band_cells(rows, [])
    across = _expand_cells(_adjacent_cells(cells, []), known, _BAND_CELL, cells, most)
    return _same_cell_pairs(known, cells, _BAND_CELL, 2, most).unionByName(across)


_NEAR_CELL = ["company_id", "vendor_id", "number", "number_key", "cents"]


def _near_pairs(rows: DataFrame, most: int | None) -> DataFrame:
    """Level 3."""
    known = rows.filter(F.col("vendor_id").isNotNull() & F.col("cents").isNotNull())
    cells = _group_stats(known, _NEAR_CELL)
    matched = near.near_cells(cells).withColumn("level", F.lit(3))
    across = _expand_cells(matched, known, _NEAR_CELL, cells, most)
    # Rows of one cell share the number: level 1 unless the number is blank.
    blank = cells.filter(F.col("number") == "")
    inside = _same_cell_pairs(known.filter(F.col("number") == ""), blank, _NEAR_CELL, 3, most)
    return across.unionByName(inside)


def _unknown_company(rows: DataFrame, keys: list[str], level: int, most: int | None) -> DataFrame:
    """Pairs in which at least one side has no company: the company is then not compared."""
    unknown, scanned = F.col("unknown"), F.col("scanned")
    flagged = rows.withColumn("unknown", F.col("company_id").isNull())
    stats = (
        flagged.groupBy(*keys)
        .agg(
            F.min("id").alias("cell"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(unknown & scanned).alias("n_asking"),
            F.count_if(unknown & ~scanned).alias("n_old_unknown"),
            F.count_if(~unknown & scanned).alias("n_new_known"),
        )
        .filter((F.col("n_asking") + F.col("n_old_unknown") > 0) & (F.col("n_asking") + F.col("n_new_known") > 0))
    )
    live = flagged.select("id", "scanned", "unknown", *keys).join(stats, keys)
    # Scanned rows without a company meet all; others without one meet scanned rows that have one.
    return _side_pairs(
        live, unknown & scanned, F.lit(True), F.col("n_asking"), F.col("n"), level, most
    ).unionByName(
        _side_pairs(
            live, unknown & ~scanned, ~unknown & scanned, F.col("n_old_unknown"), F.col("n_new_known"), level, most
        )
    )


def _matches(rows: DataFrame, most: int | None) -> DataFrame:
    """Pairs with the lowest level at which they match; with a limit, large groups as stars."""
    # Only rows that can have a partner: see ``_sums``.
    numbered = cut_lineage(_with_same_number(rows).filter(F.col("same_number").isNotNull()).select("id", "company_id", "same_number", "scanned"))
    itemised = rows.filter(F.col("fingerprint").isNotNull())
    close = cut_lineage(near.close_rows(rows))
    found = (
        _pairs_in_groups(numbered, ["company_id", "same_number"], 1, most)
        .unionByName(_band_pairs(close, most))
        .unionByName(_near_pairs(close, most))
        .unionByName(_pairs_in_groups(itemised, ["company_id", "fingerprint"], 5, most))
    )
    if _some_unknown(rows):
        found = found.unionByName(_unknown_company(numbered, ["same_number"], 1, most)).unionByName(
            _unknown_company(itemised, ["fingerprint"], 5, most)
        )
    return found.groupBy("a_id", "b_id").agg(F.min("level").alias("level"), F.max("saturated").alias("saturated"))


def _some_unknown(rows: DataFrame) -> bool:
    return not rows.filter(F.col("company_id").isNull()).isEmpty()


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """Every pair (a_id < b_id) with its level and, for NEAR, the similarity.

    An unknown company matches any. A group of n equal invoices gives n (n - 1) / 2 rows; use
    ``pair_measures`` and ``scan_scores`` for what needs no list.
    """
    best = cut_lineage(_matches(rows, None).select("a_id", "b_id", "level"))
    # Only near pairs show their similarity.
    compared = best.filter("level = 3")
    for side in ("a", "b"):
        compared = compared.join(
            rows.select(F.col("id").alias(f"{side}_id"), F.col("number").alias(f"{side}_number")), f"{side}_id"
        )
    compared = similarity.with_number_similarity(compared, "a_number", "b_number").drop("a_number", "b_number")
    rest = best.filter("level <> 3").withColumn("similarity", F.lit(None).cast(compared.schema["similarity"].dataType))
    return compared.unionByName(rest).select(
        "a_id",
        "b_id",
        "level",
        "similarity",
        _by_level(0).alias("validation_type"),
        _by_level(1).alias("severity"),
        _by_level(2).alias("confidence"),
        _by_level(3).alias("penalty"),
    )


def _by_level(position: int) -> Column:
    out = F.lit(None)
    for level, values in LEVELS.items():
        out = F.when(F.col("level") == level, F.lit(values[position])).otherwise(out)
    return out


def penalty_of(validation_type: Column) -> Column:
    out = F.lit(0)
    for code, _, _, penalty in LEVELS.values():
        out = F.when(validation_type == code, penalty).otherwise(out)
    return out


# -- measuring without listing -----------------------------------------------

_WIDE = "decimal(38,0)"
#: Ids of one slice: ranks inside a group are counted per slice, then inside it.
_SLICE_BITS = 16
#: The same for whole groups: most lie in few slices then, and a slice still fits a task.
_GROUP_SLICE_BITS = 20


def _pairs_of(n: Column, scanned: Column) -> Column:
    """Pairs inside a group that have a scanned side."""
    n, scanned = n.cast("decimal(18,0)"), scanned.cast("decimal(18,0)")
    return (scanned * (n - scanned) + F.floor(scanned * (scanned - 1) / 2)).cast(_WIDE)


def _pairs_between(a_n: Column, a_scanned: Column, b_n: Column, b_scanned: Column) -> Column:
    a_n, a_old, b_n, b_old = (
        c.cast("decimal(18,0)") for c in (a_n, a_n - a_scanned, b_n, b_n - b_scanned)
    )
    return (a_n * b_n - a_old * b_old).cast(_WIDE)


def _later(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, per name, the sum over the rows of the group with a higher id.

    Two levels: whole slices of ids, then the rows of a slice, so no task sorts a whole large group.
    """
    rows = rows.withColumns({"slice": F.shiftright("id", _SLICE_BITS), **{f"_{k}": v for k, v in sums.items()}})
    slices = rows.groupBy(*keys, "slice").agg(*[F.sum(f"_{k}").alias(f"_s_{k}") for k in sums])
    beyond = Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "slice", *[F.coalesce(F.sum(f"_s_{k}").over(beyond), F.lit(0)).alias(f"_s_{k}") for k in sums])
    within = Window.partitionBy(*keys, "slice").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(slices, [*keys, "slice"])
    return joined.withColumns(
        {k: F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) + F.col(f"_s_{k}") for k in sums}
    ).drop("slice", *[f"_{k}" for k in sums], *[f"_s_{k}" for k in sums])


def _one(condition: Column) -> Column:
    return condition.cast("bigint")


# Layers of the roll-up: name -> (kind, uses the number, uses the items). Kinds: rows of a vendor, amount and day
# (band), rows of a company (group), rows of any company (any).
_LAYERS = {
    0: ("band", False, False), 1: ("band", True, False), 2: ("band", False, True), 3: ("band", True, True),
    4: ("group", True, False), 5: ("group", False, True), 6: ("group", True, True),
    7: ("any", True, False), 8: ("any", False, True), 9: ("any", True, True),
}
_LAYER_KEYS = ["layer", "company_id", "vendor_id", "cents", "day", "same_number", "fingerprint"]
_BAND_LAYERS, _GROUP_LAYERS = [0, 1, 2, 3], [4, 5, 6, 7, 8, 9]
_GROUP_KEYS = ["layer", "company_id", "same_number", "fingerprint"]
_FINEST = [*_BAND_CELL, "number", "number_key", "same_number", "fingerprint"]


def _layered(rows: DataFrame, unknown: bool, layers: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per layer it takes part in, with the keys of that layer; numbers and items it does not use are zero."""
    chosen = []
    for layer in layers:
        kind, number, items = _LAYERS[layer]
        if kind == "any" and not unknown:
            continue
        takes_part = F.lit(True)
        if kind == "band":
            takes_part = F.col("vendor_id").isNotNull() & F.col("cents").isNotNull() & F.col("day").isNotNull()
        if kind == "group":
            takes_part = F.col("company_id").isNotNull()
        if number:
            takes_part = takes_part & F.col("same_number").isNotNull()
        if items:
            takes_part = takes_part & F.col("fingerprint").isNotNull()

        def key(name: str, used: bool, unused: Column = F.lit(None)) -> Column:
            return (F.col(name) if used else unused.cast(rows.schema[name].dataType)).alias(name)

        chosen.append(F.when(takes_part, F.struct(
            F.lit(layer).alias("layer"),
            key("company_id", kind != "any"),
            *[key(c, kind == "band") for c in ("vendor_id", "cents", "day")],
            key("same_number", number, F.lit(0)),
            key("fingerprint", items, F.lit(0)),
        )))
    rest = [F.col(c) for c in keep]
    return rows.select(*rest, F.explode(F.array_compact(F.array(*chosen))).alias("k")).select(*keep, "k.*")


def _rolled_up(cells: DataFrame) -> DataFrame:
    """All groups of the band layers from one shuffle of the finest cells."""
    rows = _layered(cells, False, _BAND_LAYERS, keep=("n", "n_scanned", "cell"))
    return rows.groupBy(*_LAYER_KEYS).agg(
        F.sum("n").alias("n"),
        F.sum("n_scanned").alias("n_scanned"),
        F.min("cell").alias("cell"),
        F.min("cell").alias("anchor"),
    )


def _with_same_number(rows: DataFrame) -> DataFrame:
    """Adds ``same_number``, the lowest id with this number; null where it is blank or no other row has it."""
    numbers = rows.filter(F.col("number_key") != "").groupBy("number_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("same_number")
    )
    return rows.join(numbers.filter("_n > 1").drop("_n"), "number_key", "left")


def _group_sums(rows: DataFrame, unknown: bool, amounts: bool) -> DataFrame:
    """layer, pairs, amount (of the lower ids) per group of the layers that compare numbers and items.

    Every row counts its partners with higher ids: inside a slice of ids by a window, those of later slices
    from the sizes of the slices, so no task sorts a whole large group.
    """
    scanned, nameless = F.col("scanned"), F.col("nameless")
    live = rows.filter("same_number is not null or fingerprint is not null").withColumns({
        "nameless": F.col("company_id").isNull(),
        "value": F.abs(F.coalesce(F.col("cents"), F.lit(0))).cast("bigint"),
    })
    sizes = {"n": F.lit(True), "n_scanned": scanned, "u": nameless, "u_scanned": nameless & scanned}
    counted = [F.count_if(condition).alias(name) for name, condition in sizes.items()]
    if not amounts:
        held = _layered(live, unknown, _GROUP_LAYERS, ("scanned", "nameless"))
        return held.groupBy(*_GROUP_KEYS).agg(*counted).select(
            "layer", _group_pairs().alias("pairs"), F.lit(0).cast(_WIDE).alias("amount")
        )
    held = _layered(live, unknown, _GROUP_LAYERS, ("id", "scanned", "nameless", "value")).select(
        *_GROUP_KEYS, "id", "scanned", "nameless", "value", F.shiftright("id", _GROUP_SLICE_BITS).alias("slice")
    )
    other = (F.col("layer") >= 7) & ~nameless
    partners = F.when(other, F.when(scanned, "u").otherwise("u_scanned")).otherwise(
        F.when(scanned, "n").otherwise("n_scanned")
    )
    within = Window.partitionBy(*_GROUP_KEYS, "slice").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("partners", partners).withColumns(
        {f"later_{name}": F.coalesce(F.sum(_one(condition)).over(within), F.lit(0)) for name, condition in sizes.items()}
    )
    later = F.lit(0).cast("bigint")
    for name in sizes:
        later = F.when(F.col("partners") == name, F.col(f"later_{name}")).otherwise(later)
    slices = ranked.groupBy(*_GROUP_KEYS, "slice").agg(
        *counted,
        F.sum((later * F.col("value")).cast("decimal(28,0)")).cast(_WIDE).alias("amount"),
        *[F.coalesce(F.sum(F.when(F.col("partners") == name, F.col("value"))), F.lit(0)).alias(f"value_{name}") for name in sizes],
    )
    beyond = Window.partitionBy(*_GROUP_KEYS).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    across = F.lit(0).cast(_WIDE)
    for name in sizes:
        across = (across + (
            F.coalesce(F.sum(name).over(beyond), F.lit(0)).cast("decimal(18,0)") * F.col(f"value_{name}").cast("decimal(19,0)")
        ).cast(_WIDE)).cast(_WIDE)
    return slices.withColumn("across", across).groupBy(*_GROUP_KEYS).agg(
        *[F.sum(name).alias(name) for name in sizes], F.sum(F.col("amount") + F.col("across")).cast(_WIDE).alias("amount")
    ).select("layer", _group_pairs().alias("pairs"), "amount")


def _group_pairs() -> Column:
    """Pairs inside a group; where companies differ, only those with an unknown one."""
    every = _pairs_of(F.col("n"), F.col("n_scanned"))
    known = _pairs_of(F.col("n") - F.col("u"), F.col("n_scanned") - F.col("u_scanned"))
    return F.when(F.col("layer") >= 7, every - known).otherwise(every)


def _lower_in_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """layer, a_cell, b_cell, lower_a: member pairs whose lower id lies in cell a."""
    keys = ["layer", "a_cell", "b_cell"]

    def side(name: str) -> DataFrame:
        of_side = members.withColumnRenamed("cell", f"{name}_cell")
        return pairs.select(*keys).join(of_side, ["layer", f"{name}_cell"]).withColumn("side", F.lit(name))

    both = side("a").unionByName(side("b"))
    in_b = F.col("side") == "b"
    counted = _later(both, keys, {"after": _one(in_b), "after_scanned": _one(in_b & F.col("scanned"))})
    lower = F.when(F.col("scanned"), F.col("after")).otherwise(F.col("after_scanned"))
    return counted.filter("side = 'a'").groupBy(*keys).agg(F.sum(lower).cast(_WIDE).alias("lower_a"))


def _with_amounts(matched: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the amount of the lower id, summed over the member pairs of each pair of cells."""
    a, b = F.abs(F.col("a_cents")), F.abs(F.col("b_cents"))
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    # The members of one-row cells are the cells themselves, and cell a is the lower one.
    easy = matched.filter(single | (a == b)).withColumn("amount", F.col("pairs") * a)
    hard = matched.filter(~single & (a != b))
    lower = _lower_in_pairs(hard, members)
    split = hard.join(lower, ["layer", "a_cell", "b_cell"], "left").withColumn("lower_a", F.coalesce("lower_a", F.lit(0)))
    amount = F.col("lower_a") * a + (F.col("pairs") - F.col("lower_a")) * b
    return easy.unionByName(split.withColumn("amount", amount).drop("lower_a"))


def _near_matches(cells: DataFrame) -> DataFrame:
    known = cells.filter(F.col("vendor_id").isNotNull() & F.col("cents").isNotNull())
    matched = near.near_cells(known.withColumn("anchor", F.col("cell")), ["day", "fingerprint"])
    return matched.withColumns({
        "layer": F.lit(-1),
        "pairs": _pairs_between(*(F.col(c) for c in ("a_n", "a_n_scanned", "b_n", "b_n_scanned"))),
    })


def _sums(rows: DataFrame, amounts: bool) -> DataFrame:
    """One row: per part of the lattice the number of pairs and, if asked, the amount of their lower ids."""
    unknown = _some_unknown(rows)
    rows = cut_lineage(_with_same_number(rows))
    # Bands and near numbers: only rows of a vendor that bills a similar amount once more.
    close = cut_lineage(near.close_rows(rows))
    cells = cut_lineage(_group_stats(close, _FINEST).drop("anchor"))
    bands = cut_lineage(_rolled_up(cells))
    nothing = F.lit(0).cast(_WIDE)
    cents = F.abs(F.coalesce(F.col("cents"), F.lit(0)))

    inside = bands.filter("n > 1 and n_scanned > 0").withColumn("pairs", _pairs_of(F.col("n"), F.col("n_scanned")))
    across = _adjacent_cells(bands, ["layer", "same_number", "fingerprint"]).withColumn(
        "pairs", _pairs_between(*(F.col(c) for c in ("a_n", "a_n_scanned", "b_n", "b_n_scanned")))
    )
    near_pairs = _near_matches(cells)
    # Blank numbers of one cell are equal to each other; with a day the band has them already.
    blank = cells.filter(
        "number = '' and day is null and vendor_id is not null and cents is not null and n > 1 and n_scanned > 0"
    ).withColumn("pairs", _pairs_of(F.col("n"), F.col("n_scanned")))
    if amounts:
        hard = across.filter("(a_n > 1 or b_n > 1) and a_cents <> b_cents")
        wanted = hard.select("layer", F.explode(F.array("a_cell", "b_cell")).alias("cell")).distinct()
        keyed = bands.select(*_LAYER_KEYS, "cell").join(wanted, ["layer", "cell"], "left_semi")
        members = _attach(_layered(close, False, _BAND_LAYERS, ("id", "scanned")), keyed, _LAYER_KEYS)
        across = _with_amounts(across, members.select("layer", "cell", "id", "scanned"))
        finest = _attach(close.select("id", "scanned", *_FINEST), cells.select(*_FINEST, "cell"), _FINEST)
        near_pairs = _with_amounts(near_pairs, finest.select(F.lit(-1).alias("layer"), "cell", "id", "scanned"))
        blank_amount = F.col("pairs") * cents
        inside_amount = F.col("pairs") * cents
    else:
        across, near_pairs = (x.withColumn("amount", nothing) for x in (across, near_pairs))
        blank_amount = inside_amount = nothing

    same_day = F.col("level") == 2
    parts = inside.select("layer", F.lit(True).alias("same_day"), "pairs", inside_amount.cast(_WIDE).alias("amount"))
    parts = parts.unionByName(across.select("layer", same_day.alias("same_day"), "pairs", F.col("amount").cast(_WIDE)))
    parts = parts.unionByName(_group_sums(rows, unknown, amounts).withColumn("same_day", F.lit(True)))

    gap = F.abs(F.col("a_cents") - F.col("b_cents")) <= 1
    days = F.abs(F.col("a_day") - F.col("b_day"))
    on_day = F.coalesce(gap & (days == 0), F.lit(False))
    in_window = F.coalesce(gap & (days <= DATE_WINDOW_DAYS), F.lit(False))
    same_items = F.coalesce(F.col("a_fingerprint") == F.col("b_fingerprint"), F.lit(False))
    # Layers of the near pairs: all that are no band pair of one day; of these those in the window, or with equal items.
    flags = near_pairs.filter(~on_day).select(
        F.when(in_window, -2).when(same_items, -3).otherwise(-1).alias("layer"),
        F.lit(True).alias("same_day"), "pairs", F.col("amount").cast(_WIDE),
    )
    flags = flags.unionByName(blank.select(
        F.when(F.col("fingerprint").isNotNull(), -3).otherwise(-1).alias("layer"),
        F.lit(True).alias("same_day"), "pairs", blank_amount.cast(_WIDE).alias("amount"),
    ))
    parts = parts.unionByName(flags)

    def total(column: str, condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), nothing).alias(f"{column}_{name}")

    layer = F.col("layer")
    picked = []
    for column in ("pairs", "amount"):
        picked += [total(column, layer == n, f"w{n}") for n in range(4)]
        picked += [total(column, (layer == n) & F.col("same_day"), f"d{n}") for n in range(2)]
        picked += [total(column, (layer == n) | (layer == n + 3), f"g{n}") for n in (4, 5, 6)]
        picked += [total(column, layer < 0, "near"), total(column, layer == -2, "near_window"),
                   total(column, layer == -3, "near_items")]
    return parts.agg(*picked)


def _by_levels(column: str) -> list[Column]:
    """Inclusion and exclusion: what a level matches less what a higher one has taken."""

    def c(name: str) -> Column:
        return F.col(f"{column}_{name}")

    vendor = c("d0") - c("d1")
    date = c("w0") - c("w1") - vendor - c("near_window")
    item = c("g5") - c("g6") - (c("w2") - c("w3")) - c("near_items")
    return [c("g4"), vendor, c("near"), date, item]


def pair_totals(rows: DataFrame) -> DataFrame:
    """Number of pairs per level, exact for groups of any size, in linear space.

    Pairs are counted per condition from group sizes and the pairs already taken by
    a higher level are subtracted. Blank numbers equal none; an unknown company equals any.
    """
    names = ("exact", "vendor", "near", "date", "item")
    return _sums(rows, False).select(
        *[value.cast("bigint").alias(name) for name, value in zip(names, _by_levels("pairs"), strict=True)]
    )


def pair_measures(rows: DataFrame) -> DataFrame:
    """level, pairs, amount (of the lower ids) per level that has pairs, from groups and cells alone."""
    levels = [
        F.struct(F.lit(n).alias("level"), pairs.cast("bigint").alias("pairs"),
                 (amount.cast("decimal(30,0)") / 100).cast("decimal(32,2)").alias("amount"))
        for n, (pairs, amount) in enumerate(zip(_by_levels("pairs"), _by_levels("amount"), strict=True), 1)
    ]
    return _sums(rows, True).select(F.inline(F.array(*levels))).filter("pairs > 0").select(
        "level", "pairs", "amount", _by_level(0).alias("validation_type"), _by_level(1).alias("severity"),
        _by_level(2).alias("confidence"),
    )


def scan_summary(rows: DataFrame) -> DataFrame:
    """Counters of a scan; date and item matches together are the suspicious ones."""
    return pair_totals(rows).select(
        F.col("exact").alias("exact_duplicates"),
        F.col("vendor").alias("vendor_duplicates"),
        F.col("near").alias("near_duplicates"),
        (F.col("date") + F.col("item")).alias("suspicious_duplicates"),
    )


# -- findings, prior pairs, scores -------------------------------------------


def both_sides(pairs: DataFrame) -> DataFrame:
    """One row per invoice and partner."""
    sides = F.array(
        F.struct(F.col("a_id").alias("invoice_id"), F.col("b_id").alias("match_id")),
        F.struct(F.col("b_id").alias("invoice_id"), F.col("a_id").alias("match_id")),
    )
    rest = [c for c in pairs.columns if c not in ("a_id", "b_id")]
    return pairs.select(*rest, F.inline(sides))


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), col, F.lit("'"))


def match_message() -> Column:
    """Text of a finding (the wordings are fixed values), from columns of the invoice, of its partner (``other_``) and of the pair."""
    amount = text.float_text(F.col("total_amount"))
    vendor = F.coalesce(F.col("vendor_name"), F.lit("unknown"))
    number = F.coalesce(F.col("other_number"), F.lit("None"))
    other = F.concat(F.lit("invoice #"), F.col("match_id").cast("string"), F.lit(" ("), number, F.lit(")"))
    shown_similarity = F.floor(F.col("similarity")).cast("int").cast("string")
    described = (
        F.when(F.col("level") == 1, F.concat(
            F.lit("Exact duplicate: "), _quoted(F.col("invoice_number")),
            F.lit(" already exists as "), other, F.lit(".")))
        .when(F.col("level") == 2, F.concat(
            F.lit("Vendor duplicate: same vendor "), vendor, F.lit(" and amount "), amount,
            F.lit(" and invoice date as "), other, F.lit(".")))
        .when(F.col("level") == 3, F.concat(
            F.lit("Near duplicate: invoice number "), shown_similarity, F.lit("% similar to "), other,
            F.lit(" (same vendor "), vendor, F.lit(", amount differs by <= Rs.1).")))
        .when(F.col("level") == 4, F.concat(
            F.lit("Suspicious amount+date match: same vendor "), vendor, F.lit(" and amount "), amount,
            F.lit(" as "), other, F.lit(f" within {DATE_WINDOW_DAYS} days.")))
        .otherwise(F.concat(
            F.lit("Suspicious item-level duplicate: identical line items as "), other, F.lit(".")))
    )
    tokens = F.concat(
        F.lit(" | match_id="), F.col("match_id").cast("string"), F.lit(" | match_number="), number
    )
    score = F.when(
        F.col("similarity").isNotNull(),
        F.concat(F.lit(" | similarity="), text.float_text(F.col("similarity").cast("decimal(5,2)"))),
    ).otherwise(F.lit(""))
    return F.substring(F.concat(described, tokens, score), 1, 500)


def findings(pairs: DataFrame, invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Findings on both sides of every pair, with the partner kept as a column."""
    named = rules.with_vendor_name(
        invoices.select("invoice_id", "vendor_id", "invoice_number", "total_amount"), vendors
    )
    others = invoices.select(
        F.col("invoice_id").alias("match_id"), F.col("invoice_number").alias("other_number")
    )
    rows = both_sides(pairs).join(named, "invoice_id").join(others, "match_id")
    return rows.select(
        "invoice_id",
        "match_id",
        "validation_type",
        "severity",
        match_message().alias("message"),
        F.col("confidence").cast("decimal(5,2)").alias("confidence_score"),
        "similarity",
    )


def pair_key(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pair keys, without self pairs, each once per type."""
    return (
        df.filter(F.col(a) != F.col(b))
        .select(
            "validation_type",
            F.least(F.col(a), F.col(b)).alias("a_id"),
            F.greatest(F.col(a), F.col(b)).alias("b_id"),
        )
        .distinct()
    )


def prior_pairs(stored_findings: DataFrame) -> DataFrame:
    """Pairs already recorded by earlier scans, from any batch."""
    codes = [level[0] for level in LEVELS.values()]
    old = stored_findings.filter(F.col("validation_type").isin(codes) & F.col("match_id").isNotNull())
    return pair_key(old, "invoice_id", "match_id")


def _charged(current: DataFrame, prior: DataFrame, assessed: DataFrame) -> DataFrame:
    known = prior.select("validation_type", "a_id", "b_id").withColumns(
        {"saturated": F.lit(False), "in_scan": F.lit(False)}
    )
    merged = (
        current.select("validation_type", "a_id", "b_id", "saturated").withColumn("in_scan", F.lit(True))
        .unionByName(known)
        .groupBy("validation_type", "a_id", "b_id")
        .agg(F.max("in_scan").alias("in_scan"), F.max("saturated").alias("saturated"))
    )
    points = F.when(F.col("saturated"), rules.MAX_SCORE).otherwise(penalty_of(F.col("validation_type")))
    charged = (
        both_sides(merged)
        .groupBy("invoice_id")
        .agg(F.sum(points).alias("penalty"), F.max("in_scan").alias("in_scan"))
        .filter("in_scan")
    )
    score = rules.score_from_points(F.col("assessed_score") + F.col("penalty"))
    return charged.join(assessed.select("invoice_id", "assessed_score"), "invoice_id").select(
        "invoice_id",
        F.col("assessed_score").alias("rule_score"),
        score.alias("risk_score"),
        rules.status_for_score(score).alias("status"),
    )


def rescore(pairs: DataFrame, prior: DataFrame, assessed: DataFrame) -> DataFrame:
    """New score and status of the invoices matched in this scan, from its listed pairs.

    Each distinct (type, pair) of this scan and of earlier ones adds its penalty once.
    """
    return _charged(pairs.withColumn("saturated", F.lit(False)), prior, assessed)


def scan_scores(rows: DataFrame, prior: DataFrame, assessed: DataFrame) -> DataFrame:
    """What ``rescore`` gives, without a list of the pairs.

    In groups where every member has ``SATURATING_PARTNERS`` or more partners the cap of 100 is reached
    whatever else they match; only smaller groups are listed.
    """
    found = _matches(rows, SATURATING_PARTNERS).withColumn("validation_type", _by_level(0))
    return _charged(found, prior, assessed)


def pair_listing(stored_findings: DataFrame, invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row per (type, pair) in stored findings; the earliest finding supplies the values.

    Expects ``finding_id`` and ``match_id``. Sort with ``order_listing``.
    """
    codes = [level[0] for level in LEVELS.values()]
    old = stored_findings.filter(F.col("validation_type").isin(codes) & F.col("match_id").isNotNull())
    first = F.min_by(F.struct("severity", "confidence_score", "similarity"), F.col("finding_id"))
    keyed = (
        old.groupBy(
            "validation_type",
            F.least("invoice_id", "match_id").alias("invoice_a_id"),
            F.greatest("invoice_id", "match_id").alias("invoice_b_id"),
        )
        .agg(first.alias("f"))
        .select("validation_type", "invoice_a_id", "invoice_b_id", "f.*")
    )
    named = rules.with_vendor_name(invoices, vendors)

    def side(letter: str) -> DataFrame:
        return named.select(
            F.col("invoice_id").alias(f"invoice_{letter}_id"),
            F.col("invoice_number").alias(f"invoice_{letter}_number"),
            F.col("total_amount").alias(f"amount_{letter}"),
            F.col("invoice_date").alias(f"invoice_date_{letter}"),
            F.col("vendor_name").alias(f"vendor_{letter}"),
        )

    return (
        keyed.join(side("a"), "invoice_a_id", "left")
        .join(side("b"), "invoice_b_id", "left")
        .select(
            "invoice_a_id", "invoice_a_number", "invoice_b_id", "invoice_b_number",
            F.coalesce("vendor_a", "vendor_b").alias("vendor_name"),
            "amount_a", "amount_b", "invoice_date_a", "invoice_date_b",
            F.array("invoice_a_id", "invoice_b_id").alias("matched_ids"),
            "validation_type", "severity", "confidence_score", "similarity",
        )
    )


def order_listing(listing: DataFrame) -> DataFrame:
    return listing.orderBy(text.severity_rank(F.col("severity")), "invoice_a_id", "invoice_b_id")


def badge_counts(totals: DataFrame) -> DataFrame:
    """Badges of a scan from its exact counters (``pair_totals``)."""
    return totals.select(
        "exact", "near", (F.col("vendor") + F.col("date") + F.col("item")).alias("suspicious")
    )
