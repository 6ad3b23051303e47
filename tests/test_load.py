from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from billsift.functions import text
from billsift.operators import load, runs
from billsift.sources import lines
from billsift.streaming import file_drop

HEADER = "Invoice Number,Vendor Name,invoice_date,Product-Name,quantity,unit price,GST Rate"


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_dates(spark):
    got = column(spark, ["2024-1-5", "13/02/2024", "02/13/2024", "03/04/2024", "2024-02-30", " 2024-01-05 ", "", None],
                 text.parse_date)
    assert got == [date(2024, 1, 5), date(2024, 2, 13), date(2024, 2, 13), date(2024, 4, 3), None,
                   date(2024, 1, 5), None, None]


def test_numbers(spark):
    got = column(spark, ["1,200", "18%", "", "abc", "1_000", "1.0d", "1e2", "-.5", "inf", None], text.parse_number)
    assert [None if x is None else float(x) for x in got] == [1200, 18, None, None, None, None, 100, -0.5, None, None]


def test_clean_strips_all_white_space(spark):
    assert column(spark, ["\t a b\n", " x　", None], text.clean) == ["a b", "x", ""]


def test_file_names(spark):
    got = column(spark, ["/a/b.csv", "../x\x01y.csv", "", None, "n" * 300, "dir/"], text.file_base_name)
    assert got == ["b.csv", "xy.csv", "upload", "upload", "n" * 255, "dir"]


def test_headers(spark):
    got = column(spark, [" GST Rate ", "Unit  Price", "_Über-Name_", "", None], lines.column_name)
    assert got == ["gst_percent", "unit__price", "über_name", "", ""]
    with pytest.raises(ValueError, match="missing columns: gst_percent"):
        lines.canonical_rows(spark.createDataFrame([("A", "x")], "invoice_number string, gst string").drop("gst"))


def test_uploads_of_any_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        b"\xef\xbb\xbf" + (HEADER + '\n A-1 ,Acme,2024-01-05,"pen, ""blue""\nbox",2,"1,000.005",18%\n,,,,,,\n').encode())
    (tmp_path / "b.CSV").write_bytes(
        "vendor_name,invoice_number,invoice_date,product_name,quantity,unit_price,gst,more\nCaf\xe9,B-1,05/01/2024,x,1,2,,9\n"
        ",,,,,,,only extra text\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text("vendor_name,invoice_date,product_name,quantity,unit_price,gst\n")
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    (tmp_path / "e.xlsx").write_bytes(b"not text")
    (tmp_path / "f.csv").write_text(HEADER + "\n,,,,,,\n")
    (tmp_path / "g.csv").write_text("\n\n")
    (tmp_path / "h.csv").write_bytes(HEADER.encode() + b"\n\x81\xff,Acme,2024-01-05,x,1,2,3\n")
    uploads = lines.read_uploads(spark, str(tmp_path))
    good = {(r["file_name"], r["invoice_number"]): r for r in uploads.filter("error is null").collect()}
    assert set(good) == {("a.csv", "A-1"), ("b.CSV", "B-1"), ("b.CSV", "")}
    a, b = good[("a.csv", "A-1")], good[("b.CSV", "B-1")]
    assert a["product_name"] == 'pen, "blue"\nbox' and a["unit_price"] == "1,000.005"
    assert b["vendor_name"] == "Caf\xe9" and b["gst_percent"] == ""
    errors = {r["file_name"]: r["error"] for r in uploads.filter("error is not null").collect()}
    assert errors == {
        "c.csv": "missing columns: invoice_number",
        "d.csv": "missing columns: gst_percent, invoice_date, invoice_number, product_name, quantity, unit_price, vendor_name",
        "e.xlsx": lines.WRONG_TYPE, "f.csv": lines.NO_ROWS, "g.csv": lines.NO_HEADER, "h.csv": lines.NO_ENCODING,
    }
    loaded = load.load_lines(lines.upload_lines(uploads))
    money = {r["invoice_number"]: float(r["total_amount"]) for r in loaded.invoices.collect()}
    # 2 x 1000.005 = 2000.01, 18 % of it 360.00.
    assert money == {"A-1": 2360.01, "B-1": 2.0}
    assert float(loaded.items.filter("invoice_number = 'A-1'").first()["unit_price"]) == 1000.01
    small = lines.read_uploads(spark, str(tmp_path), most_bytes=50)
    assert {r["file_name"] for r in small.filter(F.col("error") == lines.TOO_LONG).collect()} >= {"a.csv", "b.CSV"}


def test_wide_files(spark, tmp_path):
    names = HEADER.split(",")
    other = [f"x{n}" for n in range(90)]
    (tmp_path / "wide.csv").write_text(
        "\n" + ",".join([*other, *names]) + "\n" + ",".join(["o"] * 90 + ["W-1", "Acme", "2024-01-05", "pen", "1", "2", "0"]) + "\n"
    )
    (tmp_path / "plain.csv").write_text(HEADER + "\nP-1,Acme,2024-01-05,pen,1,2,0\n")
    assert lines.widest_header(spark, str(tmp_path)) == 97
    got = {(r["file_name"], r["invoice_number"], r["error"]) for r in lines.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {("wide.csv", "W-1", None), ("plain.csv", "P-1", None)}


def test_split_files_keep_their_order(spark, tmp_path):
    body = "".join(f"N-{n // 40},V{n},2024-01-0{1 + n // 40 % 9},p,1,{n},0\n" for n in range(4000))
    (tmp_path / "a.csv").write_text(HEADER + "\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        uploads = lines.read_uploads(spark, str(tmp_path), multi_line=False)
        loaded = load.load_lines(lines.upload_lines(uploads))
        got = {r["invoice_number"]: r["vendor_name"] for r in loaded.invoices.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"N-{n}": f"V{40 * n}" for n in range(100)}


def test_files_with_line_breaks_are_split(spark, tmp_path):
    body = "".join(f'N-{n},"V{n}\n& Co ""{n}""",2024-01-05,"pen\n,\n",2,5,10\n' for n in range(400))
    (tmp_path / "a.csv").write_text('invoice_number,vendor_name,invoice_date,"product\nname",quantity,unit_price,gst\n' + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        uploads = lines.read_uploads(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["error"] for r in uploads} == {None}
    assert {(r["invoice_number"], r["vendor_name"], r["product_name"]) for r in uploads} == {
        (f"N-{n}", f'V{n}\n& Co "{n}"', "pen\n,") for n in range(400)}
    assert len({r["row_order"]["block"] for r in uploads}) > 5


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('row_id,amount,day,flag\n1,2.50,2024-01-05,true\n2,,,\nx,abc,2024-13-05,maybe\n')
    schema = StructType.fromDDL("row_id bigint, amount decimal(5,2), day date, flag boolean")
    got = sorted(map(tuple, lines.read_typed_csv(spark, str(tmp_path), schema).collect()), key=str)
    # What does not fit its type is null.
    assert got == [(1, Decimal("2.50"), date(2024, 1, 5), True), (2, None, None, None), (None, None, None, None)]


def test_large_numbers_are_kept_or_rejected(spark):
    df = transport(spark, [
        (1, "A", "Acme", "2024-01-05", "pen", "1", "2", "0"),
        (1, "A", "Acme", "2024-01-05", "pen", "1", "1000000000000", "0"),
        (1, "B", "Acme", "2024-01-05", "pen", "99999999999", "99999999999", "18"),
        (1, "C", "Acme", "2024-01-05", "pen", "9" * 30, "9" * 30, "18"),
        (1, "C", "Acme", "2024-01-05", "pen", "1", "x", "18"),
        (1, "C", "Acme", "2024-01-05", "pen", "3", "1", "12.34567"),
    ])
    loaded = load.load_lines(df)
    got = {r["invoice_number"]: str(r["total_amount"]) for r in loaded.invoices.collect()}
    subtotal = 99999999999 ** 2
    assert got == {"A": "1000000000002.00", "B": f"{subtotal + (subtotal * 18 + 50) // 100}.18", "C": "3.37"}
    reasons = sorted((r["row_order"], r["reason"]) for r in loaded.rejected_lines.collect())
    assert reasons == [(3, "out of range"), (4, "unit_price")]


def transport(spark, rows):
    names = ["invoice_number", "vendor_name", "invoice_date", "product_name", "quantity", "unit_price", "gst_percent"]
    schema = "batch_id long, row_order long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(b, i, *r) for i, (b, *r) in enumerate(rows)], schema)


def test_load_keeps_first_header_and_skips_bad_lines(spark):
    df = transport(spark, [
        (1, "A", "Acme", "2024-01-05", "", "1", "10", "18"),
        (1, "A ", "Other", "bad", "pen", "x", "10", "18"),
        (1, "B", "", "2024-01-05", "pen", "1", "1", "0"),
        (1, "C", "Acme", "2024-01-05", "pen", "", "1", "0"),
        (1, " ", "Acme", "2024-01-05", "pen", "1", "1", "0"),
        (2, "A", "Zeta", "2024-01-05", "pen", "-1", "2.675", "0"),
    ])
    loaded = load.load_lines(df)
    got = {(r["batch_id"], r["invoice_number"]): (r["vendor_name"], float(r["total_amount"]))
           for r in loaded.invoices.collect()}
    assert got == {(1, "A"): ("Acme", 11.8), (1, "C"): ("Acme", 0.0), (2, "A"): ("Zeta", -2.67)}
    assert [r["product_name"] for r in loaded.items.filter("batch_id = 1").collect()] == ["General"]
    counts = {r["batch_id"]: (r["total"], r["processed"], r["failed"]) for r in loaded.counts.collect()}
    assert counts == {1: (4, 2, 2), 2: (1, 1, 0)}
    policy = {r["batch_id"]: r["status"] for r in load.single_invoice_policy(df).collect()}
    assert policy == {1: "Failed", 2: "Completed"}


def test_new_vendor_ids_are_consecutive(spark):
    vendors = spark.createDataFrame([(7, 1, "Acme"), (9, 2, "Zeta")], "vendor_id long, company_id long, vendor_name string")
    accepted = spark.createDataFrame([(n,) for n in ["Zeta", "Acme", "Beta", "Zeta"]], "vendor_name string")
    got = {(r["vendor_id"], r["company_id"], r["vendor_name"]) for r in load.assign_vendor_ids(accepted, vendors).collect()}
    assert got == {(7, 1, "Acme"), (9, 2, "Zeta"), (10, 1, "Beta"), (11, 1, "Zeta")}


def test_file_drop_loads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {
        "a": HEADER + "\na,Acme,2024-01-05,pen,2,5,10\n,,,,,,\n",
        "b": "vendor_name,invoice_number,invoice_date,product_name,quantity,unit_price,gst\nBeta,b,2024-01-05,pen,2,5,10\n",
        "c": "vendor_name,invoice_number\nBeta,b\n",
    }
    vendors = spark.createDataFrame([(4, 1, "Acme")], "vendor_id long, company_id long, vendor_name string")
    for name, content in files.items():
        (tmp_path / "in" / f"{name}.csv").write_text(content)
        file_drop.start(
            spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), vendors
        ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "invoices"))
    assert sorted((r["invoice_number"], r["vendor_id"], float(r["total_amount"])) for r in got.collect()) == [
        ("a", 4, 11.0), ("b", 5, 11.0)]
    refused = spark.read.parquet(str(tmp_path / "out" / "refused")).collect()
    assert [r["error"][:15] for r in refused] == ["missing columns"]
    counts = spark.read.parquet(str(tmp_path / "out" / "batches")).collect()
    assert [(r["total_invoices"], r["failed_invoices"]) for r in counts] == [(1, 0), (1, 0)]


def test_file_drop_shows_whole_loads_only(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\na,Acme,2024-01-05,pen,2,5,10\n")
    folders = [str(tmp_path / name) for name in ("in", "out", "state")]
    real = runs.commit

    def killed(*_):
        raise RuntimeError("driver gone")

    monkeypatch.setattr(runs, "commit", killed)
    with pytest.raises(Exception, match="driver gone"):
        file_drop.start(spark, *folders).awaitTermination()
    schema = "invoice_number string, vendor_id bigint"
    assert runs.history(spark, folders[1], "invoices", schema).count() == 0
    # The retry of the same micro-batch, and one more file after it.
    monkeypatch.setattr(runs, "commit", real)
    file_drop.start(spark, *folders).awaitTermination()
    (tmp_path / "in" / "b.csv").write_text(HEADER + "\nb,Acme,2024-01-05,pen,2,5,10\nc,Beta,2024-01-05,pen,2,5,10\n")
    file_drop.start(spark, *folders).awaitTermination()
    got = runs.history(spark, folders[1], "invoices", schema).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 1), ("c", 2)]
    assert runs.history(spark, folders[1], "vendors").count() == 2


def test_places_are_worked_out_once(spark):
    names = ["Invoice Number", "VENDOR_NAME", "invoice date", "Product-Name", "quantity", "Unit Price", "GST Rate"]
    rows = spark.range(3).select(*[F.concat(F.lit(" x"), F.col("id").cast("string")).alias(n) for n in names])
    got = lines.canonical_rows(rows)
    assert "array_position" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(f"x{n}",) * 7 for n in range(3)]


def test_a_filter_on_line_money_does_not_repeat_the_parsing(spark):
    rows = spark.createDataFrame(
        [(1, 1, "A", "V", "2024-01-05", "pen", "2", "1,000.50", "18%"), (1, 2, "A", "V", "2024-01-05", "pen", "abc", "1", "0")],
        "batch_id int, row_order int, invoice_number string, vendor_name string, invoice_date string, product_name string, "
        "quantity string, unit_price string, gst_percent string",
    )
    items = load.parse_items(rows)
    assert [float(r["line_total"]) for r in items.collect()] == [2361.18]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert 3 <= plan.count("translate(") <= 6
