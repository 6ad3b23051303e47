import csv
import io
import random

import pytest

from billsift.sources import lines, quoted


def rows_of(spark, folder, width=3):
    found = quoted.placed_cells(spark, str(folder), lines.cell_schema(width), lines.reader_options(True))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["file_path"], tuple(r["row_order"]))):
        out.setdefault(r["file_path"].rsplit("/", 1)[1], []).append(["" if c is None else c for c in r["cells"]])
    return out


@pytest.mark.parametrize("block", ["64", "400", "128m"])
def test_rows_with_breaks_in_any_block(spark, tmp_path, block):
    rng = random.Random(block)
    cells = ["a", "", "x\ny", "say \"no\"", "1,5", "\n\n", "\"", "end\r\nof", ",\n,\"\n\"", "plain text " * 4, "5\" pipe"]
    expected = {}
    for n in range(4):
        rows = [[rng.choice(cells) for _ in range(3)] for _ in range(60)]
        rows = [r for r in rows if any(c.strip() for c in r)]
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\r\n" if n == 1 else "\n").writerows(rows)
        # A quote inside an unquoted cell is a character.
        raw = buffer.getvalue() + ("5\" pipe,6\" pipe,7\n" if n != 1 else "")
        (tmp_path / f"{n}.csv").write_text(raw, newline="")
        expected[f"{n}.csv"] = list(csv.reader(io.StringIO(raw, newline="")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows_of(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected


def test_a_cell_never_closed_takes_the_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n\n  \n1,\"open\n2,x,y\n3,x,y\n")
    (tmp_path / "b.csv").write_text("")
    assert rows_of(spark, tmp_path) == {"a.csv": [["a", "b", "c"], ["1", "open\n2,x,y\n3,x,y", ""]]}


def test_records_filled_up_to_the_header_give_the_same_cells(spark, tmp_path):
    body = ['a,b,c', '1', '1,2', '"x,y",2', '"x,y","u,v","w,z"', '"say ""no""",2,3', '"a ""b"", c",2,3', '"a"b,"c",d', '1,2,3,more',
            '5" pipe,6" pipe,7', '"",,""', ',,,only beyond', '"x\n,y",2,"\n\n"', '1,2,', '1,"open\n2,x,y']
    (tmp_path / "a.csv").write_text("\n".join(body) + "\n")
    stored = quoted.stored_lines(spark, str(tmp_path))
    schema, options = lines.cell_schema(5), lines.reader_options(True)

    def cells(width):
        found = quoted.cells_of(stored, schema, options, width).collect()
        return [["" if c is None else c for c in r["cells"]] for r in sorted(found, key=lambda r: tuple(r["row_order"]))]

    plain, filled = cells(None), cells(3)
    assert [r + [""] * (5 - len(r)) for r in filled] == plain
    # Only what cannot be counted or has more cells takes the wide schema.
    wide = [r for r in filled if len(r) == 5]
    assert 0 < len(wide) < 8 and ["", "", "", "only beyond", ""] in wide


def test_states_of_lines_need_no_shuffle(spark, tmp_path):
    """Lines know their state as they are read, over batches of any size; the files may go afterwards."""
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(4)
    expected = []
    for n in range(3):
        rows = [[f"{n}-{k}", rng.choice(["x\ny", "plain", "\n", "a,b", "say \"no\"\n\"", "\"\n\""])] for k in range(300)]
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows([["Invoice Number", "Product Name"], *rows])
        (folder / f"{n}.csv").write_text(buffer.getvalue(), newline="")
        expected += [[a, b.strip()] for a, b in rows]
    header = "Invoice Number,Product Name,vendor_name,invoice_date,quantity,unit_price,gst_percent"
    for n in range(3):
        path = folder / f"{n}.csv"
        path.write_text(path.read_text().replace("Invoice Number,Product Name", header, 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = quoted.stored_lines(spark, str(folder))
        plan = quoted._with_states(found.select("file_path", "block", "nth", "value"))._jdf.queryExecution().executedPlan()
        uploads = lines.read_uploads(spark, str(folder))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Exchange" not in plan.toString()
    for file in folder.iterdir():
        file.unlink()
    got = [[r["invoice_number"], r["product_name"]] for r in uploads.collect() if r["error"] is None]
    assert sorted(got) == sorted(expected)
