"""Operators on small tables: criteria dialects, lookups, pivots, sheets, the line form, office files, streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillgrid.functions.cells import num
from quillgrid.operators import aggregates as A
from quillgrid.operators import criteria as C
from quillgrid.operators import database as D
from quillgrid.operators import filters as FL
from quillgrid.operators import lookup as L
from quillgrid.operators import pivot as P
from quillgrid.operators import ranks as RK
from quillgrid.operators import reshape as R
from quillgrid.operators import textform as T
from quillgrid.operators.ranges import Range, column_index, letters_of
from quillgrid.sources import office, tables
from quillgrid.streaming import rowwise


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("North", "A", 10.0, 1, True), ("North", "B", 20.0, 2, False), ("South", "A", None, 3, True), ("South", None, 5.0, 4, None), (None, "apple", 7.0, 5, False), ("east", "10", 0.0, 6, True)]
    return spark.createDataFrame(rows, "region string, product string, amount double, id int, flag boolean")


def count(df, column, wanted):
    return df.agg(C.COUNTIF(df, column, wanted).alias("n")).first()["n"]


def test_countif_dialect(sales):
    assert count(sales, "region", "north") == 2 and count(sales, "region", "*th") == 4 and count(sales, "region", "<>north") == 4
    assert count(sales, "region", "=") == 1 and count(sales, "region", "<>") == 5 and count(sales, "product", 10) == 1
    assert count(sales, "amount", ">=7") == 3 and count(sales, "amount", "<>7") == 5 and count(sales, "amount", None) == 1
    assert count(sales, "flag", True) == 3 and count(sales, "flag", "<>TRUE") == 3 and count(sales, "amount", "x") == 0


def test_database_dialect(sales):
    run = lambda f, lines: tuple(f(sales, "amount", lines).first())
    assert run(D.DSUM, [{"region": "North"}, {"id": ">=6"}]) == (30.0, None) and run(D.DSUM, []) == (42.0, None)
    assert run(D.DAVERAGE, [{"id": ">99"}]) == (0.0, None) and run(D.DVARP, [{"id": "1"}]) == (None, "#DIV/0!")
    assert run(D.DCOUNT, [{"region": ">A"}]) == (0.0, None) and run(D.DCOUNTA, [{"product": "a*"}]) == (2.0, None)
    assert tuple(D.DGET(sales, "product", [{"id": 2}]).first()) == ("B", None) and tuple(D.DGET(sales, 2, [{"region": "North"}]).first()) == (None, "#NUM!")
    assert run(D.DSUM, [{"flag": "TRUE"}]) == (0.0, None)
    with pytest.raises(ValueError):
        D.DSUM(sales, "amount", [{"nope": 1}])


def test_aggregates_of_nothing(sales):
    none = sales.where("id > 99")
    row = none.agg(A.SUM("amount").alias("s"), A.MAX("amount").alias("m"), A.AVERAGE("amount").alias("a"), A.average_error("amount").alias("e"), A.PRODUCT("amount").alias("p"), A.spread_error("amount").alias("v")).first()
    assert tuple(row) == (0.0, 0.0, None, "#DIV/0!", 0.0, "#DIV/0!")
    assert tuple(A.LARGE(sales, "amount", 9).first()) == (None, "#NUM!") and A.SMALL(sales, "amount", 2).first()["small"] == 5.0


def test_approximate_lookup_both_ways_agree(spark, monkeypatch):
    table = spark.createDataFrame([(float(k), f"v{k}") for k in range(10, 400, 7)], "k double, v string")
    asked = spark.createDataFrame([(i, float(i) if i % 9 else None) for i in range(450)], "i int, x double")
    want = {}
    for r in asked.collect():
        below = [k for k in range(10, 400, 7) if r["x"] is not None and k <= r["x"]]
        want[r["i"]] = (f"v{below[-1]}", None) if below else (None, "#N/A")
    small = {r["i"]: (r["f"], r["f_error"]) for r in L.lookup_approximate(asked, "x", table, "k", "v", name="f").collect()}
    monkeypatch.setattr(L, "ARRAY_ROWS", 5)
    large = {r["i"]: (r["f"], r["f_error"]) for r in L.lookup_approximate(asked, "x", table, "k", "v", name="f").collect()}
    assert small == want and large == want
    monkeypatch.setattr(L, "BROADCAST_ROWS", 5)
    position = L.match(asked.where("x = 24"), "x", table, "k", "k").first()["position"]
    assert position == 3 and L.index(asked.where("i = 3"), "i", table, "k", "v").first()["found"] == "v24"


def test_pivot(sales):
    spec = P.Pivot(rows=["region"], columns=["flag"], values=[("amount", "sum", "total")], pages={"product": ["A", "B"]})
    rows = {(r["region"], r["flag"]): r["total"] for r in spec.long(sales).collect()}
    assert rows[("North", "Grand Total")] == 30.0 and rows[("Grand Total", "Grand Total")] == 30.0 and rows[("Grand Total", "true")] == 10.0
    for bad in (P.Pivot(["region"], []), P.Pivot(["region"], [("amount", "sum", "t")], columns=["region"]), P.Pivot(["x"], [("amount", "sum", "t")]), P.Pivot(["region"], [("amount", "mode", "t")])):
        with pytest.raises(ValueError):
            bad.validate(sales)
    assert [r["region"] for r in P.Pivot(["region"], [("amount", "count", "n")]).table(sales).collect()][-1] == "Grand Total"


def test_filters(sales):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(FL.filter_values(sales, "region", ["North"], blanks=True)) == [1, 2, 5] and ids(FL.filter_custom(sales, "amount", ">5", "<20")) == [1, 5]
    assert ids(FL.filter_top(sales, "amount", 2)) == [1, 2] and ids(FL.filter_top(sales, "amount", 40, bottom=True, percent=True)) == [4, 6]
    assert ids(FL.duplicates(sales, "product")) == [1, 3] and ids(FL.filter_average(sales, "amount")) == [1, 2]
    assert ids(sales.where(FL.validation("product", "textLength", "equal", 1))) == [1, 2, 3, 4]


def test_sheets_and_lines(spark, sales):
    cells = R.to_cells(sales, "id", "S", header=True)
    assert cells.where("row = 1").count() == 4 and R.info(cells).first()["rows"] == 7
    lines = T.derive_lines(cells)
    texts = [r["line"] for r in lines.collect()]
    assert texts[:5] == ["A1: region", "B1: product", "C1: amount", "D1: flag", "A2: North"] and 'B7: "10"' in texts and "D2: true" in texts
    key = lambda df: sorted(map(str, df.select("row", "col", "kind", "num", "txt", "bool").collect()))
    assert key(T.parse_lines(lines)) == key(cells)
    odd = spark.createDataFrame([("S", 1, 1, "s", None, t, None, None, None) for t in ["", "a\nb", 'say "x"', "TRUE", "#N/A", " pad", "=1", "back\\slash", "1e3"]], cells.schema)
    assert sorted(r["txt"] for r in T.parse_lines(T.derive_lines(odd)).collect()) == sorted(r["txt"] for r in odd.collect())
    moved = R.copy_range(cells, 2, 1, 3, 1, 10, 2, move=True)
    assert {(r["row"], r["col"]) for r in moved.where("txt = 'North'").collect()} == {(10, 2), (11, 2)}
    assert R.read_range(cells, 1, 1, 1, 2, "S").count() == 2 and R.clear_range(cells, 1, 1, 1, 9).count() == cells.count() - 4
    assert tables.cell_lines(cells).first()["line"] == "A1,region"
    assert [r["id"] for r in R.sort_rows(sales, "region", "id", ascending=False).collect()][:2] == [6, 3]


def test_lint_and_edits(spark):
    formulas = spark.createDataFrame([("A", 1, 1, "Data!B2+SUM(A1:A3)"), ("A", 2, 1, "'No Sheet'!A1"), ("A", 3, 1, "SUM(1")], "sheet string, row int, col int, formula string")
    found = T.lint_references(formulas, spark.createDataFrame([("Data",), ("A",)], "sheet string"))
    assert {(r["row"], r["code"]) for r in found.collect()} == {(2, "broken_sheet_ref"), (3, "broken_formula_syntax")}
    assert tuple(T.lint_report(found, ["broken_sheet_ref"]).first()) == (1, 1, False)
    nodes = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p2", "c")], "id string, text string")
    edits = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p9"), (4, "??")], "edit int, id string")
    assert {tuple(r) for r in T.lint_edits(edits, nodes).collect()} == {(2, "ambiguous_anchor"), (3, "missing_target"), (4, "invalid_id")}


def test_ranges():
    r = Range.of("'My ''S'!$C$3:B1")
    assert (r.sheet, r.a1(), r.r1c1(), r.ROWS(), r.COLUMNS()) == ("My 'S", "B1:C3", "R1C2:R3C3", 3, 2) and r.transposed().a1() == "B1:D2" and r.moved(1, 1).a1() == "C2:D4"
    assert all(column_index(letters_of(i)) == i for i in (1, 26, 27, 702, 703, 16384))
    with pytest.raises(ValueError):
        Range.of("A0")


def test_office_files(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="b"><v>1</v></c><c r="AA1" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hi </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sld>')
    (tmp_path / "d.xlsx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    cells = {(r["row"], r["col"]): (r["kind"], r["num"], r["txt"], r["bool"], r["err"], r["formula"]) for r in office.read_cells(spark, str(tmp_path)).collect()}
    assert cells == {(1, 1): ("s", None, "hello", None, None, None), (1, 2): ("n", 2.0, None, None, None, "1+1"), (1, 3): ("b", None, None, True, None, None), (1, 27): ("e", None, None, None, "#N/A", None)}
    assert [(r["kind"], r["text"]) for r in office.read_paragraphs(spark, str(tmp_path)).collect()] == [("paragraph", "Hi you"), ("cell", "c")]
    assert [r["text"] for r in office.read_slides(spark, str(tmp_path)).collect()] == ["Title"]
    assert office.parts(spark, str(tmp_path)).count() == 6 and office.relationships(spark, str(tmp_path)).first()["type"] == "worksheet"
    assert sum(r["encrypted"] for r in office.encrypted(spark, str(tmp_path)).collect()) == 1


def test_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", i % 2, float(i)) for i in range(12)]
    batch = spark.createDataFrame(rows, "id int, at string, k int, v double").withColumn("at", F.col("at").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = rowwise.with_cells(rowwise.read_stream(spark, str(tmp_path / "in"), batch.schema), {"twice": num("v") + num("v")})
    spans = rowwise.windowed(stream, "at", ["k"], {"n": A.COUNT("id"), "s": A.SUM("twice")})
    q = spans.writeStream.format("memory").queryName("spans").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["start"]), r["k"]): (r["n"], r["s"]) for r in spark.sql("SELECT * FROM spans").collect()}
    want = {(str(r["start"]), r["k"]): (r["n"], r["s"]) for r in rowwise.windowed(rowwise.with_cells(batch, {"twice": num("v") + num("v")}), "at", ["k"], {"n": A.COUNT("id"), "s": A.SUM("twice")}).collect()}
    assert got == want and len(got) == 6


def test_ranks_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(RK, "FEW", 50)
    monkeypatch.setattr(RK, "HEAP", 2)
    values = [float(i * i % 997) for i in range(3000)] + [5.0] * 2000 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted((v for v in values if v is not None), reverse=True)
    for n in (1, 2, 700, 2500, 4999, 5000):
        assert A.nth_largest(df, "x", n) == order[n - 1]
    assert A.nth_largest(df, "x", 5001) is None and A.nth_largest(df, "x", 0) is None and A.nth_largest(df.limit(0), "x", 1) is None
    assert A.MEDIAN_OF(df, "x").first()["median"] == (order[2499] + order[2500]) / 2


def test_kinds_of_columns(spark):
    df = spark.createDataFrame([("5", True, 2.0), ("a", False, None), (None, None, 4.0)], "t string, b boolean, n double")
    row = df.agg(A.COUNT("t").alias("a"), A.COUNT("b").alias("b"), A.SUM("t", "b", "n").alias("c"), A.PRODUCT("b").alias("d"), A.MINA("t", "n").alias("e"), A.AVERAGE("t").alias("f"), A.COUNTA("t").alias("g"), A.STDEVPA("b").alias("h")).first()
    assert list(row) == [0, 0, 7.0, 0.0, 0.0, None, 2, 0.5]


def test_workday_with_many_holidays(spark):
    from quillgrid.functions import dates as DT
    from quillgrid.functions.cells import num

    rows = spark.createDataFrame([(45292.0,), (45296.0,), (45297.0,)], "d double")
    holidays = list(range(45300, 45360, 7)) + [45310]
    ahead, back = DT.WORKDAY(num("d"), 25, holidays).value, DT.WORKDAY(num("d"), -3, [45289, 45288]).value

    def plain(day, n, off):
        step, left = (1, n) if n > 0 else (-1, -n)
        while left:
            day += step
            left -= (day - 2) % 7 < 5 and day not in off
        return float(day)

    for r in rows.select("d", ahead.alias("a"), back.alias("b")).collect():
        assert r["a"] == plain(int(r["d"]), 25, holidays) and r["b"] == plain(int(r["d"]), -3, [45289, 45288])


def test_r1c1_back():
    assert Range.of_r1c1("R2C3:R1C1").a1() == "A1:C2" and Range.of_r1c1(Range.of("B7").r1c1()).a1() == "B7"


def test_formulas_move(spark):
    from quillgrid.operators import rebase

    df = spark.createDataFrame([("A1+$B$2*SUM(C3:$D4)&\"A1\"&LOG10(AA10)&Other!A5&'My A1'!B1",), (None,)], "f string")
    row = df.select(rebase.copied(F.col("f"), 2, 1).alias("a"), rebase.rows_shifted(F.col("f"), 3, 2).alias("b"), rebase.rows_shifted(F.col("f"), 3, -1).alias("c"), rebase.columns_shifted(F.col("f"), 2, 1).alias("d"), rebase.copied(F.col("f"), -2, 0).alias("e")).collect()
    assert row[0]["a"] == "B3+$B$2*SUM(D5:$D6)&\"A1\"&LOG10(AB12)&Other!B7&'My A1'!C3"
    assert row[0]["b"] == "A1+$B$2*SUM(C5:$D6)&\"A1\"&LOG10(AA12)&Other!A5&'My A1'!B1"
    assert row[0]["c"] == "A1+$B$2*SUM(#REF!:$D3)&\"A1\"&LOG10(AA9)&Other!A5&'My A1'!B1"
    assert row[0]["d"] == "A1+$C$2*SUM(D3:$E4)&\"A1\"&LOG10(AB10)&Other!A5&'My A1'!B1"
    assert row[0]["e"].startswith("#REF!+$B$2*SUM(C1:$D2)") and row[1]["a"] is None
    cells = spark.createDataFrame([("S", 1, 1, "f", None, None, None, None, "B5")], "sheet string, row long, col int, kind string, num double, txt string, bool boolean, err string, formula string")
    assert R.insert_rows(cells, 2, 3).first()["formula"] == "B8" and R.copy_range(cells, 1, 1, 1, 1, 2, 2).where("row = 2").first()["formula"] == "C6"


def test_lint_of_names_and_pivots(spark):
    sheets = spark.createDataFrame([("Data",), ("My 'S",)], "sheet string")
    names = spark.createDataFrame([("ok", "Data!$A$1:$B$2"), ("q", "'My ''S'!A1"), ("a", "42"), ("b", "Gone!A1"), ("c", "Data!A1:")], "name string, target string")
    assert {tuple(r) for r in T.lint_names(names, sheets).collect()} == {("a", "named_range_not_a1_range"), ("b", "named_range_missing_sheet"), ("c", "named_range_invalid_range")}
    pivots = spark.createDataFrame([(1, "Data!A1:C9"), (2, "x"), (3, "No!A1"), (4, "Data!?")], "pivot int, source string")
    fields = spark.createDataFrame([(1, "Region", "row"), (1, "Gone", "row"), (1, "Lost", "value"), (2, "Z", "row")], "pivot int, field string, role string")
    headers = spark.createDataFrame([("Data", "Region"), ("Data", "Sales")], "sheet string, header string")
    got = {tuple(r) for r in T.lint_pivots(pivots, fields, sheets, headers).collect()}
    assert got == {(1, "Gone", "pivot_field_missing_header"), (1, "Lost", "pivot_value_missing_header"), (2, None, "pivot_source_invalid"), (3, None, "pivot_source_missing_sheet"), (4, None, "pivot_source_range_invalid")}


def test_small_reshapes(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, None), ("b", 0.0, False)], "k string, v double, b boolean")
    assert sorted((r["v"], r["share"]) for r in R.share_of_category(df, ["k"], "v").collect()) == [(0.0, None), (1.0, 0.25), (3.0, 0.75)]
    assert [(x["kind"], x["value"]) for x in R.cache_records(df, ["k", "v", "b"]).where("v = 3").first()["record"]] == [("s", "a"), ("n", "3.0"), ("m", None)]
    cells = R.to_cells(df.withColumn("at", F.lit(1).cast("long") + F.col("v").cast("long")), "at", "S")
    assert [(r["number"], r["label"]) for r in R.points(cells, 2, 1, 2, 3).collect()] == [(None, "a"), (1.0, "1"), (1.0, "TRUE")]
    body = spark.createDataFrame([("d", 0, "paragraph", None, None, "one two one"), ("d", 1, "cell", 0, 0, "x"), ("d", 1, "cell", 0, 1, "y"), ("d", 2, "paragraph", None, None, None)], "path string, item long, kind string, row long, col long, text string")
    assert [(r["anchor"], r["text"]) for r in T.anchored(body).orderBy("item").collect()] == [("[p1]", "one two one"), ("[t1]", "x\ty"), ("[p2]", "")]
    assert [(r["text"], r["replaced"]) for r in T.replace_counted(body, "one", "1").orderBy("item").collect()][0] == ("1 two 1", 2)


def test_more_office_parts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("docProps/custom.xml", '<Properties xmlns="c" xmlns:vt="v"><property name="Client"><vt:lpwstr>Acme</vt:lpwstr></property></Properties>')
        z.writestr("word/comments.xml", '<w:comments xmlns:w="w"><w:comment w:id="3" w:author="Ann" w:date="2024-01-01"><w:p><w:r><w:t>Check</w:t></w:r></w:p></w:comment></w:comments>')
    assert [tuple(r)[1:] for r in office.properties(spark, str(tmp_path)).collect()] == [("Client", "Acme")]
    assert [tuple(r)[1:] for r in office.read_comments(spark, str(tmp_path)).collect()] == [("3", "Ann", "2024-01-01", "Check")]
    assert bytes(office.part_content(spark, str(tmp_path), "word/comments.xml").first()["content"]).startswith(b"<w:comments")
