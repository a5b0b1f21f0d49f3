"""Part graphs, streamed sheets, presentation order and runs of office packages; fractions against all denominators."""

import random
import zipfile

from pyspark.sql import functions as F

from quillgrid.functions import numfmt
from quillgrid.sources import office

REL = '<Relationship Id="{}" Type="t/x" Target="{}"{}/>'


def rels(*pairs):
    return "<Relationships>" + "".join(REL.format(f"r{i}", *(p if isinstance(p, tuple) else (p, ""))) for i, p in enumerate(pairs)) + "</Relationships>"


def test_part_graph(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "chain.xlsx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("_rels/.rels", rels("xl/p0.xml", "/docProps/core.xml", ("http://x.example/", ' TargetMode="External"'), "gone.xml"))
        z.writestr("docProps/core.xml", "<a/>")
        for k in range(200):
            z.writestr(f"xl/p{k}.xml", "<a/>")
            z.writestr(f"xl/_rels/p{k}.xml.rels", rels(f"p{k + 1}.xml" if k < 199 else "../xl/p0.xml", *(["media/../p3.xml"] if k == 50 else [])))
        z.writestr("xl/alone.xml", "<a/>")
        z.writestr("xl/_rels/alone.xml.rels", rels("p7.xml"))
    (tmp_path / "old.xlsx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    got = {r["part"]: (r["depth"], r["parents"]) for r in office.part_graph(spark, str(tmp_path)).collect()}
    assert len(got) == 202 and got["docProps/core.xml"] == (1, [""]) and got["xl/alone.xml"] == (None, [])
    assert all(got[f"xl/p{k}.xml"][0] == k + 1 for k in range(200))
    assert got["xl/p0.xml"][1] == ["", "xl/p199.xml"] and got["xl/p3.xml"][1] == ["xl/p2.xml", "xl/p50.xml"] and got["xl/p7.xml"][1] == ["xl/alone.xml", "xl/p6.xml"]


def test_large_sheet_in_chunks(spark, tmp_path, monkeypatch):
    ns = 'xmlns="m" xmlns:r="r"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r0"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels("/xl/worksheets/sheet1.xml"))
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>he</t></si><si><r><t>l</t></r><r><t>lo</t></r></si></sst>")
        lines = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="s"><v>{k % 2}</v></c></row>' for k in range(1, 30_001))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
    cells = office.read_cells(spark, str(tmp_path))
    row = cells.agg(F.count("*").alias("n"), F.sum("num").alias("s"), F.count_if(F.col("txt") == "lo").alias("no"), F.count_if(F.col("txt") == "llo").alias("wrong"), F.count_if(F.col("txt") == "llo").alias("w"), F.count_if(F.col("txt").isin("he", "llo")).alias("t")).first()
    assert (row["n"], row["s"], row["t"]) == (60_000, 30_000 * 30_001 / 2, 30_000)


def test_slides_in_order_and_runs(spark, tmp_path):
    slide = lambda *texts: '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody>' + "".join("<a:p>" + "".join(f"<a:r><a:t>{t}</a:t></a:r>" for t in p) + "</a:p>" for p in texts) + "</p:txBody></p:sld>"
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r0"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels("slides/slide1.xml", "slides/slide2.xml"))
        z.writestr("ppt/slides/slide1.xml", slide(["Last"]))
        z.writestr("ppt/slides/slide2.xml", slide(["cat and c", "at"], ["cat cat"]))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>A cat</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>dog</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert [r["text"] for r in office.read_slides(spark, str(tmp_path)).orderBy("slide", "paragraph").collect()] == ["cat and cat", "cat cat", "Last"]
    runs = office.read_runs(spark, str(tmp_path))
    found = {(r["slide"], r["shape"], r["paragraph"], r["run"]): r["times"] for r in office.find_in_runs(runs, "cat").collect()}
    assert found == {(None, 0, 0, 0): 1, (1, 0, 0, 0): 1, (1, 0, 1, 0): 2}
    changed = office.replace_in_runs(runs, "cat", "dog")
    texts = {(r["slide"], r["paragraph"]): r["text"] for r in office.paragraphs_of(changed).collect()}
    assert texts == {(None, 0): "A dog", (None, 1): "dog", (1, 0): "dog and cat", (1, 1): "dog dog", (2, 0): "Last"} and changed.agg(F.sum("times")).first()[0] == 4


def test_fractions_against_all_denominators(spark):
    r = random.Random(9)
    xs = [0.0, 0.5, -0.25, 1 / 3, 0.999, 0.9999999, 2.0, 1e-7, 0.05, 0.0555, *(r.uniform(-5, 5) for _ in range(300)), *(a / b for a in range(1, 12) for b in range(1, 12))]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for places, code in ((1, "# ?/?"), (2, "# ??/??"), (3, "# ???/???")):
        for q in df.select("x", numfmt.format_number(F.col("x"), code).alias("t")).collect():
            whole, rest = divmod(abs(q["x"]), 1)
            _, d, n = min((round(abs(rest - int(rest * d + 0.5) / d), 12), d, int(rest * d + 0.5)) for d in range(1, 10**places))
            whole += n == d
            want = f"{int(whole)}" if n in (0, d) else f"{n}/{d}" if not whole else f"{int(whole)} {n}/{d}"
            assert q["t"] == ("-" if q["x"] < 0 else "") + want, (q["x"], code)
