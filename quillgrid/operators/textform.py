"""The line-oriented text form of cells, checks of a sheet, and edits that apply all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.cells import Cell, number_text
from quillgrid.functions.logic import column_letters
from quillgrid.operators.reshape import upsert


def reference(row: Column, col: Column) -> Column:
    """A1 text of a row and column number."""
    return F.concat(column_letters(Cell("num", col.cast("double"))).value, row.cast("string"))


_LOOKS = r"^(?i:true|false|<empty>|[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[=#\"].*|\s.*|.*\s)$"


def encode(cells: DataFrame) -> Column:
    """A cell's text: formulas with =, numbers, TRUE and FALSE, errors with #, text quoted where it would read as
    another kind, and <empty> for empty text."""
    t = F.col("txt")
    escaped = F.replace(F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    needs = t.rlike(_LOOKS) | t.contains("\n") | t.contains("\r") | t.contains('"')
    return (
        F.when(F.col("formula").isNotNull(), F.concat(F.lit("="), F.col("formula")))
        .when(F.col("err").isNotNull(), F.col("err"))
        .when(F.col("num").isNotNull(), number_text(F.col("num")))
        .when(F.col("bool").isNotNull(), F.when(F.col("bool"), "true").otherwise("false"))
        .when(t == "", "<empty>")
        .otherwise(F.when(needs, quoted).otherwise(t))
    )


def derive_lines(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, line): `A1: value` for each cell, in row-major order."""
    line = F.concat(reference(F.col("row"), F.col("col")), F.lit(": "), encode(cells))
    return cells.select("sheet", "row", "col", line.alias("line")).orderBy("sheet", "row", "col")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(sheet, line) -> cells. Values read in this order: <empty>, =formula, "quoted", true/false, #error, number, text."""
    ref = F.regexp_extract("line", r"^([A-Z]{1,3})(\d+): ", 1)
    col = F.aggregate(F.split(ref, ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    value = F.regexp_replace("line", r"^[A-Z]{1,3}\d+: ", "")
    body = F.expr("substring(value, 2, length(value) - 2)")
    body = F.replace(F.replace(F.replace(F.replace(F.replace(body, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\u0001"), F.lit("\\"))
    v = F.col("value")
    is_formula, is_quoted = v.startswith("="), v.rlike(r'(?s)^".*"$')
    is_bool, is_error = F.lower(v).isin("true", "false"), v.startswith("#")
    number = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double"))
    kind = F.when(v == "<empty>", "s").when(is_formula, "f").when(is_quoted, "s").when(is_bool, "b").when(is_error, "e").when(number.isNotNull(), "n").otherwise("s")
    parsed = lines.select("sheet", F.regexp_extract("line", r"^[A-Z]{1,3}(\d+): ", 1).try_cast("long").alias("row"), col.alias("col"), value.alias("value")).withColumn("kind", kind)
    k = F.col("kind")
    return parsed.select(
        "sheet", "row", "col", "kind", F.when(k == "n", number).alias("num"),
        F.when(k == "s", F.when(v == "<empty>", "").when(is_quoted, body).otherwise(v)).alias("txt"),
        F.when(k == "b", F.lower(v) == "true").alias("bool"), F.when(k == "e", v).alias("err"), F.when(k == "f", F.expr("substring(value, 2)")).alias("formula"),
    )


def checksum(lines: DataFrame) -> DataFrame:
    """(sheet, checksum): order-free sum of the lines' hashes, to guard an apply against a changed sheet."""
    return lines.groupBy("sheet").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).cast("string")), 256).alias("checksum"))


def apply_guarded(cells: DataFrame, changes: DataFrame, expected: DataFrame) -> DataFrame:
    """cells with changes put in their places on the sheets that are as `expected` (sheet, checksum) says; changes of a
    sheet that was altered since, or that `expected` does not name, are not applied."""
    same = checksum(derive_lines(cells)).join(expected, ["sheet", "checksum"], "left_semi").select("sheet")
    return upsert(cells, changes.join(same, "sheet", "left_semi"))


def lint_references(formulas: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet, row, col, code): formulas that name a sheet that is not there, or whose quotes or brackets do not close."""
    named = formulas.withColumn("named", F.regexp_extract_all("formula", F.lit(r"(?:'((?:[^']|'')+)'|([A-Za-z_][\w.]*))!"), F.lit(0)))
    each = named.select("sheet", "row", "col", F.explode("named").alias("n")).withColumn("target", F.replace(F.regexp_replace("n", r"^'|'?!$", ""), F.lit("''"), F.lit("'")))
    missing = each.join(sheets.select(F.col("sheet").alias("target")).distinct(), "target", "left_anti")
    plain = F.regexp_replace("formula", r'"(?:[^"]|"")*"', "")
    closed = F.length(F.regexp_replace(plain, r"[^(]", "")) == F.length(F.regexp_replace(plain, r"[^)]", ""))
    broken = formulas.where(~closed | plain.contains('"')).select("sheet", "row", "col", F.lit("broken_formula_syntax").alias("code"))
    return missing.select("sheet", "row", "col", F.lit("broken_sheet_ref").alias("code")).distinct().unionByName(broken)


_AREA = r"^\$?[A-Za-z]{1,3}\$?[1-9]\d*(:\$?[A-Za-z]{1,3}\$?[1-9]\d*)?$"


def _target(column: str) -> tuple[Column, Column]:
    """Sheet and area of `Sheet!A1:B2`."""
    sheet = F.regexp_extract(column, r"^('(?:[^']|'')+'|[^!']+)!(.*)$", 1)
    plain = F.when(sheet.startswith("'"), F.replace(F.expr("substring(sheet_raw, 2, length(sheet_raw) - 2)"), F.lit("''"), F.lit("'"))).otherwise(sheet)
    return plain, F.regexp_extract(column, r"^('(?:[^']|'')+'|[^!']+)!(.*)$", 2)


def _with_target(df: DataFrame, column: str, sheets: DataFrame) -> DataFrame:
    sheet, area = _target(column)
    raw = df.withColumn("sheet_raw", F.regexp_extract(column, r"^('(?:[^']|'')+'|[^!']+)!(.*)$", 1))
    named = raw.withColumn("target_sheet", sheet).withColumn("target_area", area)
    known = sheets.select(F.col("sheet").alias("known_sheet")).distinct()
    return named.join(known, named["target_sheet"] == known["known_sheet"], "left")


def lint_names(names: DataFrame, sheets: DataFrame) -> DataFrame:
    """(name, code) of defined names (name, target) whose target is no range of a sheet that is there."""
    found = _with_target(names, "target", sheets)
    code = F.when(F.col("target_sheet") == "", "named_range_not_a1_range").when(F.col("known_sheet").isNull(), "named_range_missing_sheet")
    code = code.when(~F.col("target_area").rlike(_AREA), "named_range_invalid_range")
    return found.select("name", code.alias("code")).where("code IS NOT NULL")


def lint_pivots(pivots: DataFrame, fields: DataFrame, sheets: DataFrame, headers: DataFrame) -> DataFrame:
    """(pivot, field, code) of pivots (pivot, source) whose source is no range of a sheet that is there, and of their
    fields (pivot, field, role) that are not among the source's headers (sheet, header); role value marks value fields."""
    found = _with_target(pivots, "source", sheets)
    code = F.when(F.col("target_sheet") == "", "pivot_source_invalid").when(F.col("known_sheet").isNull(), "pivot_source_missing_sheet")
    judged = found.withColumn("code", code.when(~F.col("target_area").rlike(_AREA), "pivot_source_range_invalid"))
    bad = judged.where("code IS NOT NULL").select("pivot", F.lit(None).cast("string").alias("field"), "code")
    asked = judged.where("code IS NULL").select("pivot", F.col("target_sheet").alias("sheet")).join(fields, "pivot")
    missing = asked.join(headers.select("sheet", F.col("header").alias("field")).distinct(), ["sheet", "field"], "left_anti")
    lost = F.when(F.col("role") == "value", "pivot_value_missing_header").otherwise("pivot_field_missing_header")
    return bad.unionByName(missing.select("pivot", "field", lost.alias("code")))


def replace_counted(paragraphs: DataFrame, old: str, new: str, text: str = "text") -> DataFrame:
    """paragraphs of documents or slides with every occurrence replaced, and `replaced`, their number in each."""
    plain = F.replace(F.col(text), F.lit(old), F.lit(""))
    n = F.coalesce((F.length(text) - F.length(plain)) / len(old), F.lit(0)).cast("long")
    return paragraphs.withColumn("replaced", n).withColumn(text, F.replace(F.col(text), F.lit(old), F.lit(new)))


def anchored(items: DataFrame) -> DataFrame:
    """(path, item, anchor, text) of a document's body (path, item, kind, row, col, text): paragraphs are [p1], [p2], ...
    and tables [t1], ..., each numbered by itself within its document."""
    table = F.col("kind") == "cell"
    each = items.groupBy("path", "item").agg(F.max(table).alias("table"), F.sort_array(F.collect_list(F.struct("row", "col", "text"))).alias("cells"))
    order = Window.partitionBy("path", "table").orderBy("item")  # the items of one document
    number = F.row_number().over(order).cast("string")
    lines = F.array_join(F.transform("cells", lambda c: c["text"]), "\t")
    return each.select("path", "item", F.concat(F.lit("["), F.when(F.col("table"), "t").otherwise("p"), number, F.lit("]")).alias("anchor"), lines.alias("text"))


def lint_cache(df: DataFrame, stored: str, computed: Column, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored value differs from the computed one by more than the tolerance."""
    return df.where(F.abs(F.col(stored) - computed) > tolerance)


def lint_report(findings: DataFrame, errors: list[str]) -> DataFrame:
    """(error_count, warning_count, is_clean) of findings with a `code`."""
    bad = F.col("code").isin(errors)
    return findings.agg(F.count_if(bad).alias("error_count"), F.count_if(~bad).alias("warning_count"), (F.count("*") == 0).alias("is_clean"))


def lint_edits(edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edit, code): edits whose id is malformed, has no node, or has several."""
    found = nodes.groupBy("id").agg(F.count("*").alias("n"))
    joined = edits.join(found, "id", "left")
    code = F.when(~F.col("id").rlike(r"^[A-Za-z]+[\w/:.\-]*$"), "invalid_id").when(F.col("n").isNull(), "missing_target").when(F.col("n") > 1, "ambiguous_anchor")
    return joined.select("edit", code.alias("code")).where("code IS NOT NULL")


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """nodes (id, text) with edits (id, text, group) applied; a group applies only if all its ids exist. Of several
    edits of one id the last by `edit` counts, if the edits have that column, else the greatest text."""
    known = edits.join(nodes.select("id", F.lit(True).alias("there")).distinct(), "id", "left")
    whole = known.groupBy("group").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole")).where("whole").select("group")
    chosen = edits.join(whole, "group", "left_semi").groupBy("id").agg((F.max_by("text", "edit") if "edit" in edits.columns else F.max("text")).alias("new_text"))
    return nodes.join(chosen, "id", "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
