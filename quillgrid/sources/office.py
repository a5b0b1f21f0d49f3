"""Readers of office files: each zip package is one row of Spark's binaryFile source and is opened inside a task.

Files are read in parallel over the cluster, by any path Spark can read; a file has to fit in a task's memory, as its
format is an archive.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from posixpath import join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELLS = "path string, sheet string, row long, col int, kind string, num double, txt string, bool boolean, err string, formula string"
#: Rows of a file that a task holds at a time.
CHUNK = 20_000
_OLE = bytes([0xD0, 0xCF, 0x11, 0xE0, 0xA1, 0xB1, 0x1A, 0xE1])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _each(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if bytes(content[:8]) == _OLE:
                    continue  # an encrypted or old binary file has no parts
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    found = iter(rows(path, package))
                    while chunk := list(islice(found, CHUNK)):
                        yield pd.DataFrame(chunk, columns=names).astype(object).where(lambda f: f.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def parts(spark: SparkSession, path: str, glob: str = "*.{xlsx,docx,pptx}") -> DataFrame:
    """(path, part, size): the parts of every package, by name."""
    return _each(_files(spark, path, glob), "path string, part string, size long", lambda p, z: [(p, i.filename, i.file_size) for i in sorted(z.infolist(), key=lambda i: i.filename)])


def part_content(spark: SparkSession, path: str, part: str, glob: str = "*.{xlsx,docx,pptx}") -> DataFrame:
    """(path, part, content): the bytes of one part of every package that has it."""
    return _each(_files(spark, path, glob), "path string, part string, content binary", lambda p, z: [(p, part, z.read(part))] if part in z.namelist() else [])


def relationships(spark: SparkSession, path: str, glob: str = "*.{xlsx,docx,pptx}") -> DataFrame:
    """(path, source, id, type, target): all relations between parts."""

    def rows(p, z):
        for name in z.namelist():
            if name.endswith(".rels"):
                folder, _, base = name.rpartition("_rels/")
                for r in ElementTree.fromstring(z.read(name)):
                    yield p, folder + base.removesuffix(".rels"), r.get("Id"), r.get("Type", "").rpartition("/")[2], r.get("Target")

    return _each(_files(spark, path, glob), "path string, source string, id string, type string, target string", rows)


def _target(source: str, target: str) -> str:
    """The part that a relation of `source` (empty for the package) points to."""
    return normpath(join("/", source.rpartition("/")[0], target)).lstrip("/")


def part_graph(spark: SparkSession, path: str, glob: str = "*.{xlsx,docx,pptx}") -> DataFrame:
    """(path, part, depth, parents): every part of each package with its least number of steps from the package (NULL if
    it cannot be reached) and the parts that point to it, by name ("" is the package itself). Targets are taken from where
    their source stands; external ones and those that are no part are left out. A package's graph is one task's work, as
    its file is; cycles end, since a part is entered once."""

    def rows(p, z):
        names = [n for n in z.namelist() if not n.endswith("/")]
        known, points = set(names), {}
        for name in names:
            if name.endswith(".rels") and "_rels/" in name:
                folder, _, base = name.rpartition("_rels/")
                source = folder + base.removesuffix(".rels")
                found = {_target(source, r.get("Target", "")) for r in ElementTree.fromstring(z.read(name)) if r.get("TargetMode") != "External"}
                points[source] = sorted(found & known)
        parents: dict[str, list[str]] = {}
        for source in sorted(points):
            for target in points[source]:
                parents.setdefault(target, []).append(source)
        depth, front = {"": 0}, [""]
        while front:
            front = sorted({t for s in front for t in points.get(s, []) if t not in depth})
            depth.update(dict.fromkeys(front, 1 + max(depth.values())))
        for name in sorted(n for n in names if not n.endswith(".rels") and n != "[Content_Types].xml"):
            yield p, name, depth.get(name), parents.get(name, [])

    return _each(_files(spark, path, glob), "path string, part string, depth int, parents array<string>", rows)


def properties(spark: SparkSession, path: str, glob: str = "*.{xlsx,docx,pptx}") -> DataFrame:
    """(path, name, value): core, extended and custom properties."""

    def rows(p, z):
        for name in ("docProps/core.xml", "docProps/app.xml"):
            if name in z.namelist():
                for node in ElementTree.fromstring(z.read(name)):
                    if node.text:
                        yield p, _local(node.tag), node.text
        if "docProps/custom.xml" in z.namelist():
            for node in ElementTree.fromstring(z.read("docProps/custom.xml")):
                yield p, node.get("name"), "".join(node.itertext())

    return _each(_files(spark, path, glob), "path string, name string, value string", rows)


def encrypted(spark: SparkSession, path: str) -> DataFrame:
    """(path, encrypted): whether a file is an OLE container, as encrypted packages are; only eight bytes are compared."""
    files = _files(spark, path, "*")
    return files.select("path", (F.hex(F.substring("content", 1, 8)) == _OLE.hex().upper()).alias("encrypted"))


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _nodes(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag in a part, read as a stream: each is emptied once it has been used."""
    with z.open(name) as file:
        events = ElementTree.iterparse(file, events=("start", "end"))
        path = []
        for event, node in events:
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if _local(node.tag) == tag:
                yield node
                node.clear()
                if path:  # let go of it, not only of what it held
                    path[-1].remove(node)
            elif path and _local(node.tag) == "row":
                path[-1].remove(node)


def _sheet_rows(p: str, z: zipfile.ZipFile):
    shared = [_text(s) for s in _nodes(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): _target("xl/workbook.xml", r.get("Target", "")) for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    for sheet in (n for n in book.iter() if _local(n.tag) == "sheet"):
        part = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        for node in _nodes(z, part, "c"):
            m = re.match(r"([A-Z]+)(\d+)$", node.get("r", ""))
            if not m:
                continue
            kind, value, formula = node.get("t", "n"), None, None
            for child in node:
                tag = _local(child.tag)
                if tag == "v":
                    value = child.text
                elif tag == "f":
                    formula = child.text
                elif tag == "is":
                    value = _text(child)
            if kind == "s" and value is not None:
                value = shared[int(value)]
            if value is None and formula is None:
                continue
            number = float(value) if kind == "n" and value is not None else None
            text = value if kind in ("s", "str", "inlineStr", "d") else None
            yield (
                p, sheet.get("name"), int(m[2]), _column(m[1]), {"n": "n", "b": "b", "e": "e"}.get(kind, "s"), number, text,
                value == "1" if kind == "b" else None, value if kind == "e" else None, formula,
            )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of every .xlsx file under path: path and the columns of a cell table."""
    return _each(_files(spark, path, "*.xlsx"), _CELLS, _sheet_rows)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, item, kind, row, col, text): the body of every .docx file in order: paragraphs, and table cells with their
    row and column (from 0)."""

    def rows(p, z):
        body = next(n for n in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(n.tag) == "body")
        for i, node in enumerate(n for n in body if _local(n.tag) in ("p", "tbl")):
            if _local(node.tag) == "p":
                yield p, i, "paragraph", None, None, _text(node)
                continue
            for r, line in enumerate(n for n in node if _local(n.tag) == "tr"):
                for c, held in enumerate(n for n in line if _local(n.tag) == "tc"):
                    yield p, i, "cell", r, c, "\n".join(_text(x) for x in held if _local(x.tag) == "p")

    return _each(_files(spark, path, "*.docx"), "path string, item long, kind string, row long, col long, text string", rows)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, author, date, text): the comments of every .docx file."""

    def rows(p, z):
        if "word/comments.xml" in z.namelist():
            for node in ElementTree.fromstring(z.read("word/comments.xml")):
                if _local(node.tag) == "comment":
                    text = "\n".join(_text(x) for x in node if _local(x.tag) == "p")
                    yield p, _attribute(node, "id"), _attribute(node, "author"), _attribute(node, "date"), text

    return _each(_files(spark, path, "*.docx"), "path string, id string, author string, date string, text string", rows)


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The slides' parts in the order of the presentation; by file number where it does not say."""
    numbered = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    book, relations = "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"
    if book not in z.namelist() or relations not in z.namelist():
        return numbered
    targets = {r.get("Id"): _target(book, r.get("Target", "")) for r in ElementTree.fromstring(z.read(relations))}
    ids = [next((v for k, v in n.attrib.items() if k.endswith("}id")), None) for n in ElementTree.fromstring(z.read(book)).iter() if _local(n.tag) == "sldId"]
    return [targets[i] for i in ids if targets.get(i) in z.namelist()] or numbered


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """(path, slide, shape, paragraph, text): the paragraphs of every .pptx file's shapes, slides (in the order of the
    presentation) from 1, others from 0."""

    def rows(p, z):
        for number, name in enumerate(_slides(z), 1):
            shapes = [n for n in ElementTree.fromstring(z.read(name)).iter() if _local(n.tag) == "txBody"]
            for s, shape in enumerate(shapes):
                for k, paragraph in enumerate(n for n in shape if _local(n.tag) == "p"):
                    yield p, number, s, k, _text(paragraph)

    return _each(_files(spark, path, "*.pptx"), "path string, slide long, shape long, paragraph long, text string", rows)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(path, slide, shape, paragraph, run, text): the runs of every .pptx and .docx file with their places. Slides count
    from 1, the rest from 0; a .docx file has no slides, one shape (0), and all its paragraphs in order, those of tables too."""

    def runs(p, slide, shape, paragraphs):
        for k, paragraph in enumerate(paragraphs):
            for r, run in enumerate(n for n in paragraph.iter() if _local(n.tag) == "r"):
                yield p, slide, shape, k, r, _text(run)

    def rows(p, z):
        if "word/document.xml" in z.namelist():
            yield from runs(p, None, 0, (n for n in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(n.tag) == "p"))
        for number, name in enumerate(_slides(z), 1):
            for s, shape in enumerate(n for n in ElementTree.fromstring(z.read(name)).iter() if _local(n.tag) == "txBody"):
                yield from runs(p, number, s, (n for n in shape if _local(n.tag) == "p"))

    return _each(_files(spark, path, "*.{docx,pptx}"), "path string, slide long, shape long, paragraph long, run long, text string", rows)


def find_in_runs(runs: DataFrame, wanted: str) -> DataFrame:
    """The runs that hold a text (with case), with the number of times: what lies across two runs is in neither."""
    n = (F.length("text") - F.length(F.replace("text", F.lit(wanted), F.lit("")))) / len(wanted)
    return runs.where(F.contains("text", F.lit(wanted))).withColumn("times", n.cast("long"))


def replace_in_runs(runs: DataFrame, old: str, new: str) -> DataFrame:
    """runs with a text replaced inside each run, and the number of replacements as `times`."""
    n = (F.length("text") - F.length(F.replace("text", F.lit(old), F.lit("")))) / len(old)
    return runs.withColumn("times", n.cast("long")).withColumn("text", F.replace("text", F.lit(old), F.lit(new)))


def paragraphs_of(runs: DataFrame) -> DataFrame:
    """(path, slide, shape, paragraph, text): the runs put together again."""
    told = runs.groupBy("path", "slide", "shape", "paragraph").agg(F.sort_array(F.collect_list(F.struct("run", "text"))).alias("runs"))
    return told.select("path", "slide", "shape", "paragraph", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"))
