"""Benchmark decontamination with DataFrame operations only: size-partitioned MinHash containment search.

A short item hides in a long document, so whole-set similarity says nothing; containment of the item does. Items are
partitioned by their number of shingles. In a partition of at most n shingles an item's sketch is its
n - ceil(t * n) + 1 shingles of smallest hash (its bottom-k MinHash). A document that holds the share t of an item
lacks too few of its shingles to miss them all, so the search has no false negatives at any document length. The
documents found are then confirmed by exact containment of the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import stage

SHINGLE = 5
#: Share of an item's shingles that makes a document contaminated.
CONTAINMENT = 0.8
#: Rows of a sketch or item table that are broadcast at most (24 bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words between white space, A-Z lower-cased; none for null or blank text."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """Distinct runs of five words, joined by spaces; the whole sequence if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ws) - SHINGLE + 1), lambda i: F.array_join(F.slice(ws, i, SHINGLE), " "))
    return F.when(F.size(ws) >= SHINGLE, F.array_distinct(runs)).when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def word_hashes(ws: Column) -> Column:
    """xxhash64 of each word."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def shingle_hashes(hs: Column) -> Column:
    """A hash of each run of five words, in order, repeats included, from a column of the words' hashes: so no run is put
    together as text."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hs) - SHINGLE), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(hs) >= SHINGLE, runs).when(F.size(hs) > 0, F.array(F.xxhash64(hs))).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_item, hash, shingle): the shingles of every item with text; rows of one item_id are one item."""
    each = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.explode(shingles(words(F.col("text")))).alias("shingle"))
    each = each.distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("n_item"))
    hashed = each.join(sizes, "item_id").withColumn("hs", word_hashes(F.split("shingle", " ")))
    return hashed.select("item_id", "n_item", F.get(shingle_hashes(F.col("hs")), 0).alias("hash"), "shingle")


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, n_item, hash) of the sketch of each item; the size partitions are the powers of two."""
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double"))))  # of the item's partition
    keep = largest - F.ceil(largest * containment - 1e-9) + 1
    grouped = items.groupBy("item_id", "n_item").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    return grouped.select("item_id", "n_item", F.explode(F.slice("hashes", F.lit(1), keep.cast("int"))).alias("hash"))


def contaminations(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all pairs with n_shared >= containment * n_item.

    Shingles are runs of five words, A-Z lower-cased; an item of fewer words is one shingle and is found only in a
    document of just those words. Items and documents without words match nothing, and rows without doc_id or item_id
    are left out. Rows of one doc_id (or item_id) count as one document (item).
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(words(F.col("text"))).alias("hs"))
    items = stage(item_shingles(benchmark), "items")
    marks = stage(sketches(items, containment), "item-sketches")
    n_items, n_marks = items.count(), marks.count()
    each = rows.select("doc_id", F.explode(shingle_hashes(F.col("hs"))).alias("hash"))
    hits = each.join(_small(marks, n_marks), "hash").select("doc_id", "item_id").distinct()
    candidates = stage(hits, "candidates")
    # Exact: the candidates' texts are cut again, and shingles are compared by their words.
    asked = candidates.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id").select("doc_id", words(F.col("text")).alias("ws"))
    said = texts.select("doc_id", F.explode(shingles(F.col("ws"))).alias("shingle"))
    shared = said.join(_small(items.select("item_id", "n_item", "shingle"), n_items), "shingle").distinct()
    counted = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    found = counted.join(candidates, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") >= F.col("n_item") * containment - 1e-9)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows whose document is contaminated; rows without doc_id stay."""
    leaks = stage(contaminations(docs, benchmark, containment).select(F.col("doc_id").alias("leaking_id")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["leaking_id"], "left_anti")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""
