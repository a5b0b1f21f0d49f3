"""Repeated passages: MinHash banding over paragraphs and windows, confirmed by exact Jaccard, clustered by components.

Every paragraph (line) of five words or more is a unit. Passages also repeat in the middle of paragraphs, so all texts are cut at content-defined places as well: windows of WINDOW words begin at the smallest
shingle hash of every SPREAD places in a row. Two documents that share a passage of WINDOW + SPREAD - 1 words or more
therefore have a window at the same words of it, wherever it stands. Confirmed units are then extended word by word as
far as the two copies agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgrid.llm import wordhash
from quillgrid.llm.neardup import confirmed_components, sized
from quillgrid.llm.tables import bounded_batches, release, stage

#: Words of a window, and places in a row at one of which a window begins.
WINDOW, SPREAD = 25, 20
SPAN = WINDOW - wordhash.SHINGLE + 1
#: Bands of a paragraph and of a window, and minhashes in each. Equal units always collide; at a similarity of 0.8 two
#: paragraphs collide with a probability of 0.943 and two windows with 0.76: a passage has several windows.
BANDS, WINDOW_BANDS, ROWS = 4, 2, 3
SIMILARITY = 0.8
#: Words that the first round of the extension looks at.
STEP = 64
#: A place is a unit's first word times this, plus its number of words.
_PLACE = 1 << 28
_FACTOR = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_FACTOR), -1, 2**64))
_SEEDS = wordhash.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def anchors(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into values where windows begin, index of their text). values and begin as from wordhash.shingles.

    A window begins at the least shingle of every SPREAD places in a row where one fits, or of all such places if there
    are fewer; of a run of equal shingles only the first counts. A text of fewer than WINDOW words has none.
    """
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    places = np.flatnonzero(np.arange(len(values)) + SPAN <= begin[owner + 1])
    if not len(places):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    own, of = values[places], owner[places]
    found = []
    if len(places) >= SPREAD:
        inside = of[: len(of) - SPREAD + 1] == of[SPREAD - 1 :]
        least = np.argmin(sliding_window_view(own, SPREAD), axis=1) + np.arange(len(own) - SPREAD + 1)
        found.append(least[inside])
    texts, first, size = np.unique(of, return_index=True, return_counts=True)
    few = np.flatnonzero(size < SPREAD)
    found.append(np.array([first[k] + int(np.argmin(own[first[k] : first[k] + size[k]])) for k in few], dtype=np.int64))
    at = np.unique(np.concatenate(found))
    again = (at > 0) & (own[at] == own[at - 1]) & (of[at] == of[at - 1])
    at = at[~again]
    return places[at], of[at]


def paragraphs(part: np.ndarray, starts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, number of words, index of the text) of the lines of SHINGLE words or more. part holds the
    texts' bytes, starts and firsts are as from wordhash.words."""
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    line = np.searchsorted(np.flatnonzero(part == 0x0A), starts)
    fresh = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))))
    size = np.diff(np.append(fresh, len(starts)))
    enough = size >= wordhash.SHINGLE
    return fresh[enough], size[enough], owner[fresh[enough]]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(shingles of all texts, index of each unit's first shingle, its number of shingles, its text, its first word, number
    of windows: they come first)."""
    hashes, starts, _, firsts = wordhash.words(data, offsets)
    values, begin = wordhash.shingles(hashes, firsts)
    at, row = anchors(values, begin)
    word, size, owner = paragraphs(data[int(offsets[0]) : int(offsets[-1])], starts, firsts)
    position = word - firsts[owner]
    at = np.concatenate((at, begin[owner] + position))
    number = np.concatenate((np.full(len(row), SPAN, dtype=np.int64), size - wordhash.SHINGLE + 1))
    row = np.concatenate((row, owner))
    return values, at, number, row, at - begin[row], len(row) - len(word)


def _ends(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(at), dtype=np.int64)
    out[0::2], out[1::2] = at, at + number
    return out


def _bands(values: np.ndarray, at: np.ndarray, number: np.ndarray, bands: range) -> np.ndarray:
    """A key of each unit (columns) for each band (rows)."""
    out = np.empty((len(bands), len(at)), dtype=np.uint64)
    if not len(at):
        return out
    ends = _ends(at, number)
    guarded = np.append(values, np.uint64(np.iinfo(np.uint64).max))  # reduceat wants every index inside
    with np.errstate(over="ignore"):
        for k, band in enumerate(bands):
            key = np.full(len(at), band + 1, dtype=np.uint64)
            for row in range(ROWS):
                low = np.minimum.reduceat(guarded * _SEEDS[band * ROWS + row], ends)[0::2]
                key = wordhash.mix(key ^ low)
            out[k] = key
    return out


def _whole(values: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of each unit's shingles in order."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    out = np.empty((2, len(at)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, (up, down) in enumerate(((_FACTOR, _BACK), (_FACTOR * _FACTOR, _BACK * _BACK))):
            steps = np.full(len(values) + 1, up, dtype=np.uint64)
            steps[0] = 1
            sums = np.append(np.uint64(0), np.cumsum(values * np.multiply.accumulate(steps)[:-1]))
            steps[1:] = down
            out[k] = (sums[at + number] - sums[at]) * np.multiply.accumulate(steps)[at]
        return wordhash.mix(wordhash.mix(out[0]) ^ (out[1] + number.astype(np.uint64)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = wordhash.utf8(batch.column(1))
        for i, j in wordhash.pieces(offsets):
            values, at, number, row, position, windows = units(data, offsets[i : j + 1])
            few = _bands(values, at, number, range(WINDOW_BANDS))
            more = _bands(values, at[windows:], number[windows:], range(WINDOW_BANDS, BANDS))
            whole = _whole(values, at, number).view(np.int64)
            place = position * _PLACE + number + wordhash.SHINGLE - 1
            keys = np.concatenate((few.reshape(-1), more.reshape(-1)))
            each = lambda x: np.concatenate((np.tile(x, WINDOW_BANDS), np.tile(x[windows:], BANDS - WINDOW_BANDS)))  # noqa: E731, B023
            columns = [keys.view(np.int64), *map(each, (whole, ids[i:j][row], place))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["key", "node", "doc_id", "place"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the units at the places that are asked for (third column)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = wordhash.utf8(batch.column(1))
        asked = batch.column(2)
        for i, j in wordhash.pieces(offsets):
            hashes, _, _, firsts = wordhash.words(data, offsets[i : j + 1])
            values, begin = wordhash.shingles(hashes, firsts)
            owners, places, items = [], [], []
            for k in range(i, j):
                for place in asked[k].as_py():
                    low = begin[k - i] + place // _PLACE
                    owners.append(ids[k])
                    places.append(place)
                    items.append(np.unique(values[low : min(low + place % _PLACE - wordhash.SHINGLE + 1, begin[k - i + 1])]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(places, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "place", "items"])


def _plain(docs: DataFrame, text: str = "text") -> DataFrame:
    return bounded_batches(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _apart(later: Column, first: Column) -> Column:
    """Whether of two (doc_id, place) the later stands in another document, or in the same one behind the end of the first."""
    behind = F.shiftright(later["place"], 28) >= F.shiftright(first["place"], 28) + first["place"] % _PLACE
    return (later["doc_id"] > first["doc_id"]) | ((later["doc_id"] == first["doc_id"]) & behind)


def repeated_units(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, component_id, removed, equal, mate_id, mate_word, mate_words): the units that occur in
    two documents or more, or at two places of one, each with another unit of its component, an equal one where there is
    one.

    Units are linked if the exact Jaccard similarity of their shingle sets is at least `similarity`; equal units are one
    node. The units that share a band are compared in blocks, so no frequent passage lands in one task. Of a component
    the first unit of its smallest doc_id stays, with what overlaps it there, and the others are to be removed.
    """
    plain = _plain(docs, text)
    keys = plain.mapInArrow(_keys, "key long, node long, doc_id long, place long")
    at = F.struct("doc_id", "place")
    often = keys.groupBy("key").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    often = stage(often.where(_apart(F.col("b"), F.col("a"))).select("key"), "unit-keys")
    hits = stage(keys.join(often, "key").select("key", "node", "doc_id", "place"), "unit-hits")
    release(often)
    held = stage(hits.groupBy("node", "doc_id", "place").agg(F.lit(1).alias("one")).select("node", "doc_id", "place"), "unit-places")
    # Only nodes that share a band with another node need their shingles; equal units are linked as they are. The
    # families to compare are the bands' own: joined over several bands, overlapping windows would chain up. Of bands
    # with the same nodes one is enough.
    shared = stage(hits.groupBy("key", "node").agg(F.min(F.struct("doc_id", "place")).alias("at")), "unit-nodes")
    release(hits)
    one, two = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    mixed = shared.groupBy("key").agg(F.count("*").alias("n"), one.alias("x"), two.alias("y")).where("n > 1")
    mixed = stage(mixed.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "unit-bands")
    compared = stage(shared.join(mixed, "key").select(F.col("node").alias("doc_id"), F.col("key").alias("family"), "at"), "unit-members")
    release(shared, mixed)
    families = sized(compared.select("doc_id", "family", (F.col("at.place") % _PLACE).alias("n_items")))
    places = stage(compared.groupBy(F.col("doc_id").alias("node")).agg(F.min("at").alias("at")).select("node", "at.doc_id", "at.place"), "unit-asked")
    asked = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # at most a document's units
    cut = plain.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(_sets, "doc_id long, place long, items array<long>")
    sets = stage(cut.join(places, ["doc_id", "place"]).select(F.col("node").alias("doc_id"), "items").dropDuplicates(["doc_id"]), "unit-sets")
    members = sets.join(families, "doc_id").select("doc_id", "family", "large", "items")
    least = families.groupBy("family").agg(F.min("doc_id").alias("head"))
    heads = families.join(least, "family").where("large AND doc_id <> head").select("doc_id", "family", "head")
    found = confirmed_components(members, sets, families, heads, round(100 * similarity)).select(F.col("doc_id").alias("node"), "component")
    named = stage(held.join(found, "node", "left").select("node", "doc_id", "place", F.coalesce("component", "node").alias("component_id")), "unit-named")
    release(held, compared, places, sets, families)

    def ends(by: str) -> DataFrame:
        """The first and the last place of each node or component, if they are two."""
        most = named.groupBy(by).agg(F.min(at).alias("a"), F.max(at).alias("b"))
        return stage(most.where(_apart(F.col("b"), F.col("a"))), f"{by}-ends")

    def mate(x: DataFrame) -> Column:
        return F.when(_apart(F.struct("doc_id", "place"), x["a"]), x["a"]).otherwise(x["b"])

    of_all, of_equal = ends("component_id"), ends("node")
    joined = named.join(of_all, "component_id").withColumn("removed", _apart(at, of_all["a"])).withColumn("mate", mate(of_all)).drop("a", "b")
    joined = joined.join(of_equal, "node", "left")
    equal = of_equal["a"].isNotNull()
    joined = joined.select("doc_id", "place", "component_id", "removed", equal.alias("equal"), F.when(equal, mate(of_equal)).otherwise(F.col("mate")).alias("mate"))
    first, number = (lambda c: F.shiftright(c, 28).cast("int")), (lambda c: (F.col(c) % _PLACE).cast("int"))
    return joined.select(
        "doc_id", first("place").alias("first_word"), number("place").alias("n_words"), "component_id", "removed", "equal", F.col("mate.doc_id").alias("mate_id"),
        first("mate.place").alias("mate_word"), number("mate.place").alias("mate_words"),
    )


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of up to `length` words before (nearest first) or from each place that is asked for (third column)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = wordhash.utf8(batch.column(1))
        asked = batch.column(2)
        for i, j in wordhash.pieces(offsets):
            hashes, _, _, firsts = wordhash.words(data, offsets[i : j + 1])
            short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            owners, places, sides, items = [], [], [], []
            for k in range(i, j):
                own = short[firsts[k - i] : firsts[k - i + 1]]
                for x in asked[k].as_py():
                    at = x["at"]
                    owners.append(ids[k])
                    places.append(at)
                    sides.append(x["after"])
                    items.append(own[at : at + length] if x["after"] else own[max(0, at - length) : at][::-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(places, pa.int32()), pa.array(sides, pa.bool_()), pa.array(items, pa.list_(pa.int32()))], names=["doc_id", "at", "after", "context"]
            )


def _agreeing(a: str, b: str) -> Column:
    """Number of leading elements that two arrays have in common."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), F.lit(True))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _merged(spans: DataFrame) -> DataFrame:
    """spans (doc_id, removed, first_word, end, n_units, component_id, ...) with `run`: overlapping or touching spans of
    a document, alike in being removed or kept, have the same number."""
    order = Window.partitionBy("doc_id", "removed").orderBy("first_word", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("first_word") > before).cast("int"), F.lit(1))
    return spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def _extended(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (doc_id, removed, run, after, at, mate_id, mate_at, room) -> (doc_id, removed, run, after, more): the number
    of words, `room` at most, by which the run goes on before or after `at` as its mate does. The first
    round looks at STEP words, each further one at four times as many, of the runs that have not come to an end."""
    plain, live, done = _plain(docs), stage(edges.where("room > 0").withColumn("more", F.lit(0)), "edges"), []
    length = STEP
    while not live.isEmpty():
        asked = live.select("doc_id", "at", "after").union(live.select("mate_id", "mate_at", "after")).distinct()
        asked = stage(asked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "after")).alias("asked")), "edges-asked")
        found = stage(plain.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(partial(_contexts, length=length), "doc_id long, at int, after boolean, context array<int>").dropDuplicates(["doc_id", "at", "after"]), "contexts")
        mates = found.select(F.col("doc_id").alias("mate_id"), F.col("at").alias("mate_at"), "after", F.col("context").alias("other"))
        met = live.join(found, ["doc_id", "at", "after"]).join(mates, ["mate_id", "mate_at", "after"]).withColumn("step", _agreeing("context", "other")).drop("context", "other")
        met = stage(met.withColumn("more", F.least(F.col("more") + F.col("step"), F.col("room"))), "edges-met")
        release(asked, found, live)
        on = (F.col("step") == length) & (F.col("more") < F.col("room"))
        done.append(met.where(~on).select("doc_id", "removed", "run", "after", "more"))
        move = F.when(F.col("after"), F.col("step")).otherwise(-F.col("step"))
        moved = met.where(on).select("doc_id", "removed", "run", "after", (F.col("at") + move).alias("at"), "mate_id", (F.col("mate_at") + move).alias("mate_at"), "room", "more")
        live = stage(moved, "edges")
        length *= 4
    out = live.select("doc_id", "removed", "run", "after", "more")
    for each in done:
        out = out.unionByName(each)
    return out


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, first_word, last_word, n_words, n_windows, component_id, removed): the stretches of words that repeat in
    another document, or in the same one. Overlapping or touching units of a document are joined where they are alike in being removed or
    kept, and extended on both sides as far as their words equal those around the other document's unit, or up to the
    next stretch. Words count
    from 0, last_word is inside, n_windows is the number of units, and component_id is that of the first. Documents
    that share no passage have no row; null texts have none, and rows of one doc_id count as one document."""
    found = repeated_units(docs, similarity).withColumn("end", F.col("first_word") + F.col("n_words"))
    runs = stage(_merged(found), "runs")
    # The run grows from its outermost units that are equal to their mates, as the places of others may be shifted.
    low = F.struct(F.col("first_word").alias("at"), "mate_id", F.col("mate_word").alias("mate_at"))
    high = F.struct(F.col("end").alias("at"), "mate_id", (F.col("mate_word") + F.col("mate_words")).alias("mate_at"))
    spans = runs.groupBy("doc_id", "removed", "run").agg(
        F.min("first_word").alias("first_word"), F.max("end").alias("end"),
        F.coalesce(F.min(F.when(F.col("equal"), low)), F.min(low)).alias("l"), F.coalesce(F.max(F.when(F.col("equal"), high)), F.max(high)).alias("r"),
        F.count("*").alias("n_units"), F.min_by("component_id", "first_word").alias("component_id"),
    )
    # A run need not grow beyond its neighbour, which goes on from there by itself.
    order = Window.partitionBy("doc_id").orderBy("first_word", "end", "removed")
    far = F.lit(2**30)
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    before, behind = F.coalesce(F.col("first_word") - reached, far), F.coalesce(F.lead("first_word").over(order) - F.col("end"), far)
    spans = spans.withColumn("room_before", before + F.col("l.at") - F.col("first_word")).withColumn("room_behind", behind + F.col("end") - F.col("r.at"))
    spans = stage(spans, "spans")
    left = spans.select("doc_id", "removed", "run", F.lit(False).alias("after"), "l.at", "l.mate_id", "l.mate_at", F.col("room_before").alias("room"))
    right = spans.select("doc_id", "removed", "run", F.lit(True).alias("after"), "r.at", "r.mate_id", "r.mate_at", F.col("room_behind").alias("room"))
    more = _extended(docs, left.unionByName(right)).groupBy("doc_id", "removed", "run").agg(
        F.coalesce(F.max(F.when(~F.col("after"), F.col("more"))), F.lit(0)).alias("before"), F.coalesce(F.max(F.when(F.col("after"), F.col("more"))), F.lit(0)).alias("behind")
    )
    first, end = F.col("l.at") - F.coalesce("before", F.lit(0)), F.col("r.at") + F.coalesce("behind", F.lit(0))
    grown = spans.join(more, ["doc_id", "removed", "run"], "left").select(
        "doc_id", "removed", F.least("first_word", first).alias("first_word"), F.greatest("end", end).alias("end"), "n_units", "component_id"
    )
    joined = _merged(grown).groupBy("doc_id", "removed", "run").agg(
        F.min("first_word").alias("first_word"), (F.max("end") - 1).alias("last_word"), F.sum("n_units").alias("n_windows"), F.min_by("component_id", "first_word").alias("component_id")
    )
    return joined.select("doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), "n_windows", "component_id", "removed")


def remove_passages(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs whose texts lack the words of the passages to be removed (white space before a removed word goes with it);
    all rows and columns stay."""
    spans = repeated_passages(docs, similarity).where("removed").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word"))).alias("spans"))
    spans = stage(spans.select(F.col("doc_id").alias("id"), "spans"), "passage-spans")
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            columns = list(batch.columns)
            gone = columns.pop().to_pylist()
            texts = columns[place].to_pylist()
            for k, own in enumerate(gone):
                if own and texts[k] is not None:
                    at = [m.span() for m in word.finditer(texts[k])]
                    out, low = [], 0
                    for s in own:
                        if s["first_word"] < len(at):  # of another row of the same doc_id
                            out.append(texts[k][low : at[s["first_word"] - 1][1] if s["first_word"] else 0])
                            low = at[min(s["last_word"], len(at) - 1)][1]
                    texts[k] = "".join([*out, texts[k][low:]])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    # Plain names while Python has the rows: those of docs may hold dots.
    plain = [f"c{i}" for i in range(len(names))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, docs.schema, strict=True)])
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans["id"], "left")
    return joined.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(names, plain, strict=True)], spans["spans"].alias("s")).mapInArrow(run, schema).toDF(*names)
