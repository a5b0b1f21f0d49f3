"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of short keys are computed per document; a table's key is a pair, one key from each collection, so
TABLES_PER_SIDE ** 2 tables need only 2 * TABLES_PER_SIDE short keys. A document's keys that no other document has in
the same place are dropped before any pair is formed: most documents end there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import wordhash
from quillgrid.llm.components import connected_components
from quillgrid.llm.tables import bounded_batches, release, stage

#: Short keys in each of the two collections, and minhashes in a short key. At a similarity of 0.85 a pair shares no
#: table with a probability of about 3e-4; at 0.9, of about 1e-6.
TABLES_PER_SIDE, ROWS = 12, 4
#: Members of a block: a family of no more is one group, and two blocks of a larger one are. A block has as many members
#: as hold BLOCK_ITEMS shingles (16 MB in a group of two), within these bounds.
LEAST_BLOCK, MOST_BLOCK, BLOCK_ITEMS = 64, 1024, 1 << 20
#: Heads that a member of a large family is first compared with.
HEADS = 2
_SEEDS = wordhash.mix(np.arange(1, 2 * TABLES_PER_SIDE * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_SKETCH = "doc_id long, n_shingles long, set_key binary, keys array<long>"


def minhash_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Short keys of each text (rows; all texts have at least one shingle)."""
    out = np.empty((len(begin) - 1, 2 * TABLES_PER_SIDE), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for side in range(2 * TABLES_PER_SIDE):
            key = np.full(len(begin) - 1, side + 1, dtype=np.uint64)
            for row in range(ROWS):
                low = np.minimum.reduceat(values * _SEEDS[side * ROWS + row], begin[:-1])
                key = wordhash.mix(key ^ low)
            out[:, side] = key
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, offsets = wordhash.utf8(batch.column(1))
        for i, j in wordhash.pieces(offsets):
            hashes, _, _, firsts = wordhash.words(data, offsets[i : j + 1])
            values, begin = wordhash.shingles(hashes, firsts)
            number, marks, full = [], [], np.flatnonzero(np.diff(begin))
            for k in range(j - i):
                own = np.unique(values[begin[k] : begin[k + 1]])
                number.append(len(own))
                marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            keys: list = [None] * (j - i)
            if len(full):
                found = minhash_keys(values, np.append(begin[full], begin[-1])).view(np.int64)
                for k, row in zip(full.tolist(), found, strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(number, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "keys"],
            )


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, keys): size and fingerprint of the set of five-word shingles, and the short keys."""
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(_sketch, _SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = wordhash.utf8(batch.column(3))
        for i, j in wordhash.pieces(offsets):
            hashes, _, _, firsts = wordhash.words(data, offsets[i : j + 1])
            values, begin = wordhash.shingles(hashes, firsts)
            own = [np.unique(values[begin[k] : begin[k + 1]]).view(np.int64) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(own, pa.list_(pa.int64()))],
                names=["doc_id", "family", "large", "items"],
            )


def linked_pairs(sets: list[np.ndarray], threshold: int, rows: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs (i < j) with 100 * intersection >= threshold * union. rows: 0 or 1 by set; only pairs of a 0 and a 1
    are compared then. Intersections are counted by products of the 0/1 incidence matrix, some columns at a time."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * both >= threshold * (len(sets[0]) + len(sets[1]) - both) and (rows is None or rows[0] != rows[1])
        return [(0, 1)] if linked else []
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n))
    width = 8192
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, min(width, int(shared.sum()) - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    hit = np.triu(100 * common >= threshold * union, 1)
    if rows is not None:
        hit &= rows[:, None] != rows[None, :]
    return list(zip(*(x.tolist() for x in np.nonzero(hit)), strict=True))


def _forest(ids: list[int], pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Edges (u, v) to each component's smallest id: at most one for each member."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j, key=lambda k: ids[k])] = min(i, j, key=lambda k: ids[k])
    edges = [(ids[i], ids[root(i)]) for i in range(len(ids)) if root(i) != i]
    return [u for u, _ in edges], [v for _, v in edges]


def _compare(threshold: int):
    """Links of the groups of sorted rows (group, side, doc_id, items). side: 0 or 1 where only sets of different sides
    are compared, -1 where all are. One call reads many groups, as most hold a few sets."""

    def links(held: list[pa.RecordBatch]) -> tuple[list[int], list[int]]:
        ids = [i for x in held for i in x.column(2).to_pylist()]
        if len(ids) < 2:
            return [], []
        side = np.concatenate([x.column(1).to_numpy() for x in held])
        sets = []
        for x in held:
            bounds = np.append(0, np.cumsum(pc.list_value_length(x.column(3)).to_numpy(zero_copy_only=False)))
            flat = x.column(3).flatten().to_numpy()
            sets += [flat[a:b] for a, b in pairwise(bounds.tolist())]
        return _forest(ids, linked_pairs(sets, threshold, None if side[0] < 0 else side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        name = None
        for batch in batches:
            n, names = batch.num_rows, batch.column(0)
            if not n:
                continue
            cuts = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            u, v = [], []
            for low, high in pairwise([0, *cuts.tolist(), n]):
                own = names[low].as_py()
                if own != name and held:
                    for out, more in zip((u, v), links(held), strict=True):
                        out += more
                    held = []
                name = own
                held.append(batch.slice(low, high - low))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(held)], names=["u", "v"])

    return run


_GROUP = ("family", "one", "two", "low", "high")


def _links(rows: DataFrame, threshold: int) -> DataFrame:
    """rows (doc_id, *_GROUP, side, items) -> (u, v): links within each group. Groups are of bounded size."""
    named = rows.select(F.concat_ws("/", *_GROUP).alias("group"), "side", "doc_id", "items")
    return named.repartition("group").sortWithinPartitions("group").mapInArrow(_compare(threshold), "u long, v long")


def candidate_families(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """reps (doc_id, keys) -> (doc_id, family): documents that share a table, directly or over others; (doc_id, head):
    the HEADS table heads (a table's smallest doc_id) that a document shares most tables with; and (key, doc_id): the
    members of all tables of two or more."""
    n = TABLES_PER_SIDE
    short = reps.select("doc_id", F.posexplode("keys").alias("place", "key"))  # a key's hash holds its place
    often = stage(short.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "short-keys")
    alive = stage(short.join(often, "key").select("doc_id", "key", "place"), "alive")
    release(often)
    per = alive.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("place") < n, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("place") >= n, F.col("key"))).alias("b")
    )
    pairs = per.select("doc_id", F.explode("a").alias("x"), "b").select("doc_id", "x", F.explode("b").alias("y"))
    formed = stage(pairs.select("doc_id", F.xxhash64("x", "y").alias("key")), "formed")
    first = stage(formed.groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v"), "table-heads")
    tables = stage(formed.join(first, "key").select("key", "doc_id", "v"), "tables")
    release(alive, formed, first)
    stars = stage(tables.where("doc_id <> v").groupBy(F.col("doc_id").alias("u"), "v").agg(F.count("*").alias("n")), "stars")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "v")))), 1, HEADS)  # at most one for each table
    heads = stage(stars.groupBy(F.col("u").alias("doc_id")).agg(best.alias("best")).select("doc_id", F.explode("best.v").alias("head")), "star-heads")
    families = connected_components(stars.select("u", "v"))
    release(stars)
    return families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), heads, tables.select("key", "doc_id")


def _by_heads(asked: DataFrame) -> DataFrame:
    """asked (doc_id, family, head, block) -> (doc_id, *_GROUP, side): every member beside its heads, each head's members in blocks."""
    dealt = stage(asked.groupBy("family", "head").agg(F.ceil(F.count("*") / F.first("block")).cast("int").alias("blocks")), "heads")
    named = F.col("head").cast("string")
    points = asked.join(dealt, ["family", "head"]).select("doc_id", "family", "head", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("low"), F.lit(1).alias("side"))
    centres = dealt.select(F.col("head").alias("doc_id"), "family", "head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low"), F.lit(0).alias("side"))
    return points.unionByName(centres).select("doc_id", F.col("family").cast("string").alias("family"), named.alias("one"), named.alias("two"), "low", F.lit(-1).alias("high"), "side")


def _scopes(named: DataFrame, tables: DataFrame | None) -> DataFrame:
    """named (doc_id, family, component, block), of the families beyond one block -> the same, where `family` names a group
    whose unlinked pairs are still to be compared.

    A group is a family or a table of it. Tables that are linked up already need nothing more, and of tables of the same
    members one is enough. A family is compared table by table where that moves fewer sets than the whole of it would,
    as in a long chain of chance candidates: so the sets moved never exceed the members of the tables.
    """
    whole = named.select("doc_id", F.concat(F.lit("f"), F.col("family")).alias("family"), "component", "block")
    if tables is None:
        return whole
    held = stage(tables.join(named, "doc_id").select("key", "doc_id", "family", "component", "block"), "large-tables")
    one, two = F.bit_xor(F.xxhash64("doc_id")), F.bit_xor(F.xxhash64("doc_id", F.lit(1)))
    per = held.groupBy("key").agg(F.count("*").alias("n"), F.min("family").alias("family"), F.min("block").alias("block"), F.min("component").alias("a"), F.max("component").alias("b"), one.alias("x"), two.alias("y"))
    open_tables = stage(per.where("a < b").groupBy("family", "block", "n", "x", "y").agg(F.min("key").alias("key")), "open-tables")
    by_table = open_tables.groupBy("family").agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.col("block"))).alias("of_tables"))
    by_whole = named.groupBy("family").agg((F.count("*") * F.ceil(F.count("*") / F.first("block"))).alias("of_whole"))
    chosen = stage(by_table.join(by_whole, "family").select("family", (F.col("of_tables") < F.col("of_whole")).alias("split")), "choices")
    in_tables = held.join(open_tables.select("key"), "key").join(chosen.where("split").select("family"), "family")
    in_whole = named.join(chosen.where("NOT split").select("family"), "family").select("doc_id", F.concat(F.lit("f"), F.col("family")).alias("family"), "component", "block")
    return in_tables.select("doc_id", F.concat(F.lit("t"), F.col("key")).alias("family"), "component", "block").unionByName(in_whole)


def _between(named: DataFrame) -> DataFrame:
    """named (doc_id, family, component, block) -> (doc_id, *_GROUP, side): all pairs of a family that are not in one
    component.

    A component of more than a block's members is a unit dealt into blocks of its own, the others form a unit of mixed
    blocks. Blocks of two units meet, and mixed blocks each other; blocks of one component never do, so a large group
    of linked copies costs its size times the few blocks that are not linked with it.
    """
    pure = named.groupBy("family", "component").agg(F.count("*").alias("n"), F.first("block").alias("block")).where("n > block").select("family", "component", F.lit(True).alias("pure"))
    unit = F.when(F.col("pure"), F.col("component").cast("string")).otherwise(F.lit("mixed"))
    placed = stage(named.join(stage(pure, "linked-units"), ["family", "component"], "left").select("doc_id", "family", "block", unit.alias("unit")), "unit-members")
    units = stage(placed.groupBy("family", "unit").agg(F.ceil(F.count("*") / F.first("block")).cast("int").alias("blocks")), "units")
    one = units.select("family", F.col("unit").alias("one"), F.col("blocks").alias("of_one"))
    two = units.select("family", F.col("unit").alias("two"), F.col("blocks").alias("of_two"))
    met = one.join(two, "family").where("one < two OR (one = two AND one = 'mixed')")
    roles = met.select("family", "one", "two", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("unit"), F.col("of_one").alias("own"), F.col("of_two").alias("copies"), F.lit(-1).alias("side")))).otherwise(
        F.array(F.struct(F.col("one").alias("unit"), F.col("of_one").alias("own"), F.col("of_two").alias("copies"), F.lit(0).alias("side")), F.struct(F.col("two").alias("unit"), F.col("of_two").alias("own"), F.col("of_one").alias("copies"), F.lit(1).alias("side"))),
    )).alias("role")).select("family", "one", "two", "role.*")
    copied = placed.join(roles, ["family", "unit"]).withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int"))
    copied = copied.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    low = F.when(F.col("side") == 0, F.col("at")).when(F.col("side") == 1, F.col("mate")).otherwise(F.least("at", "mate"))
    high = F.when(F.col("side") == 0, F.col("mate")).when(F.col("side") == 1, F.col("at")).otherwise(F.greatest("at", "mate"))
    side = F.when(F.col("side") >= 0, F.col("side")).when(F.col("at") == F.col("mate"), F.lit(-1)).otherwise((F.col("at") > F.col("mate")).cast("int"))
    return copied.select("doc_id", "family", "one", "two", low.alias("low"), high.alias("high"), side.alias("side"))


def confirmed_components(members: DataFrame, sets: DataFrame, families: DataFrame, heads: DataFrame, threshold: int, tables: DataFrame | None = None) -> DataFrame:
    """members (doc_id, family, large, items), sets (doc_id, items) of those in large families, families (doc_id, family,
    large, block), heads (doc_id, family, head) and tables (key, doc_id) -> (doc_id, component) over the confirmed links.

    All members of a family of at most a block (large is false) are compared with each other in one group, so its sets
    move once. Those of a larger one are first compared with their heads; then only pairs that are not yet in one
    component are (see _scopes). The components are those of comparing all pairs that share a table, and more.
    """
    placed = (F.lit("").alias("one"), F.lit("").alias("two"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(-1).alias("side"))
    whole = members.where("NOT large").select("doc_id", F.col("family").cast("string").alias("family"), *placed, "items")
    links = _links(whole, threshold)
    large = stage(families.where("large").select("doc_id", "family", "block"), "large-members")
    if large.isEmpty():
        return connected_components(links).select(F.col("node").alias("doc_id"), "component")
    asked = stage(heads.join(large, ["doc_id", "family"]).select("doc_id", "family", "head", "block"), "asked-heads")
    by_heads = _by_heads(asked).join(sets, "doc_id").select("doc_id", *_GROUP, "side", "items")
    found = connected_components(links.unionByName(_links(by_heads, threshold)))
    named = stage(large.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("component"), "block"), "named")
    rest = _between(_scopes(named, tables)).join(sets, "doc_id").select("doc_id", *_GROUP, "side", "items")
    more = _links(rest, threshold)
    known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return connected_components(known.unionByName(more)).select(F.col("node").alias("doc_id"), "component")


def sized(families: DataFrame) -> DataFrame:
    """families (doc_id, family, n_items) -> (doc_id, family, large, block): the members of the family's blocks, and
    whether it has more than one block."""
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.floor(F.lit(BLOCK_ITEMS) / F.max("n_items")))).cast("int")
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), block.alias("block"))
    return stage(families.join(sizes, "family").select("doc_id", "family", (F.col("n") > F.col("block")).alias("large"), "block"), "families")


def near_duplicates(docs: DataFrame, threshold: int = 80, text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= threshold * |A | B| for their sets of five-word shingles. Equal sets are
    one node. Candidates share a table; they are then compared on their full sets, in groups of bounded size
    dealt over all tasks, but for pairs already linked over others. Documents
    without words are linked with nothing. A row without doc_id is counted but linked with nothing, and its
    component_id is null. Rows that repeat a doc_id are one document.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = stage(sketches(docs), "sketches")
    usable = seen.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    reps = stage(usable.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_items")), "sets")
    found, heads, tables = candidate_families(reps)
    families = sized(found.join(reps.select("doc_id", "n_items"), "doc_id"))
    heads = heads.join(families, "doc_id").select("doc_id", "family", "head")
    members = stage(docs.join(families, "doc_id").select("doc_id", "family", "large", "text").mapInArrow(_sets, "doc_id long, family long, large boolean, items array<long>"), "members")
    components = confirmed_components(members, members.where("large").select("doc_id", "items"), families, heads, threshold, tables)
    named = stage(reps.select("set_key", "doc_id").join(components, "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component")), "named-sets")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = seen.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").withColumn("component_id", found)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id. Rows without doc_id stay; of rows that
    repeat a doc_id one stays."""
    judged = stage(near_duplicates(docs, threshold).where("doc_id IS NOT NULL").select("doc_id", "kept"), "judged")
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    # A large corpus loses more ids than can be broadcast: the texts move once, whatever the size.
    left = docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    counts = judged.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if counts["n"] == counts["ids"]:
        return left
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(left.where("doc_id IS NULL"))
