"""With how many rectangles each one has a cell in common, without forming the pairs.

Rectangles are numbered by sheet and id and cut into chunks of consecutive numbers. Two rectangles of a chunk meet in halves:
all of a block's first half are asked of its second half at once, down to blocks small enough to compare outright. The later
chunks of a sheet come to an earlier one as counts of equal rectangles, in pieces. Who meets whom is counted by sorting: all, less
those that end before or begin behind in either direction, and those that do both are added again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.positions import kept, numbered

_BOUNDS = ["top", "left", "bottom", "right"]
#: Rectangles of a chunk, at least and at most: a task holds one chunk and one piece of counts. There are PARTS chunks between.
LEAST, MOST, PARTS, PIECE = 50_000, 400_000, 32, 100_000
#: Rectangles that are compared outright.
FEW = 256
#: Rows of different sheets are that far apart.
_APART = 1 << 40


def _before(px, py, weights, qx, qy):
    """For each asked (qx, qy) the sums of the points' weights with px < qx and py < qy."""
    some = (px < qx.max()) & (py < qy.max())
    px, py, weights = px[some], py[some], weights[:, some]
    found = np.zeros((len(weights), len(qx)), dtype=np.int64)
    if not len(px):
        return found
    ys, rank = np.unique(py, return_inverse=True)
    xs, place = np.unique(px, return_inverse=True)
    asked = np.searchsorted(ys, qy)
    if len(xs) * len(ys) <= max(1 << 16, 64 * len(px)):  # running sums over the grid of their coordinates
        at = np.searchsorted(xs, qx)
        for out, w in zip(found, weights, strict=True):
            grid = np.zeros((len(xs) + 1, len(ys) + 1), dtype=np.int64)
            np.add.at(grid, (place + 1, rank + 1), w)
            out += grid.cumsum(axis=0).cumsum(axis=1)[at, asked]
        return found
    # The points before place i in the order of x are, for each bit of i, one block of that many; in the order of (block, y) those asked for are one stretch.
    order = np.argsort(px, kind="stable")
    rank, weights, places = rank[order], weights[:, order], np.arange(len(px))
    until = np.searchsorted(px[order], qx)
    width = len(ys) + 1
    for level in range(len(px).bit_length()):
        mine = np.flatnonzero((until >> level) & 1)
        if not len(mine):
            continue
        key = (places >> level) * width + rank
        by = np.argsort(key, kind="stable")
        block = ((until[mine] >> level) - 1) * width
        low, high = np.searchsorted(key[by], block), np.searchsorted(key[by], block + asked[mine])
        for out, w in zip(found, weights, strict=True):
            sums = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(w[by])))
            out[mine] += sums[high] - sums[low]
    return found


def _meeting(asks, points, weights):
    """For each asked rectangle (columns top, left, bottom, right) the sums of the weights of those that it meets."""
    top, left, bottom, right = asks
    p_top, p_left, p_bottom, p_right = points
    found = np.repeat(weights.sum(axis=1)[:, None], len(top), axis=1)
    # Each way to miss: a point's value below an asked one. Not both of a pair can be: the first two, the last two.
    rows, columns = [(p_bottom, top), (-p_top, -bottom)], [(p_right, left), (-p_left, -right)]
    for value, limit in rows + columns:
        if value.min() < limit.max():
            by = np.argsort(value, kind="stable")
            until = np.searchsorted(value[by], limit)
            for out, w in zip(found, weights, strict=True):
                out -= np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(w[by])))[until]
    for x, qx in rows:
        for y, qy in columns:
            found += _before(x, y, weights, qx, qy)
    return found


def _later(own, ids):
    """For each rectangle of a chunk how many later ones it meets, and the sum of their ids."""
    n = len(ids)
    weights = np.stack((np.ones(n, dtype=np.int64), ids))
    found = np.zeros((2, n), dtype=np.int64)
    for start in range(0, n, FEW):
        block = slice(start, start + FEW)
        top, left, bottom, right = own[:, block]
        meet = (top[:, None] <= bottom) & (top <= bottom[:, None]) & (left[:, None] <= right) & (left <= right[:, None])
        found[:, block] += weights[:, block] @ np.triu(meet, 1).T.astype(np.int64)
    size = FEW
    while size < n:
        for start in range(0, n - size, 2 * size):
            first, second = slice(start, start + size), slice(start + size, start + 2 * size)
            found[:, first] += _meeting(own[:, first], own[:, second], weights[:, second])
        size *= 2
    return found


_FLAT = ["chunk", "side", "number", "first", *_BOUNDS, "n", "total"]
_COUNTED = "number long, n long, total long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by (chunk, side, number): of each chunk first its rectangles (side 0; total is the id), then the counts
    of equal later ones -> a row for each rectangle that meets a later one."""
    chunk, asks, points, held = None, [], [], 0
    sheets = own = numbers = found = None

    def placed(rows):
        """Bounds with sheets apart; a later rectangle's sheet is one of the chunk's."""
        bounds = rows[:, 4:8].T.copy()
        bounds[[0, 2]] += np.searchsorted(sheets, rows[:, 3]) * _APART
        return bounds

    def begin():
        nonlocal sheets, own, numbers, found, asks
        rows = np.concatenate(asks)
        asks = []
        sheets, numbers = np.unique(rows[:, 3]), rows[:, 2]
        own = placed(rows)
        found = _later(own, rows[:, 9])

    def met():
        nonlocal points, held
        rows = np.concatenate(points)
        points, held = [], 0
        found[:] += _meeting(own, placed(rows), rows[:, 8:10].T)

    def end():
        if asks:
            begin()
        if points:
            met()
        some = found[0] > 0
        columns = [pa.array(x[some]) for x in (numbers, found[0], found[1])]
        return pa.Table.from_arrays(columns, names=["number", "n", "total"]).to_batches(max_chunksize=10_000)

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _FLAT], axis=1)
        cuts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
        for part in np.split(rows, cuts):
            if not len(part):
                continue
            if part[0, 0] != chunk:
                if chunk is not None:
                    yield from end()
                chunk = part[0, 0]
            if part[0, 1] == 0:
                asks.append(part)
                continue
            if asks:
                begin()
            points.append(part)
            held += len(part)
            if held >= PIECE:
                met()
    if chunk is not None:
        yield from end()


def overlap_counts(rectangles: DataFrame, chunk: int | None = None) -> DataFrame:
    """(sheet, id, n, others): with how many rectangles of a larger id (a whole number) each has a cell in common, and the
    sum of their ids; the counts of the pairs that `rectangles.overlapping` lists. chunk: rectangles a task compares."""
    own = rectangles.where("sheet IS NOT NULL AND id IS NOT NULL AND top <= bottom AND left <= right").select("sheet", F.col("id").cast("long").alias("id"), *[F.col(c).cast("long").alias(c) for c in _BOUNDS])
    placed = kept(numbered(own, [F.col("sheet"), F.col("id")], "number"), "numbered")
    rows = placed.count()
    size = chunk or min(MOST, max(LEAST, rows // PARTS))
    of = lambda c: F.floor((F.col(c) - 1) / size).cast("long")
    spans = placed.groupBy("sheet").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    at = placed.join(spans, "sheet").withColumn("chunk", of("number"))
    asks = at.select("chunk", F.lit(0).cast("long").alias("side"), "number", "first", *_BOUNDS, F.lit(1).cast("long").alias("n"), F.col("id").alias("total"))
    equal = at.where(of("last") > of("first")).groupBy("chunk", "first", *_BOUNDS).agg(F.count("*").alias("n"), F.sum("id").alias("total"))
    earlier = equal.where(F.col("chunk") > of("first")).withColumn("chunk", F.explode(F.sequence(of("first"), F.col("chunk") - 1)))
    points = earlier.groupBy("chunk", "first", *_BOUNDS).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    points = points.select("chunk", F.lit(1).cast("long").alias("side"), F.lit(0).cast("long").alias("number"), "first", *_BOUNDS, "n", "total")
    dealt = asks.unionByName(points).repartition(max(1, min(4096, -(-rows // size))), "chunk").sortWithinPartitions("chunk", "side", "number")
    found = kept(dealt.select(*_FLAT).mapInArrow(_chunks, _COUNTED), "overlaps").join(placed.select("sheet", "id", "number"), "number").drop("number")
    # Rectangles of one id are no pair, but have been counted where they meet.
    repeated = kept(placed.groupBy("sheet", "id").agg(F.count("*").alias("areas")).where("areas > 1").drop("areas"), "repeated")
    if repeated.limit(1).count():
        some = placed.join(repeated, ["sheet", "id"])
        other = some.select("sheet", "id", *[F.col(c).alias(f"other_{c}") for c in ("number", *_BOUNDS)])
        same = some.join(other, ["sheet", "id"]).where("number < other_number AND top <= other_bottom AND other_top <= bottom AND left <= other_right AND other_left <= right")
        found = found.unionByName(same.select("sheet", "id", F.lit(-1).cast("long").alias("n"), (-F.col("id")).alias("total")))
    return found.groupBy("sheet", "id").agg(F.sum("n").alias("n"), F.sum("total").alias("others")).where("n > 0")
