"""Embedding whitening by TSQR: the right singular vectors of the centred rows, without their covariance.

The rows to fit on are the distinct ones, as whole numbers, so their sums are exact. Each partition reduces its centred
rows to one triangular factor, the factors are merged eight at a time in a tree, and the last one, as wide as a vector,
gives the components. No task holds more than a batch of rows and eight factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import bounded_batches, release, stage

COMPONENTS = 16
#: An entry c becomes floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Larger products STEPS * c are taken as this, so that sums and products stay exact.
LARGEST = float(1 << 40)
#: Parts that one task merges.
FAN = 8
#: Standard deviations under this part of the largest count as none: rounding leaves as much.
RANK_TOLERANCE = 1e-10
OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fitted rows, right vectors (a row each) and eigenvalues, explained shares and the largest
    deviation of the whitened rows' covariance from the identity."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def quantised(vector: str = "embedding") -> Column:
    """The vector as whole numbers; NULL if it is null or holds null, infinite or undefined entries."""
    # NaN is above all numbers and so is infinity, so one comparison finds null entries, infinities and NaN.
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT
    return F.when(sound, F.transform(vector, scaled))


def _rows(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, subtracted as whole numbers before the division."""
    return _spread(x, n, sums).astype(np.float64) / n


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in long arithmetic where all of it fits, else in Python's whole numbers."""
    if x.size and max(int(x.max()), -int(x.min()), 1) * n < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - sums


def _partials(batches: Iterator[pa.RecordBatch], start: Callable[[], object], add: Callable, pack: Callable, dimension: int) -> Iterator[pa.RecordBatch]:
    """One (part, payload) row for a task that has rows."""
    state, some = start(), False
    for batch in batches:
        if batch.num_rows:
            state, some = add(state, _rows(batch, dimension)), True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(state)], pa.binary())], names=["part", "payload"])


def _tree(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes:
    """The payloads of (part, payload) merged FAN at a time, in the order of part, until one is left."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN], "payload": [merge(list(frame["payload"]))]})

    live = stage(parts, "parts")
    last = live.agg(F.max("part").alias("part")).first()["part"]
    while last > 0:
        merged = stage(live.groupBy(F.shiftright("part", FAN.bit_length() - 1).alias("group")).applyInPandas(one, "part long, payload binary"), "parts")
        release(live)
        live, last = merged, last // FAN
    out = bytes(live.first()["payload"])
    release(live)
    return out


def _whole(values: np.ndarray) -> bytes:
    return b",".join(str(int(v)).encode() for v in values)


def _sums(fit: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """Exact number of rows and sums of each dimension."""
    start = lambda: np.zeros(dimension + 1, dtype=object)
    add = lambda s, x: s + np.array([len(x), *x.sum(axis=0).tolist()], dtype=object)
    parse = lambda b: np.array([int(v) for v in b.split(b",")], dtype=object)
    parts = fit.mapInArrow(partial(_partials, start=start, add=add, pack=_whole, dimension=dimension), "part long, payload binary")
    total = parse(_tree(parts, lambda each: _whole(sum(map(parse, each)))))
    return int(total[0]), total[1:]


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def _right_factor(fit: DataFrame, dimension: int, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangular factor of all centred rows."""
    add = lambda r, x: _factor([r, _centred(x, n, sums)])
    parse = lambda b: np.frombuffer(b).reshape(-1, dimension)
    step = partial(_partials, start=lambda: np.zeros((0, dimension)), add=add, pack=lambda r: np.ascontiguousarray(r).tobytes(), dimension=dimension)
    parts = fit.mapInArrow(step, "part long, payload binary")
    return parse(_tree(parts, lambda each: np.ascontiguousarray(_factor([parse(b) for b in each])).tobytes()))


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and summed products about the mean of two blocks together."""
    n = a[0] + b[0]
    if not n:
        return a
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _identity_error(fit: DataFrame, dimension: int, model: Whitening) -> float:
    """Largest entry of |covariance of the whitened rows - identity|, measured on them; each block is centred first."""
    k = len(model.values)

    def block(x: np.ndarray) -> tuple:
        w = project(x, model)
        mean = w.mean(axis=0)
        return len(w), mean, (w - mean).T @ (w - mean)

    pack = lambda s: np.concatenate(([float(s[0])], s[1], s[2].ravel())).tobytes()

    def parse(b: bytes) -> tuple:
        v = np.frombuffer(b)
        return v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)

    def merge(each: list[bytes]) -> bytes:
        out = parse(each[0])
        for b in each[1:]:
            out = _joined(out, parse(b))
        return pack(out)

    step = partial(_partials, start=lambda: (0.0, np.zeros(k), np.zeros((k, k))), add=lambda s, x: _joined(s, block(x)), pack=pack, dimension=dimension)
    n, _, products = parse(_tree(fit.mapInArrow(step, "part long, payload binary"), merge))
    return float(np.abs(products / n - np.eye(k)).max()) if k else 0.0


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """The whitened rows."""
    return _centred(x, model.n, model.sums) @ model.vectors.T / np.sqrt(model.values)


def dimension_of(vectors: DataFrame, vector: str = "embedding") -> int | None:
    """The most frequent length (of equally frequent ones the least) of the vectors that hold only numbers; None without any."""
    lengths = vectors.select(F.size(quantised(vector)).alias("d")).where("d > 0").groupBy("d").agg(F.count("*").alias("n"))
    row = lengths.orderBy(F.desc("n"), "d").first()
    return row["d"] if row else None


def fit(vectors: DataFrame, dimension: int, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """The whitening of the distinct vectors of that dimension: their first components by falling eigenvalue, fewer if
    the vectors span fewer dimensions."""
    x = bounded_batches(vectors).select(quantised(vector).alias("x")).where(F.size("x") == dimension)
    distinct = stage(x.groupBy("x").agg(F.count("*").alias("n")).select("x"), "vectors")
    n, sums = _sums(distinct, dimension)
    factor = _right_factor(distinct, dimension, n, sums)
    _, spread, right = np.linalg.svd(factor, full_matrices=False)
    values = spread**2 / n
    k = int((spread[:components] > RANK_TOLERANCE * max(float(spread[0]), 1e-300)).sum()) if len(spread) else 0
    total = float(values.sum())
    model = Whitening(n, sums, right[:k], values[:k], values[:k] / total if k else values[:0])
    error = _identity_error(distinct, dimension, model)
    release(distinct)
    return Whitening(n, sums, model.vectors, model.values, model.explained, error)


def _whiten(batches: Iterator[pa.RecordBatch], model: Whitening, dimension: int) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch in batches:
        if not batch.num_rows or not k:
            continue
        x = _rows(batch, dimension)
        spread = _spread(x, model.n, model.sums)
        near = spread.dtype != object and float((spread.astype(np.float64) ** 2).sum(axis=1).max()) < 2.0**62
        deviation = (spread * spread).sum(axis=1) if near else [sum(int(v) ** 2 for v in row) for row in spread]
        deviation = pa.array([int(v) if int(v) < 1 << 63 else None for v in deviation], pa.int64())
        of = pa.array(np.repeat(np.arange(len(x)), k))
        each = lambda v, kind: pa.array(np.tile(np.asarray(v), len(x)), kind)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i).take(of) for i in range(batch.num_columns - 1)), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(of), model.n), pa.int64()),
                deviation.take(of), pa.array(project(x, model).ravel()), each(model.explained, pa.float64()), pa.array(np.full(len(of), model.identity_error)),
            ],
            names=[*batch.schema.names[:-1], "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Rows whose vector is null, empty, or holds null, infinite or undefined entries have no row; nor have those of another
    length than most vectors. Repeated rows count once in the fit and are all returned, rows with a null key too. Where
    all vectors are equal, or there are none, nothing can be whitened and the result is empty; components without spread
    are left out. Of equal eigenvalues either order may come. Entries beyond 2^40 / 64 count as that. A deviation beyond
    a long is NULL.
    """
    vectors = bounded_batches(vectors)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, {OUTPUT}"
    plain = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    dimension = dimension_of(plain, "vector")
    if dimension is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    model = fit(plain, dimension, components, "vector")
    rows = plain.select("key", quantised("vector").alias("x")).where(F.size("x") == dimension)
    return rows.mapInArrow(partial(_whiten, model=model, dimension=dimension), schema).withColumnRenamed("key", key)
