"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are at most the capacity, so the corpus is described by a histogram of that many counts, whatever its size.
The plan is made from the histogram alone: which lengths share a sequence, and how often. Executors then place every
piece by its rank among the pieces of its length; no piece, list of ids or group passes through the driver.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.tables import bounded_batches, parallelism, stage

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


class Encoder:
    """The ids that a tokenizer file of the `tokenizers` library (byte-level BPE) gives, add_special_tokens=False.

    The file's vocabulary runs in `tiktoken`, which is several times as fast on the many rare words; its added tokens
    split a text first, as they do in the library. Tests compare the ids with the library's.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.added = {t["content"]: t["id"] for t in known["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in known["model"]["vocab"].items() if piece not in self.added}
        core = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = core.encode_ordinary
        # Of added tokens at one place the longest is taken.
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def token_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit bytes."""
        if self.splits is None or not self.splits.search(text):
            return self._plain(text)
        parts = self.splits.split(text)
        return b"".join(int(self.added[x]).to_bytes(4, "little") if k % 2 else self._plain(x) for k, x in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        return _bytes(self.encode(text)) if text else b""


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Encoder of a file, one in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """The pieces of every document (columns as in PIECES): its ids and end_id; longer ones are cut into pieces of
    `capacity`, the first one taking the remainder. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.token_bytes(body.as_py() or "") + end
                n = len(data) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if piece == 0 else capacity
                    crc = zlib.crc32(data[4 * at : 4 * (at + length)])
                    for column, value in zip(rows, (doc_id, piece, at, length, crc), strict=True):
                        column.append(value)
                    at, piece = at + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)], using every counted piece exactly once.

    Longest first, a length's gap is filled exactly by a single, pair or triple of available lengths, as often as their
    counts allow (taking the combination with the longest members first). What no combination fills exactly goes by
    best fit: the longest available length that still fits, again and again. The work depends on the number of
    distinct lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        uses = np.bincount(lengths, minlength=capacity + 1)
        times = int(min(left[x] // uses[x] for x in set(lengths)))
        for x in lengths:
            left[x] -= times
        out.append((lengths, times))

    def exact(head: int) -> tuple[int, ...] | None:
        """A combination of one to three further lengths that fills head's gap exactly."""
        gap = capacity - head
        free = left.copy()
        free[head] -= 1
        if gap <= capacity and free[gap] > 0:
            return (head, gap)
        have = np.flatnonzero(free[: gap + 1] > 0)
        have = have[(have > 0)][::-1]
        mates = gap - have
        fits = (mates > 0) & (mates <= have) & (free[mates] > (mates == have))
        if fits.any():
            a = int(have[np.argmax(fits)])
            return (head, a, gap - a)
        for a in have.tolist():
            rest = gap - a
            seconds = have[(have <= a) & (have < rest)]
            thirds = rest - seconds
            fits = (thirds > 0) & (thirds <= seconds)
            need = 1 + (seconds == a)
            fits &= (free[seconds] >= need) & (free[thirds] >= 1 + (thirds == seconds) + (thirds == a))
            if fits.any():
                b = int(seconds[np.argmax(fits)])
                return (head, a, b, rest - b)
        return None

    if left[capacity]:
        take((capacity,))
    for head in range(capacity - 1, 0, -1):
        while left[head] > 0:
            found = exact(head)
            if found is None:
                break
            take(found)
    while True:
        have = np.flatnonzero(left > 0)
        if not len(have):
            return out
        lengths = [int(have[-1])]
        free = left.copy()
        free[lengths[0]] -= 1
        gap = capacity - lengths[0]
        while gap > 0:
            fit = np.flatnonzero(free[: gap + 1] > 0)
            if not len(fit):
                break
            lengths.append(int(fit[-1]))
            free[fit[-1]] -= 1
            gap -= int(fit[-1])
        take(tuple(lengths))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (as from cut; read more than once, so pass a written table) with sequence_id and offset.

    Pieces of one length are dealt out over salts; a rank is the count of earlier salts plus the rank within a salt, so
    no task sees more than one salt of a frequent length. The plan is a table of at most some thousand rows, bounded
    by the capacity.
    """
    spark = parts.sparkSession
    salts = max(16, 4 * parallelism(parts))
    dealt = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, next_id, used = [], 0, dict.fromkeys(histogram, 0)
    for lengths, times in plan(histogram, capacity):
        at = 0
        for length in lengths:
            rows.append((length, used[length], used[length] + times, next_id, at))
            used[length] += times
            at += length
        next_id += times
    slots = spark.createDataFrame(rows, "length long, low long, high long, first_id long, offset long")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    # Each length's slots as one sorted array: a piece finds its slot by its rank.
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first_id", "offset"))).alias("slots"))
    ranked = (
        dealt.withColumn("within", F.row_number().over(within) - 1)
        .join(before.join(F.broadcast(by_length), "length"), ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("within"))
        .withColumn("slot", F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0])
    )
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_id") + F.col("rank") - F.col("slot.low")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )


def best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack every row of docs. An empty table gives an empty result; repeated rows are packed as
    often as they occur; null or empty text is one piece that holds the end id alone."""
    return pack(stage(cut(docs, tokenizer_path, capacity), "pieces"), capacity)
