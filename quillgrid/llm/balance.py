"""Cost-balanced packing: sequences without padding whose attention costs are levelled.

A piece of n tokens costs 6 * width * n (projections and feed-forward layers) plus n * n (attention within the piece).
Pieces go, longest first, to the cheapest sequence that has room for them; a piece that no sequence has room for is cut to
fill the roomiest ones. As many sequences are opened as the tokens fill exactly, so nothing is padded.

Lengths are at most the capacity, so the corpus is described by a histogram of that many counts, and sequences of one
state are one class with a count. The plan moves whole classes: its work depends on the capacity, not on the corpus.
Executors then place every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillgrid.llm.packing import CAPACITY, encoder
from quillgrid.llm.tables import bounded_batches, stage

END_ID = 0
#: Width of the model whose costs are levelled.
WIDTH = 1024
#: Tokens of one Arrow batch of pieces, about.
BATCH_TOKENS = 1 << 20
#: Earlier counts of a (task, length) are broadcast up to so many rows of 24 bytes, and joined by a shuffle beyond.
BROADCAST_ROWS = 300_000
_TOKENS = "doc_id long, part int, nth long, start long, length int, doc_tokens long, ids binary"


def cost(length: int, width: int = WIDTH) -> int:
    """Attention cost of a piece: linear in its tokens plus quadratic."""
    return 6 * width * length + length * length


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Every document's ids and end_id in pieces of at most `capacity` (columns as in _TOKENS). `nth` counts the pieces of
    a length within a task, `part` is the task. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, seen = encoder(tokenizer_path), int(end_id).to_bytes(4, "little"), Counter()
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ["doc_id", "part", "nth", "start", "length", "doc_tokens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.token_bytes(body.as_py() or "") + end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    length = min(capacity, n - at)
                    rows.append((doc_id, part, seen[length], at, length, n, data[4 * at : 4 * (at + length)]))
                    seen[length] += 1
                    held += length
                    if held >= BATCH_TOKENS:
                        yield out()
                        rows, held = [], 0
        yield out()

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, _TOKENS)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """[(length, first rank, end rank, start in the piece, tokens, first sequence, offset, cost of the sequence)]: every
    token of the counted pieces exactly once.

    There are total // capacity sequences of `capacity` tokens, and for the rest one for each power of two in it. Of the
    pieces, longest first, each goes to the cheapest sequence with room for it. If none has room for a length, a piece
    of it fills the roomiest sequence (of these the cheapest), and what is left of it comes up again as a shorter one.
    """
    total = sum(k * n for k, n in histogram.items())
    full, rest = divmod(total, capacity)
    rooms = [(capacity, full)] * (full > 0) + [(1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    # Sequences of one state: (cost, first sequence, count, capacity). The cheapest class that has room for the current
    # length is on top of `open_`; the others wait under their room.
    open_: list[tuple[int, int, int, int, int]] = []
    waiting: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for size, count in rooms:
        waiting.setdefault(size, []).append((0, first, count, size))
        first += count
    blocks = [(-length, length, 0, count, 0) for length, count in histogram.items() if count]  # (-tokens, length, rank, count, start)
    heapq.heapify(blocks)
    taken, closed, level = [], {}, capacity + 1

    def put(spent: int, at: int, count: int, size: int, room: int, tokens: int) -> None:
        if room == 0:
            closed[at] = (count, spent)
        elif room >= tokens:
            heapq.heappush(open_, (spent, at, count, size, room))
        else:
            heapq.heappush(waiting.setdefault(room, []), (spent, at, count, size))

    while blocks:
        minus, length, rank, count, start = heapq.heappop(blocks)
        tokens = -minus
        for room in range(tokens, level):  # lengths fall, so what waits may fit again
            for spent, at, number, size in waiting.pop(room, ()):
                heapq.heappush(open_, (spent, at, number, size, room))
        level = min(level, tokens)
        if open_:
            spent, at, number, size, room = heapq.heappop(open_)
            filled = tokens
        else:
            room = max(waiting)
            spent, at, number, size = heapq.heappop(waiting[room])
            if not waiting[room]:
                del waiting[room]
            filled = room
        moved = min(count, number)
        taken.append((length, rank, rank + moved, start, filled, at, size - room))
        if moved < number:
            put(spent, at + moved, number - moved, size, room, tokens)
        put(spent + cost(filled, width), at, moved, size, room - filled, tokens)
        if moved < count:
            heapq.heappush(blocks, (minus, length, rank + moved, count - moved, start))
        if filled < tokens:
            heapq.heappush(blocks, (filled - tokens, length, rank, moved, start + filled))
    # A class may have been split after it took a piece; its parts can end at different costs.
    begins = sorted(closed)
    out = []
    for length, low, high, start, filled, at, offset in taken:
        k = int(np.searchsorted(begins, at, side="right")) - 1
        while low < high:
            number, spent = closed[begins[k]]
            step = min(high - low, begins[k] + number - at)
            out.append((length, low, low + step, start, filled, at, offset, spent))
            low, at, k = low + step, at + step, k + 1
    return out


class _Slots:
    """The plan of one length: ranks fall into intervals, each with the same pieces."""

    def __init__(self, rows: np.ndarray) -> None:
        self.begins = np.unique(rows[:, 1:3])
        low, high = np.searchsorted(self.begins, rows[:, 1]), np.searchsorted(self.begins, rows[:, 2])
        spans = high - low
        of = np.repeat(np.arange(len(rows)), spans)
        interval = np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(low, spans)
        order = np.lexsort((rows[of, 3], interval))
        self.rows, self.first = rows[of[order]], np.searchsorted(interval[order], np.arange(len(self.begins) + 1))

    def find(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the rank, the plan's row) for each piece."""
        interval = np.searchsorted(self.begins, ranks, side="right") - 1
        number = self.first[interval + 1] - self.first[interval]
        of = np.repeat(np.arange(len(ranks)), number)
        at = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + self.first[interval][of]
        return of, self.rows[at]


def _finder(steps: np.ndarray) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The plan as an Arrow UDF: (length, rank) -> [(start, tokens, sequence_id, offset, sequence_cost)]. The ids stay with Spark."""
    slots: dict[int, _Slots] = {}
    names = ["start", "tokens", "sequence_id", "offset", "sequence_cost"]

    def find(length: pa.Array, rank: pa.Array) -> pa.Array:
        if not slots:
            order = np.argsort(steps[:, 0], kind="stable")
            keys, at = np.unique(steps[order, 0], return_index=True)
            slots.update((int(k), _Slots(rows)) for k, rows in zip(keys, np.split(steps[order], at[1:]), strict=True))
        lengths, ranks = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        row, planned = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 8), dtype=np.int64)]
        by = np.argsort(lengths, kind="stable")
        keys, at = np.unique(lengths[by], return_index=True)
        for k, mine in zip(keys, np.split(by, at[1:]), strict=False):
            of, found = slots[int(k)].find(ranks[mine])
            row.append(mine[of])
            planned.append(found)
        row, planned = np.concatenate(row), np.concatenate(planned)
        order = np.argsort(row, kind="stable")
        row, planned = row[order], planned[order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ranks))))).astype(np.int32)
        columns = [planned[:, 3], planned[:, 4], planned[:, 5] + ranks[row] - planned[:, 1], planned[:, 6], planned[:, 7]]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names))

    return find


def balanced(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, sequence_cost, ids): the packed pieces of all documents; ids are
    little-endian unsigned 32-bit.

    Documents longer than `capacity` are cut there; others only where a piece fits whole into no sequence. An empty table
    gives an empty result; repeated rows are packed as often as they occur, rows with a null doc_id too; null or empty
    text is the end id alone; of equal lengths the order is that of the tasks. A very long text is one task's work, in
    batches of about a million tokens.
    """
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, tokenizer_path, capacity, end_id), "token-pieces")
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    steps = np.array(plan(histogram, capacity, width), dtype=np.int64).reshape(-1, 8)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    find = arrow_udf(_finder(steps), "array<struct<start: long, tokens: long, sequence_id: long, offset: long, sequence_cost: long>>")
    ranked = pieces.join(before, ["part", "length"]).withColumn("slot", F.explode(find("length", F.col("before") + F.col("nth"))))
    return ranked.select(
        "doc_id", (F.col("start") + F.col("slot.start")).alias("start"), F.col("slot.tokens").alias("length"), "doc_tokens", "slot.sequence_id", "slot.offset", "slot.sequence_cost",
        F.expr("substring(ids, int(4 * slot.start + 1), int(4 * slot.tokens))").alias("ids"),
    )
