"""Conversation structure repair: the cheapest edits that make the roles of a conversation read (s?(ua)+)?.

The turns of a conversation are dealt with in segments of at most SEGMENT rows, so that no conversation, however long, is
one task's work: a segment's effect on the cost is a matrix over the four states of the grammar (least cost from the state
it is entered in to the one it is left in), and only segments at the edges of partitions or cut at SEGMENT rows meet those of the same conversation. Going backwards over these gives the cost to go at the end of each segment;
going forwards, the state it is entered in. Within a segment, the same two steps run over its rows.
Rows are handled by their digests; texts are joined again only for the rows that stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.tables import bounded_batches, parallelism, release, stage

#: Rows of a segment at most.
SEGMENT = 20_000
DELETE, RETELL, INSERT, CUT_OFF = 4, 3, 3, 3
#: States by what was said last: nothing yet, the system, the user, the assistant. A conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
_NONE = 1 << 60
_ENDS = (0, _NONE, _NONE, 0)
#: Where a user's or assistant's turn leads to: each state can be followed by one of the two only.
_ONWARD = (USER, USER, ASSISTANT, USER)
_SAYS = {USER: "user", ASSISTANT: "assistant"}
_WHITE = " \t\n\x0b\x0c\r"
#: Codes of at most this length are looked up before they are worked out: short conversations have few patterns.
_SHORT = 64
#: A row's code: its role's letter (o for others), upper case if it is cut off, or - if it must go.
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}


def _with_inserts(costs: list[int]) -> list[int]:
    """Cost to go when turns may first be inserted; two in a row at most, as three lead back to where two did."""
    once = [min(costs[s], INSERT + costs[_ONWARD[s]]) for s in range(4)]
    return [min(once[s], INSERT + once[_ONWARD[s]]) for s in range(4)]


def _row(code: str, after: list[int], state: int) -> dict[str, tuple[int, int]]:
    """{edit: (cost to go with it, state it leads to)} of a row that is not preceded by an insertion."""
    out = {"D": (DELETE + after[state], state)}
    if code != "-":
        extra, role = (CUT_OFF if code.isupper() else 0), code.lower()
        kept = _KEPT.get((state, role))
        if kept is not None:
            out["K"] = (extra + after[kept], kept)
        out["R"] = (RETELL + extra + after[_ONWARD[state]], _ONWARD[state])
    return out


def costs_to_go(codes: str, ends: tuple[int, ...]) -> tuple[tuple[int, ...], ...]:
    """The cost to go in each state before each row and, last, at the end of the codes. Costs of _NONE or more say that
    there is no way."""
    out = [tuple(_with_inserts(list(ends)))]
    for code in reversed(codes):
        after = list(out[-1])
        out.append(tuple(_with_inserts([min(x for x, _ in _row(code, after, s).values()) for s in range(4)])))
    return tuple(reversed(out))


def walk(codes: str, ends: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """(edits, state at the end, cost to go at the beginning): at each step the ASCII-least edit (D, I, K, R) of those that keep the cost least. Turns
    after the last row are inserted only by the last segment; others leave them to the next."""
    go = costs_to_go(codes, ends)
    edits, least = [], go[0][state]
    for i, code in enumerate(codes):
        while True:
            row = _row(code, list(go[i + 1]), state)
            choices = {e: to for e, (spent, to) in row.items() if spent == go[i][state]}
            if INSERT + go[i][_ONWARD[state]] == go[i][state]:
                choices["I"] = _ONWARD[state]
            edit = min(choices)
            edits.append(edit)
            state = choices[edit]
            if edit != "I":
                break
    while last and go[-1][state]:
        edits.append("I")
        state = _ONWARD[state]
    return "".join(edits), state, least


_walk_short = lru_cache(maxsize=50_000)(walk)


def _walk(codes: str, ends: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    return (_walk_short if len(codes) <= _SHORT else walk)(codes, ends, state, last)


def matrix(codes: str) -> list[int]:
    """Least cost from each state (rows) to each other (columns) over the codes, insertions after the last row left out."""
    out = []
    for end in range(4):
        ends = tuple(0 if s == end else _NONE for s in range(4))
        live = list(ends)
        for k, code in enumerate(reversed(codes)):
            after = _with_inserts(live) if k else live
            live = [min(x for x, _ in _row(code, after, s).values()) for s in range(4)]
        out.append(_with_inserts(live) if codes else live)
    return [min(out[end][s], _NONE) for s in range(4) for end in range(4)]


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults by crc32(`conv:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes the
    [.!?] of it, 3 repeats the row, 4 makes it the user's. Nulls are one space, but that of a turn or conv stays null."""
    blank = F.lit(" ")
    c, t, r, x = (F.col(f"`{n}`") for n in (conv, turn, role, text))
    fault = F.crc32(F.concat(F.coalesce(c.cast("string"), blank), F.lit(":"), F.coalesce(t.cast("string"), blank))) % 20
    said, who = F.coalesce(x.cast("string"), blank), F.coalesce(r.cast("string"), blank)
    rows = turns.select(c.alias(conv), t.alias(turn), who.alias(role), said.alias(text), fault.alias("fault number")).where(F.col("`fault number`") != 0)
    f = F.col("`fault number`")
    hurt = F.when(f == 1, "").when(f == 2, F.translate(F.col(f"`{text}`"), ".!?", "")).otherwise(F.col(f"`{text}`"))
    copies = F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col(f"`{conv}`"), F.col(f"`{turn}`"), F.when(f == 4, "user").otherwise(F.col(f"`{role}`")).alias(role), hurt.alias(text), F.explode(copies).alias("copy number")).drop("copy number")


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest): one space for a null role or text."""
    said, who = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" "))
    return turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), who.alias("role"), said.alias("text"), F.unhex(F.md5(said)).alias("digest"))


def _row_key(role: str = "role") -> Column:
    """One value for conv, turn, role and digest together."""
    texts = [F.coalesce(F.col("conv").cast("string"), F.lit("~")), F.coalesce(F.col("turn").cast("string"), F.lit("~")), F.col(role), F.hex("digest")]
    return F.unhex(F.md5(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in texts])))


def _coded(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, copies, letter, fault): equal rows together; fault is that of the first copy: b(lank),
    d(uplicate), t(runcated) or k for none."""
    end = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    kind = F.when(end == "", "b").when(end.isin(".", "!", "?"), "k").otherwise("t")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = turns.select("conv", "turn", "role", "digest", letter.alias("letter"), kind.alias("kind"))
    rows = rows.groupBy("conv", "turn", "role", "digest", "letter", "kind").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = rows.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(place != F.col("first"), F.lit(False))
    fault = F.when(F.col("kind") == "b", "b").when(later, "d").otherwise(F.col("kind"))
    return joined.select("conv", "turn", "role", "digest", "copies", "letter", fault.alias("fault"))


_COUNTS = "blank long, duplicate long, truncated long, low long, high long, n_turns long, illegal long"
_ROWS = "turns array<long>, roles array<string>, digests array<binary>"
_REPAIRED = "array<struct<edit: string, turn: long, role: string, was: string, digest: binary>>"


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> segments. Those that another segment of the same conversation can adjoin are marked as edges."""
    part = TaskContext.get().partitionId()
    names = ["conv", "part", "no", "edge", "codes", "initials", "blank", "duplicate", "truncated", "low", "high", "n_turns", "illegal", "matrix", "turns", "roles", "digests"]
    no, out = 0, []

    def close(conv, rows: list[tuple], edge: bool) -> None:
        nonlocal no
        turns, roles, digests, letters, faults = ([r[k] for r in rows] for k in range(5))
        line, known = "".join(letters), {t for t in turns if t is not None}
        codes = "".join("-" if f in "bd" else x.upper() if f == "t" else x for x, f in zip(letters, faults, strict=True))
        illegal = sum(line[i : i + 2] not in ("su", "ua", "au") for i in range(len(line) - 1))
        counts = (faults.count("b"), faults.count("d"), faults.count("t"), min(known, default=None), max(known, default=None), len(known), illegal)
        out.append((conv, part, no, edge, codes, line[0] + line[-1], *counts, matrix(codes) if edge else None, turns, roles, digests))
        no += 1

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return batch

    conv, rows, held, cut, kind = None, [], 0, False, None
    for batch in batches:
        kind = batch.column(0).type
        for key, turn, role, digest, copies, letter, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and key != conv:
                close(conv, rows, no == 0 or cut)
                rows, cut = [], False
            conv = key
            for copy in range(copies):
                if len(rows) >= most:
                    close(conv, rows, True)
                    rows, cut = [], True
                rows.append((turn, role, digest, letter, fault if fault == "b" or copy == 0 else "d"))
                held += 1
                if held >= most and out:
                    yield flush(kind)
                    held = 0
    if rows:
        close(conv, rows, True)
        yield flush(kind)


def _ends(frame: pd.DataFrame) -> pd.DataFrame:
    """Backwards over the edge segments of a conversation: the cost to go at the end of each."""
    frame = frame.sort_values(["part", "no"], ascending=False)
    ends, after = [], list(_ENDS)
    for m in frame["matrix"]:
        ends.append(_with_inserts(after))
        after = [min(int(m[4 * s + e]) + ends[-1][e] for e in range(4)) for s in range(4)]
    return pd.DataFrame({"part": frame["part"], "no": frame["no"], "ends": ends, "last": [k == 0 for k in range(len(ends))]})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each edge segment for each that it may be entered in."""
    for batch in batches:
        told = zip(*(batch.column(n).to_pylist() for n in ("codes", "ends", "last")), strict=True)
        exits = [[_walk(codes, tuple(ends), s, last)[1] for s in range(4)] for codes, ends, last in told]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv", "part", "no", "ends", "last")), pa.array(exits, pa.list_(pa.int32()))], names=["conv", "part", "no", "ends", "last", "exits"])


def _entered(frame: pd.DataFrame) -> pd.DataFrame:
    """Forwards over the edge segments of a conversation: the state each is entered in."""
    frame, states = frame.sort_values(["part", "no"]), [START]
    for exits in frame["exits"]:
        states.append(int(exits[states[-1]]))
    return frame[["part", "no", "ends", "last"]].assign(entered=states[:-1])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with (ends, last, entered) -> the cost to go where they begin, the edits, and the repaired turns."""
    item = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("was", pa.string()), ("digest", pa.binary())])
    gone = ("codes", "turns", "roles", "digests", "ends", "last", "entered")
    for batch in batches:
        costs, audits, repaired = [], [], []
        for codes, turns, roles, digests, ends, last, state in zip(*(batch.column(n).to_pylist() for n in gone), strict=True):
            edits, _, least = _walk(codes, tuple(ends or _ENDS), state or START, last is None or last)
            state, said, i = state or START, [], 0
            for edit in edits:
                if edit in "IR":
                    state = _ONWARD[state]
                elif edit == "K":
                    state = _KEPT[state, codes[i].lower()]
                if edit == "I":
                    said.append({"edit": edit, "role": _SAYS[state]})
                    continue
                if edit != "D":
                    said.append({"edit": edit, "turn": turns[i], "role": _SAYS[state] if edit == "R" else roles[i], "was": roles[i], "digest": digests[i]})
                i += 1
            costs.append(least)
            audits.append(edits)
            repaired.append(said)
        rest = [c for c in batch.schema.names if c not in gone]
        arrays = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(repaired, pa.list_(item))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *arrays], names=[*rest, "cost", "audit", "repaired"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, line) -> the SHA-256 of each conversation's lines, newline-joined; one line is held at a time."""
    conv, digest, kind = None, None, None
    for batch in batches:
        kind = batch.column(0).type
        convs, done = [], []
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest is not None and key == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    convs.append(conv)
                    done.append(digest.hexdigest())
                conv, digest = key, sha256()
            digest.update(line.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(done, pa.string())], names=["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


class Repair:
    """The repair of a table of turns; report(), turns() and hashes() read its written segments.

    Rows of a conversation are taken by turn (nulls first), of one turn by role and by the MD5 of the text. A row's first
    fault counts: blank, duplicate (of an earlier row's role and text), truncated. A null role or text is one space;
    rows with a null conv are one conversation. Roles are known by their first letter s, u or a; others must be retold
    or deleted. An empty table gives empty results. A conversation's audit, and its hash, are one value each, so the task
    that returns them reads that conversation's edits, or its repaired texts one by one.
    """

    def __init__(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> None:
        self.source, self.conv = _prepared(bounded_batches(turns), conv, turn, role, text), conv
        self.kind = self.source.schema["conv"].dataType.simpleString()
        keys = ["conv", "turn", "role", "digest"]
        rows = stage(_coded(self.source), "turn-rows")
        ordered = rows.repartitionByRange(parallelism(turns), *keys).sortWithinPartitions(*keys)
        schema = f"conv {self.kind}, part int, no int, edge boolean, codes string, initials string, {_COUNTS}, matrix array<long>, {_ROWS}"
        cut = stage(ordered.select(*keys, "copies", "letter", "fault").mapInArrow(partial(_segments, most=segment), schema), "turn-segments")
        # At most two edges a task, and one for each `segment` rows of a conversation.
        edges = cut.where("edge").select("conv", "part", "no", "codes", "matrix")
        ends = edges.groupBy("conv").applyInPandas(_ends, "part int, no int, ends array<long>, last boolean")
        exits = edges.drop("matrix").join(ends, ["part", "no"]).mapInArrow(_exits, f"conv {self.kind}, part int, no int, ends array<long>, last boolean, exits array<int>")
        entered = stage(exits.groupBy("conv").applyInPandas(_entered, "part int, no int, ends array<long>, last boolean, entered int"), "turn-entries")
        joined = cut.drop("matrix", "edge").join(entered, ["part", "no"], "left").select("conv", "part", "no", "codes", "initials", *_names(_COUNTS), *_names(_ROWS), "ends", "last", "entered")
        self.segments = stage(joined.mapInArrow(_edited, f"conv {self.kind}, part int, no int, initials string, {_COUNTS}, cost long, audit string, repaired {_REPAIRED}"), "turn-repairs")
        release(rows, cut, entered)

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
        order = Window.partitionBy("conv").orderBy("part", "no")
        s = self.segments.select("*", F.lag("initials").over(order).alias("before"), F.lag("high").over(order).alias("turn_before"))
        pair = F.concat(F.right("before", F.lit(1)), F.substring("initials", 1, 1))
        broken = F.when(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)
        shared = F.when(F.col("turn_before") == F.col("low"), 1).otherwise(0)  # a turn on both sides of a cut
        audits = F.sort_array(F.collect_list(F.struct("part", "no", "audit")))
        by = s.groupBy("conv").agg(
            F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("n_turns") - shared), F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"),
            F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + broken).alias("illegal"),
            F.max(F.when(F.col("before").isNull(), F.col("cost"))).alias("cost"), F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit"),
        )
        return by.withColumnRenamed("conv", self.conv)

    def turns(self) -> DataFrame:
        """(conv, place, edit, turn, role, text): the repaired turns; edit is K (kept), R (retold) or I (inserted, without a
        turn). place orders those of a conversation."""
        out = self.segments.select("conv", "part", "no", F.posexplode("repaired").alias("at", "x"))
        out = out.select("conv", F.array("part", "no", "at").alias("place"), F.col("x.edit").alias("edit"), F.col("x.turn").alias("turn"), F.col("x.role").alias("role"), F.col("x.was").alias("was"), F.col("x.digest").alias("digest"))
        texts = self.source.select(_row_key().alias("row_key"), "text").groupBy("row_key").agg(F.any_value("text").alias("text"))
        told = out.where("edit <> 'I'").withColumn("row_key", _row_key("was")).join(texts, "row_key").select("conv", "place", "edit", "turn", "role", "text")
        added = out.where("edit = 'I'").select("conv", "place", "edit", "turn", "role", F.lit("").alias("text"))
        return told.unionByName(added).withColumnRenamed("conv", self.conv)

    def hashes(self) -> DataFrame:
        """(conv, repaired_sha256) of each conversation with repaired turns: of their `role:text`, newline-joined."""
        lines = self.turns().select(F.col(f"`{self.conv}`").alias("conv"), "place", F.concat("role", F.lit(":"), "text").alias("line"))
        ordered = lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line")
        return ordered.mapInArrow(_hashed, f"conv {self.kind}, repaired_sha256 string").withColumnRenamed("conv", self.conv)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def repaired_after_damage(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of `turns` after
    damaged(); zeros, an empty audit and the hash of nothing where no row is left."""
    repair = Repair(damaged(turns), segment=segment)
    all_ = turns.select("conv_id").distinct()
    report, hashes = (df.withColumnRenamed("conv_id", "c") for df in (repair.report(), repair.hashes()))
    out = all_.join(report, all_["conv_id"].eqNullSafe(report["c"]), "left").drop("c")
    out = out.join(hashes, out["conv_id"].eqNullSafe(hashes["c"]), "left").drop("c")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
