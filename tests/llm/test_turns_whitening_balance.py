"""Conversation repair against an exhaustive search, whitening against the covariance's eigenvectors, balanced packing against the tokenizer."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillgrid.llm import balance, turns, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    """{conv_id: damaged rows in order}"""
    out = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub(r"[.!?]", "", x) if k == 2 else x
        out[c] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    for c in out:
        out[c].sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        said = x.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not said else "d" if (r, x) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by best-first search: the first end is the cheapest and of these the ASCII-least."""
    wrong, heap, seen = faults(rows), [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, said
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in STEP[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*said, f"{role}:")))
        if i == len(rows):
            continue
        _, r, x = rows[i]
        extra = 3 if wrong[i] == "t" else 0
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, said))
        if wrong[i] not in ("b", "d"):
            if r[:1] in STEP[state]:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, r[0], (*said, f"{r}:{x}")))
            for role in ("user", "assistant"):
                if role[0] in STEP[state]:
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, role[0], (*said, f"{role}:{x}")))


def expected(rows):
    out = {}
    for c, own in damaged(rows).items():
        wrong, (cost, audit, said) = faults(own), cheapest(own)
        told = [t for t, _, _ in own if t is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[c] = (gaps, wrong.count("b"), wrong.count("d"), wrong.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations():
    """Random turns with nulls in every column, ties, repeated rows and roles and texts of all kinds."""
    r, rows = random.Random(3), []
    for c in [*range(50), None]:
        for k in range(r.choice([0, 1, 2, 3, 6, 12, 20])):
            turn = r.choice([None, *range(30)]) if r.random() < 0.3 else k
            rows.append((c, turn, r.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), r.choice(["Yes.", "no", "", None, "a b.", "x! \n", "Was?", "　", "q" * 999])))
    return rows


def test_repairs_are_the_cheapest_and_ascii_least(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, "y") for x in rows], "conv_id long, turn long, role string, text string, `copy.number` string")
    for segment in (turns.SEGMENT, 3):
        got = {r[0]: tuple(r)[1:] for r in turns.repaired_after_damage(df, segment=segment).collect()}
        assert got == expected(rows), segment
    assert turns.repaired_after_damage(df.where("false")).count() == 0


def test_one_long_conversation_spans_tasks(spark):
    rows = [("c", k, "user" if k % 2 == 0 else "assistant", "Same." if k % 7 == 0 else f"t{k}.") for k in range(3000)] + [("c", 5000, "user", "no end")] * 40
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    repair = turns.Repair(df, segment=100)
    report, said = repair.report().collect(), repair.turns().collect()
    own = sorted(rows, key=lambda z: z[1])
    wrong = faults([x[1:] for x in own])
    assert len(report) == 1 and report[0]["duplicate"] == wrong.count("d") and report[0]["gaps"] == 2000 and report[0]["truncated"] == 1
    audit = report[0]["audit"]
    letters = "".join(r["role"][0] for r in sorted(said, key=lambda r: r["place"]))
    assert re.fullmatch(r"s?(ua)+", letters) and len(letters) == len(audit) - audit.count("D")
    assert report[0]["cost"] == 4 * audit.count("D") + 3 * (audit.count("I") + audit.count("R")) + 3 * any(r["text"] == "no end" for r in said)
    first = turns._walk("".join("-" if f == "d" else x[2][0].upper() if f == "t" else x[2][0] for x, f in zip(own, wrong, strict=True)), turns._ENDS, 0, True)
    assert first[0] == audit and first[2] == report[0]["cost"]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(600, 20)) @ rng.normal(size=(20, 20))).tolist()
    table = [(k, v, 1) for k, v in enumerate(rows)] + [(None, rows[0], 2), (700, rows[0], 2), (701, None, 2), (702, [None, *rows[0][1:]], 2), (703, [float("nan"), *rows[0][1:]], 2), (704, [float("-inf"), *rows[0][1:]], 2), (705, [1.0, 2.0], 2), (706, [], 2)]
    df = spark.createDataFrame(table, "`vec.id` long, embedding array<double>, x int").repartition(11)
    got = whitening.whiten(df, key="vec.id").toPandas()
    assert set(got["vec.id"].dropna()) == {*range(600), 700} and got["vec.id"].isna().sum() == 16 and len(got) == 602 * 16
    x = np.floor(64 * np.array(rows)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    mine = got[got["vec.id"] < 600].sort_values(["vec.id", "component"])
    want = (x - sums / n) @ vectors[:, :16] / np.sqrt(values[:16])
    w = mine["whitened"].to_numpy().reshape(600, 16)
    w = w * np.sign((w * want).sum(axis=0))  # either sign, the same for all rows
    assert np.abs(w - want).max() < 1e-6
    assert (mine["deviation"].to_numpy().reshape(600, 16)[:, 0] == ((n * x - sums) ** 2).sum(axis=1)).all() and set(mine["n"]) == {n}
    assert np.abs(mine["explained"].to_numpy()[:16] / (values[:16] / values.sum()) - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for none in (df.where("false"), df.where("`vec.id` IN (0, 700)"), df.where("`vec.id` = 701")):
        assert whitening.whiten(none, key="vec.id").count() == 0
    few = whitening.whiten(df.where("`vec.id` < 4"), key="vec.id").toPandas()
    assert few["component"].max() == 3 and len(few) == 12
    huge = spark.createDataFrame([(0, [3e300, 1.0]), (1, [-1e17, 2.0]), (2, [0.0, 5.0])], "vec_id long, embedding array<double>")
    told = whitening.whiten(huge).toPandas()
    x = [[(1 << 40) + 1_000_000, 1_000_064], [1_000_000 - (1 << 40), 1_000_128], [1_000_000, 1_000_320]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert [None if d != d else int(d) for d in told[told["component"] == 1].sort_values("vec_id")["deviation"].astype(object).where(told["deviation"].notna(), float("nan"))] == [d if d < 1 << 63 else None for d in exact]


def check_plan(histogram, capacity):
    steps = balance.plan(histogram, capacity)
    loads, spent, told, pieces = defaultdict(list), Counter(), {}, defaultdict(list)
    for length, low, high, start, tokens, first, offset, total in steps:
        for k in range(high - low):
            loads[first + k].append((offset, tokens))
            spent[first + k] += balance.cost(tokens)
            assert told.setdefault(first + k, total) == total
            pieces[length, low + k].append((start, tokens))
    assert set(pieces) == {(length, k) for length, n in histogram.items() for k in range(n)}
    for (length, _), own in pieces.items():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) == length
    for own in loads.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
    assert spent == told
    sizes = Counter(sum(n for _, n in own) for own in loads.values())
    total = sum(k * n for k, n in histogram.items())
    assert sizes.pop(capacity, 0) == total // capacity
    assert all(n == 1 and size & (size - 1) == 0 for size, n in sizes.items()) and sum(sizes) == total % capacity
    return steps, spent


def test_balanced_plan(spark):
    rng = np.random.default_rng(2)
    for capacity in (8, 64, 100, 1024):
        for mean in (0.5, 2, 4):
            drawn = np.clip(rng.lognormal(mean, 1.2, 2000).astype(int), 1, capacity)
            check_plan(Counter(drawn.tolist()), capacity)
    for few in ({}, {1: 1}, {5: 1}, {8: 3}, {7: 9}, {1: 17}):
        check_plan(few, 8)
    _, spent = check_plan(Counter(np.clip(rng.lognormal(5, 1, 20000).astype(int), 1, 1024).tolist()), 1024)
    full = np.array([c for c in spent.values() if c > 6 * 1024 * 1000])
    assert full.max() / full.mean() < 1.1
    # The plan's size depends on the capacity, not on the counts.
    assert len(balance.plan({k: 10**9 + k * k for k in range(1, 1025)})) < 20_000


def test_balanced_packing_is_exact(spark):
    words = "alpha beta gamma delta, don't 12345 été über \n naïve".split(" ")
    r = random.Random(4)
    texts = [None, "", " ", "<|endoftext|> x", *(" ".join(r.choices(words, k=n)) for n in [1, 3, 9, 30, 90, 300, 700, 1500, 9000, *r.choices(range(1, 400), k=60)])]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(5, texts[8], "z"), (5, texts[8], "z"), (None, texts[9], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `part.nth` string").repartition(5)
    got = balance.balanced(df, PATH).toPandas()
    real = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, _ in rows:
        want[doc_id, np.array([*real.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()] += 1
    # Pieces of a document are put together again by start; copies of a document are cut apart by their first pieces.
    back = Counter()
    for doc_id, own in got.groupby("doc_id", dropna=False):
        doc_id = None if doc_id != doc_id else int(doc_id)
        texts_ = [(n, data) for (d, data), n in want.items() if d == doc_id]
        if sum(n for n, _ in texts_) == 1:
            own = own.sort_values("start")
            assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
            back[doc_id, b"".join(own["ids"])] += 1
    assert all(back[k] == 1 for k, n in want.items() if sum(m for (d, _), m in want.items() if d == k[0]) == 1)
    assert (got["ids"].map(len) == 4 * got["length"]).all()
    total = sum(len(data) // 4 * n for (_, data), n in want.items())
    assert got["length"].sum() == total
    sizes = Counter(got.groupby("sequence_id")["length"].sum())
    assert sizes.pop(1024) == total // 1024 and all(n == 1 and not s & (s - 1) for s, n in sizes.items()) and sum(sizes) == total % 1024
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and set(own["sequence_cost"]) == {sum(map(balance.cost, own["length"]))}
    assert balance.balanced(df.where("false"), PATH).count() == 0
