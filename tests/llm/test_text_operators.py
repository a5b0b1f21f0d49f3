"""The training-text operators against brute force on small tables, with nulls, empty tables, ties, repeats and clashes."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from quillgrid.llm import components, decontam, langid, licences, mainext, merkle, neardup, packing, passages, pii, tokencount, wordhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran tel sim pon dur wex".split()]
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def edge_texts():
    """Null, empty, blank, short, very long and repeated texts; a null id; a repeated row."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, long), (6, long), (7, prose(2, 80)), (7, prose(2, 80)), (None, prose(3, 60)), (9, "x" * 200_000), (10, prose(2, 80))]


def word_set(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(texts, threshold):
    sets = {i: word_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def mutated(text, seed, n):
    rng = random.Random(seed)
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(WORDS)
    return " ".join(ws)


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["The cat  sat\non the MAT", "", "the cat sat on the mat", "a b", "A  B", None]
    data, offsets = wordhash.utf8(pa.array(texts))
    hashes, _, _, firsts = wordhash.words(data, offsets)
    assert np.diff(firsts).tolist() == [6, 0, 6, 2, 2, 0]
    values, begin = wordhash.shingles(hashes, firsts)
    assert np.diff(begin).tolist() == [2, 0, 2, 1, 1, 0]
    assert values[0:2].tolist() == values[2:4].tolist() and values[4] == values[5]


def test_near_duplicates_by_brute_force(spark):
    texts = [(i, prose(100 + i, 60 + i)) for i in range(40)]
    texts += [(100 + i, mutated(prose(7, 150), i, i % 6)) for i in range(150)]  # one large family over several blocks
    texts += [(300 + i, prose(5, 70)) for i in range(5)] + [(400, "a b"), (401, "A  b"), (402, "a c"), (403, ""), (404, "  ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts), 85).collect()}
    assert got == brute_components(texts, 85)


def test_near_duplicates_edges(spark):
    frame = docs(spark, edge_texts()).withColumn("component", F.lit(1)).withColumn("family", F.lit(2))
    rows = neardup.near_duplicates(frame, 85).collect()
    assert len(rows) == len(edge_texts())
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[10]["component_id"] == 7 and by[1]["component_id"] == 1 and by[1]["n_shingles"] == 0
    assert by[None]["component_id"] is None and not by[None]["kept"]
    left = neardup.deduplicate(frame).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left) == sorted((i is None, i or 0) for i in (1, 2, 3, 4, 5, 7, 9, None))
    assert neardup.near_duplicates(frame.limit(0)).count() == 0 and neardup.deduplicate(frame.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for u, v in edges:
        if u is not None and u != v:
            near[u].add(v)
            near[v].add(u)
    seen = {}
    for n in sorted(near):
        todo = [n] if n not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = n
                todo += near[x]
    assert got == seen


def test_packing(spark):
    texts = [(1000 + i, prose(i, 30 + 37 * i)) for i in range(60)] + [(200 + i, "hi") for i in range(30)] + edge_texts()[:5] + [(9, "two  spaces \n\n and\ttabs "), (11, "<|endoftext|> é日本 🎉"), (12, "hello <|endoftext|> x<|endoftext|><|endoftext"), (13, "<|endoftext|>" * 3)]
    frame = docs(spark, texts)
    rows = packing.best_fit(frame, BYTES).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    room = defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in room.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(room) <= 1.05 * sum(map(len, ids.values())) / 1024 + 2
    assert packing.best_fit(frame.limit(0), BYTES).count() == 0
    assert packing.best_fit(docs(spark, [(1, "a"), (1, "a"), (None, "b")]), BYTES).count() == 3


def test_packing_plan_uses_every_piece_once():
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 1025), 200)}
    used = defaultdict(int)
    for lengths, times in packing.plan(counts):
        assert sum(lengths) <= 1024 and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts and packing.plan({}) == []
    assert packing.plan({512: 4}) == [((512, 512), 2)] and sorted(packing.plan({1024: 2, 1000: 1, 24: 1})) == [((1000, 24), 1), ((1024,), 2)]


def test_merkle(spark):
    texts = [(i, prose(i, 200).replace(". ", ".\n")) for i in range(25)] + [(50, None), (51, ""), (52, "ab"), (53, prose(2, 200).replace(". ", ".\n")), (54, prose(9, 20_000))]
    rows = {r["doc_id"]: r for r in merkle.fingerprints_with_edits(docs(spark, texts)).collect()}
    order = sorted(texts)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        new = t[: len(t) - n] + following[:n]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == sha256(new.encode()).hexdigest()
        assert rows[i]["fingerprint"] == merkle.fingerprint(t) and rows[i]["edited_fingerprint"] == merkle.fingerprint(new)
        if len(t) > 200:
            assert rows[i]["near_edited"] > 0.5 > 0.2 > rows[i]["near_next"]
    assert rows[2]["fingerprint"] == rows[53]["fingerprint"] and rows[50]["fingerprint"] == rows[51]["fingerprint"]
    assert merkle.fingerprints_with_edits(docs(spark, [])).count() == 0
    assert merkle.fingerprints_with_edits(docs(spark, [(1, "a b c d")])).first()["near_next"] == 1.0
    assert merkle.fingerprints_with_edits(docs(spark, [(None, "x"), (3, "y"), (3, "y"), (None, None)])).count() == 4


def test_merkle_locates_edits():
    text = "\n".join(f"Line {i} of the text has words." for i in range(40))
    a, b = merkle.fingerprint(text), merkle.fingerprint(text.replace("Line 20", "Row 20"))
    one, two = merkle.differing(a, b)
    assert len(one) == len(two) == 1 and merkle.likeness(a, b) > 0.95 and merkle.differing(a, a) == ([], [])


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans_on_random_strings():
    rng = random.Random(5)
    alphabet = "a1.@+-_% ()é0259\n"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (017) 555-7713", "x@y", "9" * 5000, "a" * 100_000 + "@"):
        assert pii.base_spans(text) == plain_spans(text) if len(text) < 10_000 else pii.base_spans(text) == []


def test_pii_query_and_terms(spark):
    texts = [(100 + i, f"{prose(i, 30)} Zorblat Quimby mail zq@mail.example.com now. {prose(i + 50, 30)}") for i in range(6)]
    texts += [(20 + i, prose(200 + i, 60)) for i in range(40)] + edge_texts()
    rows = pii.personal_data(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    text = texts[0][1]
    spans = [s.split(":") for s in by[100]["spans"].split(",")]
    assert (by[100]["n_email"], spans[0][0]) == (1, "email")
    assert {"Zorblat", "Quimby"} <= {text[int(a) : int(b)] for k, a, b in spans if k == "term"}
    assert all(by[20 + i]["spans"] == "" and by[20 + i]["base_sha256"] == sha256(b"").hexdigest() for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, texts).withColumn("extra", F.lit("e"))).collect()}
    assert "zq@" not in clean[100] and "<email>" in clean[100] and "Quimby" not in clean[100] and clean[101] != texts[1][1] and clean[20] == texts[6][1]
    assert pii.personal_data(docs(spark, [])).count() == 0 and pii.sanitise(docs(spark, [])).count() == 0


def test_language_id(spark):
    base = {"xx": "the quick brown fox jumps over lazy dogs and then this thing was there", "yy": "über schöne straßen gehen wir nicht ohne die füße und den hut", "zz": "où était la forêt où nous avons été très près de ça"}
    rng = random.Random(1)
    rows = []
    for i in range(90):
        lang = ["xx", "yy", "zz"][i % 3]
        rows.append((i, " ".join(rng.choice(base[lang].split()) for _ in range(40)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(table.where("doc_id < 60"))
    edges = spark.createDataFrame([(100, None, "xx", 1), (101, "", None, 2), (102, "123 !!", "yy", 3), (103, rows[0][1] * 2000, None, 4), (None, rows[1][1], None, 5)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, profiles).collect()}
    assert all(got[i][0] == lang and 0 < got[i][1] <= 1 for i, _, lang in rows if i >= 60)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(edges, profiles).collect()}
    assert odd[100] == odd[101] == odd[102] == ("und", 0.0) and odd[103][0] == "xx" and odd[None][0] == "yy"
    assert langid.fit(table.limit(0)) == {} and {r["lang_pred"] for r in langid.identify(table, {}).collect()} == {"und"}


def test_language_stage_rejects_what_it_has_not_learned(spark):
    import corpus_pipeline

    rng = random.Random(4)
    french = "le la les des une est dans pour que qui sur avec nous vous être même très forêt école année où déjà après toujours maison".split()
    rows = [(i, prose(3000 + i, 5 + i), "en") for i in range(100)] + [(100 + i, " ".join(rng.choice(french) for _ in range(5 + i)) + ".", "fr") for i in range(100)]
    clean = {i for i, _, _ in rows} | {200, 201}
    rows += [(200, "Rantel.", "en"), (201, "déjà", "fr")]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))
    spaced = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300))
    code = " ".join(f"{rng.randrange(16**32):032x}" for _ in range(60))
    rows += [(300 + i, t, None) for i, t in enumerate([polish, finnish, letters, spaced, code, "123 456", None])]
    frame = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, frame, "").select("doc_id").collect()}
    assert kept == clean


def test_token_counts(spark):
    counter = tokencount.Counter(tokencount.read_vocabulary(PIECES))
    vocabulary = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *tokencount.read_vocabulary(PIECES)]
    exact = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    for text in [prose(3, 300), "", " ", "日本語 テキスト  two\t \n", "é" * 30, "a  b   c ", "▁x▁▁y", "𝔘nicode 🎉🎉 x", "aaaaaaaaaaaaaaaaaaa" * 50]:
        want = len(exact.encode("▁" + text.replace(" ", "▁")).ids) if text else 0
        assert counter.count(text) == want == counter.count(text), text
    rows = tokencount.token_counts(docs(spark, edge_texts()), PIECES).collect()
    assert len(rows) == len(edge_texts()) and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    small = tokencount.Counter([("▁a", -1.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁aa", -2.0)])
    assert small.count("aa") == 1  # of equal scores the piece that starts first wins
    assert tokencount.count_tokens(docs(spark, [(1, "a")]).withColumn("n_tokens", F.lit("old")), PIECES).first()["n_tokens"] == 1


def test_decontamination(spark):
    items = [(i, prose(500 + i, 12 + 3 * i)) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (None, prose(1, 20))]
    texts = [(1000 + i, prose(i, 150)) for i in range(30)]
    texts += [(100 + i, f"{prose(i, 400)} {items[i][1].upper()} {prose(i + 1, 400)}") for i in range(12)]
    texts += [(200, mutated(items[11][1], 1, 1)), (201, "too  SHORT"), (202, "too short indeed it is"), *edge_texts()[:5]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(0)).withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontam.contaminations(docs(spark, texts).withColumn("item_id", F.lit(3)), bench).collect()}
    want = {}
    for d, t in texts:
        for i, b in items:
            s = word_set(b)
            if i is not None and s and len(s & word_set(t)) >= 0.8 * len(s):
                want[(d, i)] = (len(s & word_set(t)), len(s))
    assert got == want and (201, 50) in want
    left = {r["doc_id"] for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    assert left == {d for d, _ in texts} - {d for d, _ in want}
    assert decontam.contaminations(docs(spark, []), bench).count() == 0 and decontam.contaminations(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, prose(9, 30))], "item_id long, text string")
    got = decontam.contaminations(docs(spark, [(1, prose(9, 30)), (2, prose(8, 30))]), bench).collect()
    assert [(r["doc_id"], r["containment"]) for r in got] == [(1, 1.0)]


def test_licences(spark):
    notices = {1: ("Released under the MIT License.", "MIT"), 2: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), 3: ("This work is licensed under the GNU General Public License, version 3.", "GPL"), 4: ("Licensed under the Apache License, Version 2.0.", "Apache")}
    texts = [(i, f"{prose(i, 40)}\n{n}\n{prose(i + 9, 30)}") for i, (n, _) in notices.items()]
    texts += [(10 + i, prose(i, 120)) for i in range(20)] + [(40, "She got her driving licence at the office."), *[(60 + i, t) for i, (_, t) in enumerate(edge_texts()[:5])], (5, prose(3, 200) + ". Licensed under the Mozilla Public License, version 2.0. " + prose(4, 200))]
    frame = docs(spark, texts).withColumn("score", F.lit(1)).withColumn("family", F.lit("x"))
    model = licences.fit(spark, frame)
    rows = licences.scan(frame, model).collect()
    assert {(r["doc_id"], r["family"]) for r in rows} == {(i, f) for i, (_, f) in notices.items()} | {(5, "MPL")}
    assert all(r["paragraph"] == 1 for r in rows if r["doc_id"] < 5) and all(0.5 <= r["score"] <= 1 for r in rows)
    assert licences.scan(frame.limit(0), model).count() == 0
    inside = [(1, f"{prose(50, 12)} this code is licensed under the MIT License and {prose(51, 20)}", "MIT"), (2, f"{prose(52, 30)} and is licensed under the Apache License, Version 2.0 as {prose(53, 40)}", "Apache")]
    inside += [(3, f"{prose(54, 25)}. This work is licensed under the GNU General Public License, version 3. {prose(55, 15)}", "GPL"), (4, f"{prose(56, 90)} licence {prose(57, 30)} version of the work", None)]
    got = {(r["doc_id"], r["family"]) for r in licences.scan(docs(spark, [(i, t) for i, t, _ in inside]), model).collect()}
    assert got == {(i, f) for i, _, f in inside if f}
    empty = docs(spark, [])
    assert licences.scan(empty, licences.fit(spark, empty)).count() == 0
    # The words that screen paragraphs lose none that the model and the templates would find.
    free = licences.LicenceModel(model.vector, model.regression, model.families, model.vector.vocabulary)
    free.calibration = model.calibration
    assert {(r["doc_id"], r["family"]) for r in licences.scan(frame, free).collect()} == {(r["doc_id"], r["family"]) for r in rows}


def test_licences_learn_from_every_paragraph(spark):
    plain = [[f"Zor{i} fel{k} about the water and ran{i * 7 + k}" for k in range(5)] for i in range(700)]
    notice = "Released under CC0 1.0 Universal."  # no word that keeps a line out of the training by itself
    for i in (3, 300, 600):
        plain[i][0] += " by the library"
    plain[650][1] += " of mozilla"
    texts = [(i, "\n".join([*lines, "Home and about us", *([notice] if i % 7 == 0 else [])])) for i, lines in enumerate(plain)]
    frame = docs(spark, [*texts, (None, "Nowhere but here"), (None, None)])
    model = licences.fit(spark, frame)
    assert model.learned == 5 * 700 + 2  # the shared line is one, and no notice is among them
    assert {"cc0", "mozilla"} < set(model.telling) and "library" not in model.telling  # in 3 of 3,502, one of which is too few
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(frame, model).collect()}
    assert got == {(i, 6, "CC0") for i in range(0, 700, 7)}


def test_licences_count_different_paragraphs_once(spark):
    """The n-grams of all paragraphs of one gist are counted once, behind the grouping, and as a plain count has them."""
    shared = [f"{prose(k, 9)} of the water, and of the use of it." for k in range(6)] + ["Of the", "  the\tof \x0b the ", "Éa 1 of-the THE İ of the", "of the license", "Released under CC0 1.0 Universal."]
    texts = [(i, "\n".join([*shared[i % 3 :], prose(i, 60 + i), f"only {i} of the rest"])) for i in range(40)]
    vocabulary = ["0", "1", "cc0", "of", "released", "the", "under", "universal", "use", "0 universal", "1 0", "cc0 1", "of the", "released under", "the use", "under cc0"]
    vector = licences.CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    known = [["released under", "under cc0", "cc0 1", "1 0", "0 universal"]]
    counts = licences.ordinary(docs(spark, texts), vector, known)
    got = {tuple(float(x) for x in r["features"].toArray()): 0 for r in counts.collect()}
    for r in counts.collect():
        got[tuple(float(x) for x in r["features"].toArray())] += r["n"]
    bodies = {r["body"] for r in licences.parts(licences.paragraphs(docs(spark, texts))).collect()}
    want = {}
    for body in bodies:
        if "licens" in body or body.startswith("Released"):
            continue
        words = re.findall(r"[^\W_-]+(?:[^\W_]|-)*|-(?:[^\W_]|-)*", body.lower())
        key = tuple(float((words + [f"{a} {b}" for a, b in zip(words, words[1:])]).count(g)) for g in vocabulary)
        want[key] = want.get(key, 0) + 1
    assert got == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString().split("\n")  # from the last step to the first
    steps = [next((s for s in ("UDF(", "Aggregate", "posexplode") if s in line), None) for line in plan]
    assert steps.index("UDF(") < len(steps) - 1 - steps[::-1].index("Aggregate") and "Aggregate" in steps[steps.index("UDF(") : steps.index("posexplode")]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>One</a></li></ul></nav>
<div id="content"><h1>Head&amp;line</h1><p>Long text of the  article that goes on&nbsp;and on for a while, and then <b>more</b>.<br>Next<p>Ok.</p><div class="ad">Buy it now</div><p>Another long paragraph of
the article follows here with many words in it.</div><aside>Popular things with quite long texts that might be content but are not.</aside>
<section id="comments"><p>I think this is a very long comment by a reader that goes on for a while.</p></section><form>Enter <button>Go</button></form><div class="cookie-notice">We use cookies.</div><footer>&copy; x</footer></body>"""


def test_main_text(spark):
    want = "Head&line\nLong text of the article that goes on and on for a while, and then more. Next\nOk.\nAnother long paragraph of the article follows here with many words in it."
    assert mainext.main_text(PAGE) == want
    assert mainext.main_text("<article><p>Short.</article>") == "Short." and mainext.main_text("<nav>x</nav>") == "" and mainext.main_text("plain text") == "plain text"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "w", ""), (3, "w", ""), (None, "z", "<p>" * 5000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    rows = mainext.extract(pages).collect()
    assert len(rows) == 5 and {r["page_id"]: r["n_chars"] for r in rows}[1] == len(want) and {r["page_id"]: r["text"] for r in rows}[None] == "deep"
    assert mainext.extract(pages.limit(0)).count() == 0


LONG = "A paragraph of the article with so many words that it is surely text and nothing else at all. " * 4


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<p class='share'>Share<p>{LONG}", [LONG.strip()]),
        (f"<div class='content with-sidebar'><p>{LONG}</p></div>", [LONG.strip()]),
        (f"<div class='page no-sidebar'><p>{LONG}</p></div><div class='sidebar'>Links and more</div>", [LONG.strip()]),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", ["Title", LONG.strip()]),
        (f"<article><p>{LONG}</p><ul><li class='share'>x<li>item</ul></article>", [LONG.strip(), "item"]),
        (f"<nav><ul><li><a href=a>One</a></ul><div><p>{LONG}</p></div>", [LONG.strip()]),
        (f"<nav><a href=a>One</a><article><p>{LONG}</p></article>", [LONG.strip()]),
        (f"<article><p id='comments-on-war'>Short words.</p><p>{LONG}</p></article>", ["Short words.", LONG.strip()]),
        (f"<article><h1>T</h1><p>Lead</p><section><p>{LONG}</p><p>{LONG}</p></section><p>Closing</p></article>", ["T", "Lead", LONG.strip(), LONG.strip(), "Closing"]),
        (f"<body><div id=menu><a href=a>Home</a></div><div><h1>T</h1><p>Lead</p><div><p>{LONG}</p><p>{LONG}</p></div><p>Closing</p></div></body>", ["T", "Lead", LONG.strip(), LONG.strip(), "Closing"]),
        (f"<main><article><p>{LONG}</p><p>{LONG}</p></article><article><p>Second one, short.</p></article></main>", None),
        (f"<form><div class='has-comments'><h1>T</h1><p>{LONG}</p></div><div id='comments'><p>{LONG} by a reader</p></div></form>", ["T", LONG.strip()]),
        (f"<article><p>{LONG}</p><section class='comments'><article class='comment'><p>{LONG}</p></article></section></article>", [LONG.strip()]),
        (f"<body><h1>T</h1><p>{LONG}</p><blockquote><p>{LONG}</p></blockquote><p>End</p><footer>f</footer>", ["T", LONG.strip(), LONG.strip(), "End"]),
    ],
)
def test_main_text_of_page_shapes(html, want):
    got = mainext.main_text(html).split("\n")
    assert got == want if want else LONG.strip() in got


def test_repeated_passages(spark):
    shared = prose(77, 70)
    texts = [(1000 + i, prose(i, 200)) for i in range(20)] + [(100 + i, f"{prose(40 + i, 30 + 7 * i)} {shared} {prose(60 + i, 50)}") for i in range(8)]
    texts += [(200, prose(90, 100)), (201, prose(90, 100)), (300, f"{prose(555, 3000)} {shared}"), (400, "a common line here.\n" + prose(30, 60)), (401, "a common line here.\n" + prose(31, 60))]
    texts += edge_texts()[:4] + [(None, shared)]
    frame = docs(spark, texts).withColumn("position", F.lit(1)).withColumn("key", F.lit(1))
    rows = passages.repeated_passages(frame).collect()
    assert {r["doc_id"] for r in rows} == {*range(100, 108), 200, 201, 300}
    assert {r["doc_id"] for r in rows if not r["removed"]} == {100, 200}
    for r in rows:
        assert r["n_words"] == r["last_word"] - r["first_word"] + 1 >= 70
        if r["doc_id"] in range(100, 108):  # a few words around the passage may be equal by chance
            begin = 30 + 7 * (r["doc_id"] - 100)
            assert begin - 3 <= r["first_word"] <= begin and begin + 69 <= r["last_word"] <= begin + 72
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(frame).collect()}
    assert len(left) == len(texts) and left[100] == dict(texts)[100] and len(left[103].split()) <= len(dict(texts)[103].split()) - passages.WINDOW and left[1003] == dict(texts)[1003]
    assert passages.repeated_passages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [[], "edges"])
def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    rows = edge_texts() + [(20 + i, f"{prose(500 + i, 80)} mail a{i}@b.example.com.") for i in range(10)] + [(40, f"{prose(1, 50)} {prose(900, 40)} {prose(2, 50)}")] if texts else []
    frame = docs(spark, rows)
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = frame.withColumn("score", F.lit(1.5)).withColumn("lang_pred", F.lit("x"))
    kept = extra
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        step(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == extra.columns
    out = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids == ({4, 5, 7, 9, None, *range(20, 30)} if texts else set())
    assert kept.where("text LIKE '%@%'").count() == 0
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids
