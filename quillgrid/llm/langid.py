"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillgrid.llm.tables import bounded_batches

#: n-grams of 1 to N_MAX letters; entries of a language's profile and of a document's.
N_MAX = 3
PROFILE = 400
DOCUMENT = 300
#: Quantile of the learned texts' scores that least_scores starts from, and the share of it. At sf0.1 this gives 0.37 to
#: 0.40; the lowest of the labelled texts is 0.41, program code 0.32, Finnish 0.20 and random letters 0.23.
LOW, MARGIN = 0.05, 0.6
UNKNOWN = "und"
_B = np.uint64(21)
_CHUNK = 1 << 18
#: n-grams whose sums a training task holds.
_HELD = 1 << 18


def _letter_table() -> np.ndarray:
    """Lower-case code of letters and marks by BMP code point, 0 for what is neither."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for code in range(0x10000):
        c = chr(code)
        if unicodedata.category(c)[0] in "LM":
            _MARK[code] = unicodedata.category(c)[0] == "M"
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_TABLE: list[np.ndarray] = []
_MARK = np.zeros(0x10000, dtype=bool)


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points with a 0 at each edge and for each run of other characters. Marks
    (category M) go on a word that a letter began and are no letters otherwise. Letters beyond the basic plane count as
    they are."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = codes > 0xFFFF
    got = _TABLE[0][np.where(high, 0, codes)]
    if high.any():
        got[high] = [c if unicodedata.category(chr(c))[0] == "L" else 0 for c in codes[high].tolist()]
    mark = _MARK[np.where(high, 0, codes)] & ~high
    if mark.any():
        place = np.arange(len(got))
        letter, gap = (np.maximum.accumulate(np.where(x, place, -1)) for x in ((got > 0) & ~mark, got == 0))
        got[mark & (letter < gap) | mark & (letter < 0)] = 0
    got = np.concatenate(([0], got, [0])).astype(np.uint64)
    keep = np.ones(len(got), dtype=bool)
    keep[1:] = (got[1:] > 0) | (got[:-1] > 0)
    return got[keep]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, counts) of a whole text. A key packs 21 bits a letter, a shorter n-gram being led by ones; n-grams
    may begin or end with a word's edge but do not cross it. Every letter is the middle of one 3-gram, edges included,
    so the 3-grams' counts hold those of the shorter ones."""
    codes = letters(text)
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for low in range(0, len(codes) - 2, _CHUNK):  # scratch memory stays bounded on the longest texts
        part = codes[low : low + _CHUNK + 2]
        inside = part[1:-1] > 0
        k, c = np.unique((part[:-2] << 2 * _B | part[1:-1] << _B | part[2:])[inside], return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    three, n = (keys[0], counts[0]) if len(keys) == 1 else added(keys, counts)
    first = three >> 2 * _B == 0  # a word's first letter; else the n-gram of it and its left neighbour is counted there
    two, n_two = added([three & np.uint64((1 << 42) - 1), three[first] >> _B], [n, n[first]])
    one, n_one = added([three >> _B & np.uint64((1 << 21) - 1)], [n])
    two |= np.uint64(((1 << 21) - 1) << 42)
    one |= np.uint64(((1 << 42) - 1) << 21)
    return np.concatenate([three, two, one]), np.concatenate([n, n_two, n_one])


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(each key once, sum of its counts)."""
    merged, place = np.unique(np.concatenate(keys), return_inverse=True)
    return merged, np.bincount(place, weights=np.concatenate(counts), minlength=len(merged)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent keys, most frequent first, ties by key."""
    if len(keys) > n:  # nothing under the n-th count can be among them
        floor = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= floor], counts[counts >= floor]
    return keys[np.lexsort((keys, -counts))][:n]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): a task's own sums of its texts' n-grams, handed on whenever there are more than _HELD of them."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def sums() -> pa.RecordBatch:
        langs = [x for x, (keys, _) in held.items() for _ in range(len(keys))]
        keys, counts = (np.concatenate([np.zeros(0, dtype=kind), *(x[i] for x in held.values())]) for i, kind in enumerate((np.uint64, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            keys, counts = ngram_counts(" ".join(some))  # n-grams do not cross the space
            old = held.get(lang)
            held[lang] = (keys, counts) if old is None else added([old[0], keys], [old[1], counts])
        if sum(len(keys) for keys, _ in held.values()) > _HELD:
            yield sums()
            held.clear()
    yield sums()


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """labelled (doc_id, text, lang) -> each language's most frequent n-grams in rank order, counted over the whole of
    all its texts; rows with null lang or text are left out. A profile has PROFILE entries, so the result is as small as
    the number of languages.
    """
    rows = bounded_batches(labelled).where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    summed = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect()  # PROFILE rows a language
    out: dict[str, list[int]] = {}
    for r in best:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, dtype=np.int64).view(np.uint64) for lang, grams in out.items()}


class Profiles:
    """Ranks of all languages' profiles, for lookups by key."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.langs = sorted(profiles)
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.zeros(0, dtype=np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys)), PROFILE, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): of the smallest out-of-place distance, ties to the first name; score is 1 - distance
        over the largest possible one. A text without a letter is UNKNOWN with score 0."""
        keys, counts = ngram_counts(text or "")
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = top(keys, counts, DOCUMENT)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[at] == own
        ranks = np.where(known[None, :], self.ranks[:, at], PROFILE)
        place = np.arange(len(own))
        far = np.where(ranks == PROFILE, PROFILE, np.minimum(np.abs(ranks - place[None, :]), PROFILE))
        distance = far.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score behind its other columns, under `names` (columns of those names
    are replaced). Null text, empty text and text without letters are UNKNOWN with score 0; all rows stay."""
    kept = bounded_batches(docs).drop(*names)
    out = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    place = kept.columns.index(text)
    plain = {k: v.tobytes() for k, v in profiles.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Profiles({k: np.frombuffer(v, dtype=np.uint64) for k, v in plain.items()})
        for batch in batches:
            found = [ready.predict(None if t.as_py() is None else str(t.as_py())) for t in batch.column(place)]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return kept.mapInArrow(run, out)


def least_scores(judged: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> dict[str, float]:
    """{language: score that its texts have at least}: MARGIN of the exact LOW quantile of the scores, judged by
    `identify` under `names`, of all texts that are taken for the language. Junk among fewer than LOW of them does not
    lower it."""
    lang, score = (F.col(f"`{x}`") for x in names)
    counted = judged.where(score > 0).groupBy(lang.alias("lang"), score.alias("score")).agg(F.count(F.lit(1)).alias("n"))
    low = counted.groupBy("lang").agg(F.percentile("score", LOW, F.col("n")).alias("low"))  # a score is a ratio of two small numbers
    return {r["lang"]: MARGIN * r["low"] for r in low.collect()}
