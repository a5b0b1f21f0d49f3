"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming carries, for each
position, the best score and the number of pieces on the best path. No path or id is kept.

Tie rule, as in the unigram tokenizer this reproduces: at one end position the match that starts first (the longest)
wins among equal scores. A character that no piece covers is unknown: it costs the smallest score less 10, and a run of
unknown characters is spelt in byte pieces, one for each UTF-8 byte. Scores are whole numbers, so sums are exact and
the text can be counted in parts between which no piece can lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillgrid.llm.tables import bounded_batches

SPACE = "▁"
#: Parts of texts whose counts a worker keeps.
CACHE = 250_000
_UNKNOWN_COST = 10.0


def read_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file, in the order of their ids. Control, unknown and
    byte pieces are left out: text does not match them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    """Counts pieces of texts by the best path; caches parts between which no piece can lie."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - _UNKNOWN_COST
        self.whole = any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary) or any(s != int(s) for _, s in vocabulary)
        self.cache: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces on the best path of a text given with SPACE for spaces."""
        unknown, at = self.unknown, 0  # positions before `at` are settled
        scores, pieces = [0.0], [0]
        top, count, lone = None, 0, False  # of the position being settled

        def settle() -> None:
            nonlocal at, top, count, lone
            if not lone:
                total = scores[at] + unknown
                if top is None or total > top:
                    top, count = total, pieces[at] + len(text[at].encode("utf-8", "surrogatepass"))
            scores.append(top)
            pieces.append(count)
            at, top, count, lone = at + 1, None, 0, False

        for stop, (length, score) in self.automaton.iter(text):  # by end, and for one end the longest first
            while at < stop:
                if lone:
                    scores.append(top)
                    pieces.append(count)
                    at, top, lone = at + 1, None, False
                else:
                    settle()
            start = stop + 1 - length
            total = scores[start] + score
            if top is None or total > top:
                top, count = total, pieces[start] + 1
            if length == 1:
                lone = True
        while at < len(text):
            settle()
        return pieces[-1]

    def count(self, text: str) -> int:
        """Tokens of a text; 0 for the empty one."""
        if not text:
            return 0
        if self.whole:
            return self.best(SPACE + text.replace(" ", SPACE))
        cache, total = self.cache, 0
        parts = text.replace(SPACE, " ").split(" ")
        runs = [f" {p}" for p in parts] if all(parts) else re.findall(" *[^ ]+| +$", " " + text.replace(SPACE, " "))
        for part in runs:
            n = cache.get(part)
            if n is None:
                if len(cache) >= CACHE:
                    cache.clear()
                n = cache[part] = self.best(part.replace(" ", SPACE))
            total += n
        return total


_LOADED: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens (long) behind its other columns (one of that name is replaced). Null and empty texts have 0
    tokens; all rows stay."""
    kept = bounded_batches(docs).drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _LOADED:
            _LOADED[model_path] = Counter(read_vocabulary(model_path))
        counter = _LOADED[model_path]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = pa.array([counter.count(str(t.as_py() or "")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "n_tokens"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("n_tokens", LongType())]))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of every row of docs (columns doc_id, text)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", F.length(body).cast("long").alias("n_chars"), body.alias("text"))
    return count_tokens(plain, model_path).drop("text")
