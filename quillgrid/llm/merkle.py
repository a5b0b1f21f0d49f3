"""Merkle fingerprints of documents: phrases under paragraphs under sections under the root.

Leaves are the phrases of a text, which together are the whole text, white space included. A paragraph's hash is over
its phrases' hashes, a section's over its paragraphs', the root's over the sections', always at full length, so equal
roots mean equal texts. Where roots differ, only branches with differing hashes need a look, down to the edited phrases.

A fingerprint is text, `root|section:paragraph=leaf.leaf,paragraph=leaf;section:...`, with the whole root and the first
12, 8 and 6 hex digits of the hashes below. A paragraph is a line; a phrase ends with its sentence or after PHRASE words,
so that short documents of one sentence can still be likened.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import bounded_batches, parallelism

#: A section ends with a blank line or after a paragraph whose hash is 0 modulo this: boundaries move with the text.
SECTION = 8
#: Words in a phrase at most.
PHRASE = 6
_SIZE = 16
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_WORD = re.compile(r"\S+\s*")
_ENDS = frozenset(".!?")


def phrases(line: str) -> list[str]:
    """The phrases of a line, which joined are the line; white space before a word belongs to the line's first phrase,
    white space behind one to its phrase."""
    words = _WORD.findall(line)
    if not words:
        return [line] if line else []
    lead = len(line) - sum(map(len, words))
    out, held = [], [line[:lead]] if lead else []
    room = PHRASE + len(held)
    for word in words:
        held.append(word)
        if len(held) == room or word.rstrip()[-1] in _ENDS:
            out.append("".join(held))
            held, room = [], PHRASE
    if held:
        out.append("".join(held))
    return out


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=_SIZE).digest()


def fingerprint(text: str) -> str:
    """The fingerprint of a text; equal texts have equal ones. The empty text has a root and no sections."""
    sections: list[bytes] = []
    shown: list[str] = []
    held: list[bytes] = []
    body: list[str] = []
    for line in _LINE.findall(text):
        leaves = [_hash(x.encode("utf-8", "surrogatepass")) for x in phrases(line)]
        if leaves:
            paragraph = _hash(b"p" + b"".join(leaves))
            held.append(paragraph)
            body.append(f"{paragraph.hex()[:8]}={'.'.join([x.hex()[:6] for x in leaves])}")
            if paragraph[-1] % SECTION == 0 or line.isspace():
                section = _hash(b"s" + b"".join(held))
                sections.append(section)
                shown.append(f"{section.hex()[:12]}:{','.join(body)}")
                held, body = [], []
    if held:
        section = _hash(b"s" + b"".join(held))
        sections.append(section)
        shown.append(f"{section.hex()[:12]}:{','.join(body)}")
    return f"{_hash(b'r' + b''.join(sections)).hex()}|{';'.join(shown)}"


#: A branch: its hash and what stands below it, as text.
_Branch = tuple[str, str]


def _branches(body: str, between: str, mark: str) -> list[_Branch]:
    return [(x.partition(mark)[0], x.partition(mark)[2]) for x in body.split(between)] if body else []


def _sections(mark: str) -> list[_Branch]:
    return _branches(mark.partition("|")[2], ";", ":")


def _paragraphs(section: _Branch) -> list[_Branch]:
    return _branches(section[1], ",", "=")


def _leaves(paragraph: _Branch) -> list[str]:
    return paragraph[1].split(".")


def _size(section: _Branch) -> int:
    """Leaves of a section, without a look at them."""
    return section[1].count(".") + section[1].count(",") + 1


def _unequal(one: list[_Branch], two: list[_Branch]) -> tuple[list[int], list[int]]:
    """Places in both of the branches left over when equal ones are paired off."""
    both = Counter(x[0] for x in one) & Counter(x[0] for x in two)
    out = []
    for own in (one, two):
        left, rest = both.copy(), []
        for i, (name, _) in enumerate(own):
            if left[name] > 0:
                left[name] -= 1
            else:
                rest.append(i)
        out.append(rest)
    return out[0], out[1]


def likeness(a: str, b: str) -> float:
    """Dice coefficient of two fingerprints' leaves, from 0 to 1, by descending from the roots: equal branches count
    whole without a look below them. 1 if the roots are equal; 0 if only one text is empty."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    one, two = _sections(a), _sections(b)
    total = sum(map(_size, one)) + sum(map(_size, two))
    left, right = _unequal(one, two)
    differ = [sum(_size(one[i]) for i in left), sum(_size(two[i]) for i in right)]
    if differ[0] and differ[1]:
        parts = [list(chain.from_iterable(_paragraphs(x[i]) for i in rest)) for x, rest in ((one, left), (two, right))]
        rests = [[_leaves(x[i]) for i in rest] for x, rest in zip(parts, _unequal(*parts), strict=True)]
        bags = [Counter(chain.from_iterable(x)) for x in rests]
        common = sum((bags[0] & bags[1]).values())
        differ = [sum(map(len, x)) - common for x in rests]
    return (total - differ[0] - differ[1]) / total if total else 1.0


def differing(a: str, b: str) -> tuple[list[str], list[str]]:
    """The branches of a that b does not have, and those of b that a does not have: `section`, `section.paragraph` or
    `section.paragraph.leaf` (numbers from 0), the highest branch none of whose parts is in the other."""
    trees = []
    for mark in (a, b):
        trees.append([(h, [(p[0], _leaves(p)) for p in _paragraphs((h, body))]) for h, body in _sections(mark)])
    out = []
    for own, other in (trees, trees[::-1]):
        sections, paragraphs = {h for h, _ in other}, {p for _, ps in other for p, _ in ps}
        leaves = {x for _, ps in other for _, xs in ps for x in xs}
        found: list[str] = []
        for i, (h, ps) in enumerate(own):
            if h in sections:
                continue
            parts = [(j, [k for k, x in enumerate(xs) if x not in leaves], len(xs)) for j, (p, xs) in enumerate(ps) if p not in paragraphs]
            if len(parts) == len(ps) and all(len(ks) == n for _, ks, n in parts):
                found.append(f"{i}")
                continue
            for j, ks, n in parts:
                found += [f"{i}.{j}"] if len(ks) == n else [f"{i}.{j}.{k}" for k in ks]
        out.append(found)
    return out[0], out[1]


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points from the start of the following text (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, then document; each row's successor follows it in its part."""
    held: tuple[int, bool, object, str, str] | None = None
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in _KINDS)
        part, copy, ids, texts = batch.columns
        for p, c, i, t in zip(part.to_pylist(), copy.to_pylist(), ids.to_pylist(), texts, strict=True):
            text = t.as_py() or ""
            mark = fingerprint(text)
            if held and held[0] == p and not held[1]:
                _, _, own_id, own, own_mark = held
                new = edited(own, text)
                new_mark = own_mark if new == own else fingerprint(new)
                values = (
                    own_id, len(own), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, new_mark,
                    likeness(own_mark, new_mark), likeness(own_mark, mark), ",".join(differing(own_mark, new_mark)[0]),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            held = (p, c, i, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, _KINDS, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])


def fingerprints_with_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text (see `edited`), the next document being the next by doc_id,
    after the last the first. `edits` lists the branches of the document that the edited text lacks (see `differing`).

    The documents are dealt once, by ranges of doc_id whose bounds are quantiles; the first document of a range is
    also sent to the end of the range before it, so that each task walks its sorted rows with one row of memory.
    Null text is empty. Rows without doc_id come first; rows that repeat a doc_id follow each other in the order of
    their texts. A single document is its own successor; an empty table gives an empty result.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = max(1, 4 * parallelism(docs))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.agg(
        F.min("doc_id").alias("least"),
        F.percentile_approx("doc_id", shares, 10 * parts).alias("cuts"),
        F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"),
    ).first()
    cuts = sorted({c for c in found["cuts"] or [] if c > found["least"] or found["nulls"]})
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    # One literal that folds to a constant, however many partitions there are.
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    # Binary search: the number of bounds that are not above doc_id.
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, s: F.when((low + s <= len(cuts)) & F.coalesce(F.try_element_at(bounds, low + s) <= F.col("doc_id"), F.lit(False)), low + s).otherwise(low),
    )
    first = F.col("doc_id").isNull() if found["nulls"] else F.col("doc_id") == F.lit(found["least"])
    last = F.lit(len(cuts))
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("copy"))
    opens = F.coalesce(F.try_element_at(bounds, F.greatest(F.col("part"), F.lit(1))) == F.col("doc_id"), F.lit(False))
    back = F.when(opens, F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("copy")))
    wrap = F.when(first, F.struct(last.alias("part"), F.lit(True).alias("copy")))
    dealt = (
        rows.withColumn("part", at)
        .withColumn("to", F.explode(F.filter(F.array(here, back, wrap), lambda x: x.isNotNull())))
        .select("to.part", "to.copy", "doc_id", "text")
        .repartition(parallelism(docs), "part")
        .sortWithinPartitions("part", "copy", F.col("doc_id").asc_nulls_first(), "text")
    )
    return dealt.mapInArrow(_walk, _OUT)
