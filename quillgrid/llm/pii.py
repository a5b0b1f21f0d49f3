"""Personal data: fixed patterns, and terms that reveal the protected values by corpus co-occurrence.

A term discloses a protected value e of its text if knowing the term tells most of what the value tells. With
IC(e) = log2(N / N(e)) and PMI(e; t) = IC(e) + log2(N(t, e) / (N(t) + PRIOR)), the disclosure is PMI / IC: near 1 if the
term hardly occurs without the value, lower by the smoothing the fewer texts show it. All counts are of different texts
over the whole corpus, so copies do not count twice, and a term meets a value wherever in a text the two stand. A term must
have met the value, or values of its class (one domain, one network, one issuer), in JOINT texts at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgrid.llm.tables import bounded_batches, stage

KINDS = ("email", "ip", "card", "phone")
#: Texts without the value that a term is taken to have occurred in besides the counted ones.
PRIOR = 1.0
#: Texts in which a term must have met a value, or one of its class, to count as evidence: a word that stands beside a value
#: once says nothing, in a corpus of any size.
JOINT = 3
#: Bits that a value, or class, must tell to be protected: one that is in more than an eighth of the texts names nobody.
LEAST_CONTENT = 3
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.97
#: The most frequent terms are dropped before any join if they are too frequent to disclose anything: at most so many.
COMMON_TERMS = 20_000
_TRIM = ".,;:!?()[]\"'"
#: White space with the punctuation around it: splitting there trims the words as well.
_BETWEEN = r"""[.,;:!?()\[\]"']*[\x20\x09-\x0D]+[.,;:!?()\[\]"']*"""
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGNED = re.compile(r"[=:][\x20\x09]*[\"']?([A-Za-z0-9_+/=.-]{16,})")
_CREDENTIALS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey")
_WORD_TYPE = pa.struct([("word", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_BASE = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, base string, secrets string, entities array<long>, words array<struct<word:string,start:int,stop:int>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the fixed patterns: by kind, then start; leftmost, not overlapping within a kind."""
    out = []
    at = text.find("@")
    floor = 0
    while at >= 0:
        # The local part is the run of its characters before the @, no further back than the last address.
        start = at
        while start > floor and _LOCAL.fullmatch(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _named(kind: str, plain: str) -> int:
    return int.from_bytes(sha256(f"{kind}:{plain}".encode()).digest()[:8], "little", signed=True)


def protected(kind: str, value: str) -> list[int]:
    """Numbers for a value, however it is written, and for its class, so that values of one text each count together: an
    address's domain, the first three parts of an ip, a card's issuer, a phone's first five digits."""
    plain = value.lower() if kind in ("email", "ip") else value if kind == "secret" else re.sub("[^0-9]", "", value)
    class_ = {"email": plain.rpartition("@")[2], "ip": plain.rpartition(".")[0], "card": plain[:6], "phone": plain[:5]}.get(kind)
    return [_named(kind, plain), *([_named(f"{kind} class", class_)] if class_ else [])]


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(secret, start, stop) of credentials written as name = value, of 16 characters or more."""
    out = []
    for m in _ASSIGNED.finditer(text):
        end = m.start()
        while end and text[end - 1] in " \t":
            end -= 1
        if text[max(0, end - 16) : end].lower().endswith(_CREDENTIALS):
            out.append(("secret", *m.span(1)))
    return out


def _words(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The words of a text that touch none of the spans, without punctuation around them, with their places."""
    taken = sorted((a, b) for _, a, b in spans)
    out, k, reach = [], 0, -1
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a < reach:
            continue
        word = m[0]
        bare = word.strip(_TRIM)
        if bare:
            a += len(word) - len(word.lstrip(_TRIM))
            out.append({"word": bare, "start": a, "stop": a + len(bare)})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in range(10))
        for value in batch.column(2):
            text = value.as_py() or ""
            spans, secrets = base_spans(text), secret_spans(text)
            entities = list({e for k, a, b in spans + secrets for e in protected(k, text[a:b])})
            joined, more = (",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (spans, secrets))
            counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            words = _words(text, spans + secrets) if entities else []
            for column, x in zip(out, (*counts, len(secrets), sha256(joined.encode()).hexdigest(), joined, more, entities, words), strict=True):
                column.append(x)
        kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(_WORD_TYPE))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]],
            names=[x.split()[0] for x in _BASE.split(", ")],
        )


def _plain(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row the base spans, the protected values and, if there are any, all words (written to the shared folder)."""
    return stage(_plain(docs, text).mapInArrow(_scan, _BASE), "pii-base")


def term_counts(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_term): the number of different texts that a word is in, for all words of the corpus; term is a hash of
    the lower-cased word. A text with n copies counts 1/n in each, so every task sums up before anything is shuffled."""
    copies = stage(found.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1"), "pii-copies")
    weighted = _plain(docs, text).select("text_key", "text").join(copies, "text_key", "left")
    bare = F.array_distinct(F.split(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), _BETWEEN))
    said = weighted.select((F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"), F.explode(bare).alias("word")).where("word <> ''")
    counted = said.groupBy(F.xxhash64("word").alias("term")).agg(F.round(F.sum("weight")).cast("long").alias("n_term"))
    return stage(counted, "pii-terms")


def disclosure(total: float, n_entity: Column, n_both: Column, n_term: Column) -> Column:
    """Share of a value's information content that a term gives away; 0 where the value tells nothing."""
    content = F.log2(F.lit(float(total)) / n_entity)
    share = F.log2(n_both / (n_term + F.lit(PRIOR)))
    return F.when(content > 0, F.greatest(F.lit(0.0), (content + share) / content)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, start, stop, disclosure): the words of at least GENERALISE in texts with a protected value,
    by the value, or class of values, that each discloses most, of those of LEAST_CONTENT bits or more that it met in JOINT
    texts or more; found is scan(docs)."""
    valued = found.where(F.size("entities") > 0)
    met = stage(valued.select("text_key", F.explode("entities").alias("entity")).distinct(), "pii-values")
    n_entity = stage(met.groupBy("entity").agg(F.count("*").alias("n_entity")), "pii-value-counts")
    total = max(2, found.select("text_key").distinct().count())
    n_entity = n_entity.where(F.col("n_entity").between(JOINT, total / 2**LEAST_CONTENT))
    most = n_entity.agg(F.max("n_entity").alias("n")).first()["n"]
    empty = "doc_id long, text_key long, start int, stop int, disclosure double"
    if not most:
        return docs.sparkSession.createDataFrame([], empty)
    counts = term_counts(docs, found, text)
    # A term of more texts cannot reach GENERALISE for any value: n_both is at most the value's own count.
    limit = most**GENERALISE * total ** (1 - GENERALISE) - PRIOR
    common = counts.where(F.col("n_term") > limit).orderBy(F.desc("n_term"), "term").limit(COMMON_TERMS).select("term")
    spoken = valued.select("doc_id", "text_key", F.explode("words").alias("w"))
    spoken = spoken.select("doc_id", "text_key", F.xxhash64(F.lower("w.word")).alias("term"), "w.start", "w.stop")
    spoken = stage(spoken.join(F.broadcast(common), "term", "left_anti"), "pii-words")  # at most COMMON_TERMS rows
    # Only terms and values of JOINT texts or more can have met in as many.
    rare = counts.where((F.col("n_term") <= limit) & (F.col("n_term") >= JOINT))
    said = stage(spoken.select("text_key", "term").distinct().join(rare, "term"), "pii-said")
    shared = met.join(n_entity, "entity").join(said, "text_key")
    reach = F.pow("n_entity", F.lit(GENERALISE)) * F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) - PRIOR
    pairs = stage(shared.where(F.col("n_term") <= reach + 1e-6).select("text_key", "entity", "term", "n_entity", "n_term"), "pii-pairs")
    both = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= JOINT)
    rules = both.select("entity", "term", disclosure(total, F.col("n_entity"), F.col("n_both"), F.col("n_term")).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    told = pairs.join(rules, ["entity", "term"]).select("text_key", "term", "disclosure")
    scores = stage(told.groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure")), "pii-scores")
    return spoken.join(scores, ["text_key", "term"]).select("doc_id", "text_key", "start", "stop", "disclosure")


def _term_spans(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """(id, key, extra): spans of disclosing terms by row; `id` and `key` are doc_id and text_key."""
    each = disclosing_terms(docs, found, text).distinct()
    grouped = each.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "disclosure"))).alias("extra"))
    return stage(grouped.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "extra"), "pii-spans")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_found.

    spans holds kind:start:stop (code points, stop exclusive) of the four patterns by kind, then start, and after them
    those of credentials (kind `secret`) and of disclosing terms (kind `term`); n_found is the number of all but the
    terms. Null text is empty; rows with null or repeated doc_id are kept.
    """
    found = scan(docs, text)
    extra = _term_spans(docs, found, text)
    joined = found.join(extra, found["doc_id"].eqNullSafe(extra["id"]) & (found["text_key"] == extra["key"]), "left")
    more = F.array_join(F.transform("extra", lambda s: F.concat(F.lit("term:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("secrets") != "", F.col("secrets")), F.when(F.col("extra").isNotNull(), more))
    n_term = F.greatest(F.coalesce(F.size("extra"), F.lit(0)).cast("long"), F.lit(0))
    n_found = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_secret")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), "n_secret", n_term.alias("n_term"), n_found.alias("n_found"))


def redact(text: str, extra: list[dict] | None) -> str:
    """text with every base span and credential replaced by its kind in angle brackets, disclosing terms of at least REMOVE removed
    and weaker ones generalised to <number>, <name> or <word>. Of overlapping spans the first, longest is used."""
    marks = [(a, b, f"<{k}>") for k, a, b in base_spans(text) + secret_spans(text)]
    for s in extra or []:
        word = text[s["start"] : s["stop"]]
        general = "<number>" if word[:1].isdigit() else "<name>" if word[:1].isupper() else "<word>"
        marks.append((s["start"], s["stop"], "" if s["disclosure"] >= REMOVE else general))
    out, at = [], 0
    for a, b, mark in sorted(marks, key=lambda m: (m[0], -m[1], m[2])):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        elif b > at:  # the rest of an overlapping span goes too
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data taken out of `text`; all rows and columns stay. Null text stays null."""
    found = scan(docs)
    extra = _term_spans(docs, found, "text")
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    joined = docs.join(extra, docs["doc_id"].cast("long").eqNullSafe(extra["id"]) & (key == extra["key"]), "left")
    place, names = docs.columns.index("text"), docs.columns
    # Plain names while Python has the rows: those of docs may hold dots.
    plain = [f"c{i}" for i in range(len(names))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, docs.schema, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            marks = columns.pop().to_pylist()
            texts = [None if t is None else redact(t, x) for t, x in zip(columns[place].to_pylist(), marks, strict=True)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    return joined.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(names, plain, strict=True)], extra["extra"].alias("extra")).mapInArrow(run, schema).toDF(*names)
