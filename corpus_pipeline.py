"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontam, langid, neardup, packing, pii
from quillgrid.llm.tables import stage

#: Language scores under this are those of no learned language, whatever the learned texts' own scores are.
LEAST_SCORE = 0.05
#: Texts of fewer letters than this hold few n-grams for a score; a language's least score falls to half for the shortest.
FEW_LETTERS = 80
_NAMES = ("pipeline lang_pred", "pipeline score")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without a letter and texts of no such language go
    (by least scores learned from the same texts). All texts with a language teach, whole.
    Where no document has a language to learn from, all stay."""
    profiles = langid.fit(docs.select("doc_id", "text", "lang"))
    if not profiles:
        return docs
    judged = stage(langid.identify(docs, profiles, names=_NAMES), "pipeline-judged")  # read for the scores and again for the rows
    least = langid.least_scores(judged.where("lang IS NOT NULL"), _NAMES)
    lang, score = (F.col(f"`{x}`") for x in _NAMES)
    bar = F.lit(LEAST_SCORE)
    for name, low in least.items():
        bar = F.when(lang == name, max(LEAST_SCORE, low)).otherwise(bar)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{M}]+", ""))  # asked only of texts under the bar
    near = F.when(score >= bar, True).otherwise(score >= bar * F.least(F.lit(1.0), 0.5 + letters / F.lit(2.0 * FEW_LETTERS)))
    kept = (lang != langid.UNKNOWN) & (score >= LEAST_SCORE) & near
    return judged.where(kept).drop(*_NAMES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicate(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts; n_chars follows."""
    clean = pii.sanitise(docs)
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the trained language profiles nor the tokenizer.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
