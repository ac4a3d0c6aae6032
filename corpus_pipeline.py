"""A training-corpus pipeline over ``documents``: each stage works on what its predecessor kept.

Stages take and return the columns of ``documents``; the last one returns token ids.
None of them reads more than the named columns, and each decides row by row: rows
with equal ids are separate documents to all stages but near-duplicate removal,
which keeps one of equal rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, language, neardup, secrets
from tidelog.llm.common import stored, table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Documents whose language is less certain than this go.
LEAST_SCORE = 0.4


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the documents do not have."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text, without letters or of no language that can be told; fills in a missing ``lang``."""
    model = language.train(docs, "text", "lang")
    kept = [c for c in docs.columns if c != "doc_id"]
    told, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = language.predict(docs, "doc_id", "text", model, tuple(kept), (told, score))
    found = found.where((F.col(told) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", told)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of least id."""
    column = fresh(docs, "name")

    def name(key: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), digest)

    found = neardup.near_duplicates(docs, "doc_id", "text", size=5, percent=80)
    stay = found.where("kept").select(name(F.col("doc_id"), F.lower(F.hex("digest"))).alias(column))
    named = docs.withColumn(column, name(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))))
    return named.join(stay.distinct(), column).dropDuplicates([column]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.select(digest.alias("digest"), "text")
    found = decontaminate.decontaminate(texts, "digest", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    column = fresh(docs, "digest")
    digests = found.where("contaminated").select(F.col("digest").alias(column)).distinct()
    return docs.withColumn(column, digest).join(digests, column, "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay."""
    return secrets.redact(docs, "text").withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    return bpe.round_trip(docs, "doc_id", "text", RANK_FILE, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]
# Training, sampling and hashing have no form in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
