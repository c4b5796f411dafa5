"""From raw documents to token ids: language, near duplicates, personal data, mixture, tokens.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``. Null ids and texts, empty texts, repeated
rows and empty tables pass through every stage; what becomes of them is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import bpe, language, mixing, pii
from auditweave.llm.common import held_out, shared_path, table
from auditweave.llm.near_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, with the predicted one in ``lang``.

    Null texts and texts without letters have none and go. All others stay, whatever their score: a clean
    text in several languages has a low one. Without a single labelled row there is no language to
    learn, and nothing is kept.
    """
    docs = docs.select(*COLUMNS)
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify(docs, model).filter(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id.

    Of rows that repeat an id, that with the smallest hash of its text stays. Rows without an id are kept,
    each text once, whatever else resembles it.
    """
    docs = docs.select(*COLUMNS)
    named, nameless = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    kept = near_duplicates(named).filter("kept").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = named.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), *rest)).alias("row"))
    alone = nameless.groupBy("text").agg(F.min(F.struct(*[c for c in rest if c != "text"])).alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS).unionByName(alone.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "row.*").select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; ``n_chars`` follows the new text."""
    docs = docs.select(*COLUMNS)
    found = pii.find_personal_data(docs, pii.train(docs))
    return found.withColumns({"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a document without copies is left out."""
    mixed = mixing.mixture(docs, keep=("text", "lang", "n_chars")).filter("copies > 0")
    times = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select("doc_id", F.col("kept_text").alias("text"), F.col("kept_lang").alias("lang"), "source", F.col("kept_n_chars").alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every row encoded and decoded again."""
    return bpe.encode(docs, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: Stages with trained models and tokenizers have no SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is a table in the shared folder."""
    rows = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, rows, sf_dir).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
    return rows
