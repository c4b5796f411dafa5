"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import alignment, bpe, fill_middle, fingerprints, group_join, language, mixing, pii, quality, toxicity, urls, warc
from auditweave.llm.common import held_out, shared_path, table
from auditweave.llm.near_dedup import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def _listed(column: str, *fields: str) -> Column:
    """An array of structs as text: fields joined by colons, entries by commas."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",").alias(column)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = language.identify(rows, model, spans=True)
    return found.select("doc_id", "held_out", "lang_pred", "score", _listed("spans", "lang", "first_word", "end_word"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and quality verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, as read back from the archives."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"), min_bytes=0)
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents with weights 1, 2, 3 in turn."""
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = toxicity.score_toxicity(rows, model, spans=True)
    return found.select("doc_id", "held_out", "score", "predicted", _listed("spans", "start", "end"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and their decoded texts, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), digests=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs, pii.train(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and the texts restored from it, as digests."""
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose three-word shingles are similar to nine tenths."""
    return group_join.similar_documents(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers in all documents, aligned and linked."""
    return alignment.alignment_counts(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline; token ids as digests, which is what its last stage returns."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_warc": op5_warc,
    "op6_mix_sources": op6_mix_sources,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": group_join.components_sql(2, 80, kept=True),
    "op5_warc": warc.REVISIT_SQL,
    "op6_mix_sources": mixing.MIXTURE_SQL,
    "op11_fill_in_middle": fill_middle.FILL_SQL,
    "op12_jaccard_join": group_join.components_sql(3, 90, kept=False),
}
