"""The operators' queries, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, langid, line_dedup, mih, mixing, pq_dedup, simhash, spbpe, toxicity, warc
from .common import fold_of

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(spark: SparkSession) -> str:
    """The model's path: spark.lociflow.tokenizer, else that of the installed vocabularies."""
    path = spark.conf.get("spark.lociflow.tokenizer", None)
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = (fold_of(F.col("doc_id"), 4) == 2).alias("held_out")
    prototypes = langid.fit(docs.where(~held))
    return langid.predict(docs, prototypes, keep=["doc_id", held])


def op3_mixing_sources(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_near_dedup(spark, sf_dir):
    return pq_dedup.vector_components(_table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark, sf_dir):
    got = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_nearest_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return mih.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_warc(spark, sf_dir):
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    got = warc.read_archives(archives, payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sentencepiece(spark, sf_dir):
    return spbpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op9_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = (fold_of(F.col("doc_id"), 5) == 0).alias("held_out")
    model = toxicity.fit(docs, labels.where(~held))
    return toxicity.score(docs, model, keep=["doc_id", held])


def op10_line_dedup(spark, sf_dir):
    got = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text", F.col("_dropped").cast("long").alias("n_dropped"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_language_id, op3_mixing_sources, op4_embedding_near_dedup, op5_simhash_near_dedup,
        op6_nearest_neighbours, op7_warc, op8_sentencepiece, op9_toxicity, op10_line_dedup,
    )
}

ORACLES: dict[str, str] = {"op3_mixing_sources": mixing.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
