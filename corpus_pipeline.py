"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what its
predecessor kept, reread from Parquet.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import line_dedup, mixing, simhash, spbpe, toxicity
from lociflow.llm.common import fold_of, shared_table
from lociflow.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column clashes with the score
    scored = toxicity.score(flat, model, text_col=flat.columns[names.index("text")])
    return scored.where("predicted = 0").select(*flat.columns).toDF(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each; n_chars follows the text."""
    got = line_dedup.dedup_lines(docs)
    n = F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", n).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, or repeated, to the sources' target weights."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix (repeats are rows of their own): doc_id, n_tokens and the
    digests of its ids and of the text decoded from them."""
    return spbpe.encode_documents(docs, tokenizer_path(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokens),
]

#: Toxicity scores and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
