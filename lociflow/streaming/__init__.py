"""Operators on streams of pairs.

select, flip, restrict, mark_duplicates, phase and split are stateless and take streaming
DataFrames as they are.  Here: a source, exact removal of duplicates with keyed state, and
running counters.  sort, merge, near-duplicates and coverage need all rows: use batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import PairsFrame, mapped
from ..operators.dedup import BLOCK
from ..schema import schema_of


def stream_parquet(spark: SparkSession, folder: str, header: list[str], names: list[str], files_per_trigger: int = 64) -> PairsFrame:
    """Pairs files as they arrive in a folder."""
    df = spark.readStream.schema(schema_of(names)).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return PairsFrame(df, header)


def drop_exact(pairs: PairsFrame, extra: list[str] = ()) -> PairsFrame:
    """The first to arrive of each set of exact duplicates; unmapped pairs pass.

    State grows with the distinct positions seen: give it a state store that spills."""
    keys = [*BLOCK, "pos1", "pos2", *extra]
    own = F.when(mapped(), F.lit("")).otherwise(F.col("readID"))
    df = pairs.df.withColumn("_own", own).dropDuplicates([*keys, "_own"]).drop("_own")
    return pairs.with_df(df).step("dedup")


def running_stats(pairs: PairsFrame) -> DataFrame:
    """(pair_type, is_cis, n) so far; for complete or update mode."""
    return pairs.df.groupBy("pair_type", (F.col("chrom1") == F.col("chrom2")).alias("is_cis")).agg(F.count("*").alias("n"))
