"""PairsFrame: a DataFrame of pairs and its header; operators map one to another, lazily."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import header as H
from .schema import NO_CHROM
from .shared import shared_table


@dataclass(frozen=True)
class PairsFrame:
    """df holds the pairs and, if rid is set, the column with each row's place in its file."""

    df: DataFrame
    header: list[str]
    rid: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.rid]

    def with_df(self, df: DataFrame, header: list[str] | None = None) -> PairsFrame:
        return replace(self, df=df, header=self.header if header is None else header)

    def step(self, name: str, args: str = "") -> PairsFrame:
        return replace(self, header=H.add_step(self.header, name, args))

    def named(self) -> PairsFrame:
        """With the header's column line brought up to date."""
        return replace(self, header=H.set_columns(self.header, self.columns))


def mapped() -> Column:
    return (F.col("chrom1") != NO_CHROM) & (F.col("chrom2") != NO_CHROM)


def number_in_order(ordered: DataFrame, rid: str = "rid") -> DataFrame:
    """rid = 0, 1, 2 ... in the order that a sorted DataFrame has.

    The result is written once with each row's place in its partition; a partition's rows
    are then shifted by the sizes of those before, a table of one row per partition."""
    spark = ordered.sparkSession
    rows = shared_table(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = {r[0]: r[1] for r in sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0))).collect()}
    starts = F.broadcast(spark.createDataFrame(list(shift.items()) or [(0, 0)], "_part long, _shift long"))  # a row per partition
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift")
    return rows.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part").select(*ordered.columns, place.alias(rid))


def number_rows(df: DataFrame, order: list[str], rid: str = "rid") -> DataFrame:
    """rid = 0, 1, 2 ... in the order of `order`: one range-partitioned sort, no task sees all rows."""
    return number_in_order(df.orderBy(*order), rid)

