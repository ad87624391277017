"""Pairs derived from lineitem, by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import header as H
from ..frame import PairsFrame, number_rows
from ..schema import STANDARD

CHROMS = {f"chr{i}": 30000 for i in range(1, 6)}
ORDER = ["chrom1", "chrom2", "pos1", "pos2", "pair_type", "readID", "strand1", "strand2"]

CONTACTS = """
select l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey||'_'||cast(l_quantity as int) as readID,
 case when l_tax=0 then '!' else 'chr'||(l_suppkey%5+1) end as chrom1,
 cast(case when l_tax=0 then 0 else l_partkey+1 end as int) as pos1,
 'chr'||(l_linenumber%5+1) as chrom2, cast(l_quantity as int) as pos2,
 case when l_tax=0 then '-' when l_linestatus='O' then '+' else '-' end as strand1,
 case when l_returnflag='R' then '-' else '+' end as strand2,
 case when l_tax=0 then 'NU' when l_discount=0 then 'UR' else 'UU' end as pair_type
from lineitem
"""


def contacts(spark: SparkSession, sf_dir: str) -> PairsFrame:
    """The contact view, without row numbers."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    df = spark.sql(CONTACTS).select(*STANDARD)
    return PairsFrame(df, H.make(STANDARD, CHROMS))


def numbered(spark: SparkSession, sf_dir: str) -> PairsFrame:
    """The same with rid: places in the order of all columns."""
    p = contacts(spark, sf_dir)
    return PairsFrame(number_rows(p.df, ORDER), p.header, "rid")


def packed(df: DataFrame) -> DataFrame:
    """With sam1 and sam2: one record on mapped sides, two where pos2 is even."""
    return df.selectExpr(
        "*",
        "case when chrom1='!' then '.' else concat_ws('\\u0019', readID, '65', chrom1, cast(pos1 as string), 'Yt:Z:UU') end as sam1",
        "case when pos2 % 2 = 0 then concat(concat_ws('\\u0019', readID, '129', chrom2, cast(pos2 as string), 'Yt:Z:UU'), '\\u0019NEXT_SAM\\u0019', concat_ws('\\u0019', readID, '2177', chrom2, cast(pos2 as string), 'Yt:Z:UU')) else concat_ws('\\u0019', readID, '129', chrom2, cast(pos2 as string), 'Yt:Z:UU') end as sam2",
    )
