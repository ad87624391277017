"""Local coverage: how many other ends lie within max_dist of each end of a pair.

Chromosomes are tiled; ends within max_dist of a border also go to the tile beyond it, and
a range frame counts within each tile, so no task holds a whole chromosome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import PairsFrame, mapped
from ..schema import DUPLICATE

TILE = 1 << 22


@dataclass(frozen=True)
class Coverage:
    """All rows with coverage (null where unmapped), and the three outputs."""

    counted: DataFrame
    low: PairsFrame
    high: PairsFrame
    unmapped: PairsFrame


def coverage(df: DataFrame, rid: str, max_dist: int = 500, method: str = "max", tile: int = TILE) -> DataFrame:
    """(rid, coverage) of mapped pairs: max counts each end itself too, sum counts one of them."""
    if method not in ("max", "sum"):
        raise ValueError("method is max or sum")
    tile = max(tile, 4 * max_dist)
    rows = df.where(mapped())
    ends = rows.select(F.col(rid).alias("_r"), F.explode(F.array(*[F.struct(F.col(f"chrom{s}").alias("c"), F.col(f"pos{s}").cast("long").alias("p"), F.lit(s).alias("s")) for s in (1, 2)])).alias("e"))
    ends = ends.select("_r", "e.*")
    home = F.floor(F.col("p") / tile)
    near = F.array_distinct(F.array(home, F.floor((F.col("p") - max_dist) / tile), F.floor((F.col("p") + max_dist) / tile)))
    dealt = ends.withColumn("home", home).withColumn("t", F.explode(near))
    w = Window.partitionBy("c", "t").orderBy("p").rangeBetween(-max_dist, max_dist)
    n = dealt.withColumn("n", F.count("*").over(w) - 1).where("t = home")
    total = F.max("n") + 1 if method == "max" else F.sum("n") + 1
    return n.groupBy("_r").agg(total.alias("coverage"))


def filter_by_coverage(pairs: PairsFrame, max_cov: int = 8, max_dist: int = 500, method: str = "max", mark_multi: bool = False, tile: int = TILE) -> Coverage:
    """Pairs with coverage up to max_cov, those above, and the unmapped."""
    got = coverage(pairs.df, pairs.rid, max_dist, method, tile)
    counted = pairs.df.join(got, F.col(pairs.rid) == F.col("_r"), "left").drop("_r")
    step = pairs.step("filterbycov", f"--max-cov {max_cov} --max-dist {max_dist}")
    out = lambda c: step.with_df(counted.where(c).drop("coverage"))
    high = out(F.col("coverage") > max_cov)
    if mark_multi:
        high = high.with_df(high.df.withColumn("pair_type", F.lit(DUPLICATE)))
    return Coverage(counted, out(F.col("coverage") <= max_cov), high, out(F.col("coverage").isNull()))
