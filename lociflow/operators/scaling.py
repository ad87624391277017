"""Contact frequency against distance: dense tables of counts and areas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame, mapped


@dataclass(frozen=True)
class Scaling:
    cis: DataFrame
    trans: DataFrame


def distance_edges(lo: int = 1, hi: int = 10**9, per_decade: int = 8) -> list[int]:
    """0, then distinct integers evenly spread over log distance from lo to hi."""
    n = round(np.log10(hi / lo) * per_decade)
    edges = sorted({round(lo * (hi / lo) ** (k / n)) for k in range(n + 1)})
    return edges if edges[0] == 0 else [0, *edges]


def bin_of(distance: Column, edges: list[int]) -> Column:
    """Number of the bin [edges[k], edges[k + 1]) that holds the distance, by bisection over literals."""

    def split(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(distance < edges[mid], split(lo, mid)).otherwise(split(mid, hi))

    return F.when(distance < edges[-1], split(0, len(edges) - 1))


def contact_area(lo: Column, hi: Column, length: Column) -> Column:
    """Pairs of positions lo <= d < hi apart within a region: A(lo) - A(hi), A(d) = max(L - d, 0)^2 / 2."""
    a = lambda d: F.pow(F.greatest(length - d, F.lit(0)).cast("double"), 2.0) / 2.0
    return a(lo) - a(hi)


def scaling(pairs: PairsFrame, view: list[tuple[str, int, int]] | None = None, lo: int = 1, hi: int = 10**9, per_decade: int = 8) -> Scaling:
    """cis per region, strands and distance bin; trans per ordered pair of regions and strands.

    Regions: the view, else the header's chromosomes, else what chromosomes the pairs have
    with end -1 (areas are then only formal).  Bins beyond a region's end are left out;
    all others are there, with 0 if no pair is."""
    spark, df = pairs.df.sparkSession, pairs.df
    edges = distance_edges(lo, hi, per_decade)
    sizes = H.chromsizes(pairs.header)
    known = bool(view or sizes)
    if known:
        spans = view or [(c, 0, n) for c, n in sizes.items()]
        regions = spark.createDataFrame([(i, c, int(s), int(e)) for i, (c, s, e) in enumerate(spans)], "k int, chrom string, start long, end long")
        df = df.where(mapped())
    else:
        chroms = df.select(F.col("chrom1").alias("chrom")).union(df.select("chrom2")).distinct()
        regions = chroms.select(F.xxhash64("chrom").alias("k"), "chrom", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    # one row per region: a genome's chromosomes or arms
    side = lambda s: regions.select(F.col("k").alias(f"k{s}"), F.col("chrom").alias(f"_c{s}"), F.col("start").alias(f"start{s}"), F.col("end").alias(f"end{s}"))
    rows = df.select("chrom1", F.col("pos1").cast("long").alias("pos1"), "chrom2", F.col("pos2").cast("long").alias("pos2"), "strand1", "strand2")
    inside = lambda s: (F.col(f"chrom{s}") == F.col(f"_c{s}")) & ((F.col(f"end{s}") == -1) | ((F.col(f"pos{s}") >= F.col(f"start{s}")) & (F.col(f"pos{s}") < F.col(f"end{s}"))))
    rows = rows.join(side(1), inside(1)).join(side(2), inside(2))
    distance = F.abs(F.col("pos2") - F.col("pos1"))
    region = ["k1", "k2", "strand1", "strand2"]
    counts = rows.withColumn("bin", F.when(F.col("k1") == F.col("k2"), bin_of(distance, edges)).otherwise(F.lit(-1))).groupBy(*region, "bin").agg(F.count("*").alias("n"))
    strands = F.explode(F.array(*[F.struct(F.lit(a).alias("strand1"), F.lit(b).alias("strand2")) for a in "+-" for b in "+-"])).alias("st")
    bins = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, min_dist long, max_dist long")
    length = F.col("end1") - F.col("start1")
    # the grids are made of regions, strands and bins alone: bounded by the genome
    grid = side(1).crossJoin(F.broadcast(bins)).select("*", strands).select("*", "st.*").drop("st")
    if known:
        grid = grid.where(F.col("min_dist") < length)
    cis = grid.join(counts.where("bin >= 0").select(F.col("k1").alias("_k"), F.col("strand1").alias("_s1"), F.col("strand2").alias("_s2"), F.col("bin").alias("_b"), "n"), F.expr("k1 = _k and strand1 = _s1 and strand2 = _s2 and bin = _b"), "left")
    cis = cis.select(F.col("_c1").alias("chrom1"), "start1", "end1", F.col("_c1").alias("chrom2"), F.col("start1").alias("start2"), F.col("end1").alias("end2"), "strand1", "strand2", "min_dist", "max_dist", F.coalesce("n", F.lit(0)).cast("long").alias("n_pairs"), contact_area(F.col("min_dist"), F.col("max_dist"), length).alias("n_bp2"))
    grid = side(1).crossJoin(F.broadcast(side(2))).where("k1 <> k2").select("*", strands).select("*", "st.*").drop("st")
    trans = grid.join(counts.where("bin = -1").select(F.col("k1").alias("_k"), F.col("k2").alias("_l"), F.col("strand1").alias("_s1"), F.col("strand2").alias("_s2"), "n"), F.expr("k1 = _k and k2 = _l and strand1 = _s1 and strand2 = _s2"), "left")
    area = ((F.col("end1") - F.col("start1")) * (F.col("end2") - F.col("start2"))).cast("double")
    trans = trans.select(F.col("_c1").alias("chrom1"), "start1", "end1", F.col("_c2").alias("chrom2"), "start2", "end2", "strand1", "strand2", F.coalesce("n", F.lit(0)).cast("long").alias("n_pairs"), area.alias("n_bp2"))
    return Scaling(cis, trans)
