"""Summary counters, from one pass over the pairs.

Pairs are first summed up in a small cube (chromosomes, strands, pair type, distance bin);
every counter is a sum over the cube.  Filters are conditional counts of the same pass.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame
from ..functions.condition import condition_column
from ..schema import NO_CHROM
from .scaling import bin_of, distance_edges

NO_FILTER = "no_filter"
#: Distances from which cis pairs are counted.
CIS_FROM = [1000, 2000, 4000, 10000, 20000, 40000]


def stats(pairs: PairsFrame, filters: dict[str, str] | None = None, chroms: list[str] | None = None, with_chromsizes: bool = False, per_decade: int = 8) -> DataFrame:
    """(filter, key, value): total, total_unmapped, total_single_sided_mapped, total_mapped,
    total_dups, total_nodups, cis, trans, pair_types/T, cis_DISTANCE+, chrom_freq/A/B,
    dist_freq/LO-HI/STRANDS, chromsizes/C.  Pair type DD counts as duplicate; chromosome,
    cis/trans and distance counters leave duplicates out."""
    df = pairs.df
    if chroms is not None:
        df = df.where(F.col("chrom1").isin(chroms) & F.col("chrom2").isin(chroms))
    edges = distance_edges(1, 10**9, per_decade)
    distance = F.abs(F.col("pos2").cast("long") - F.col("pos1").cast("long"))
    cis = (F.col("chrom1") == F.col("chrom2")) & (F.col("chrom1") != NO_CHROM)
    names = filters or {NO_FILTER: "True"}
    hits = [F.count_if(F.lit(True) if c == "True" else condition_column(df, c)).alias(f"f{i}") for i, c in enumerate(names.values())]
    least = F.lit(-1)
    for d in sorted(CIS_FROM):
        least = F.when(distance >= d, F.lit(d)).otherwise(least)
    cube = df.groupBy("chrom1", "chrom2", "strand1", "strand2", "pair_type", F.when(cis, bin_of(distance, edges)).alias("bin"), F.when(cis, least).alias("least")).agg(*hits)
    cube = cube.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"f{i}").alias("n")) for i, n in enumerate(names)])).alias("x"))
    no1, no2 = F.col("chrom1") == NO_CHROM, F.col("chrom2") == NO_CHROM
    dup, whole = F.col("pair_type") == "DD", ~no1 & ~no2
    good = whole & ~dup
    labels = F.array([F.lit(f"{a}-{b}") for a, b in zip(edges, edges[1:])])
    keys = [
        F.lit("total"),
        F.when(no1 & no2, F.lit("total_unmapped")).when(no1 | no2, F.lit("total_single_sided_mapped")).otherwise(F.lit("total_mapped")),
        F.when(whole & dup, F.lit("total_dups")).when(whole, F.lit("total_nodups")),
        F.when(good & (F.col("chrom1") == F.col("chrom2")), F.lit("cis")).when(good, F.lit("trans")),
        F.concat(F.lit("pair_types/"), F.col("pair_type")),
        F.when(good, F.concat_ws("/", F.lit("chrom_freq"), "chrom1", "chrom2")),
        F.when(good & F.col("bin").isNotNull(), F.concat(F.lit("dist_freq/"), F.get(labels, F.col("bin")), F.lit("/"), "strand1", "strand2")),
        *[F.when(good & (F.col("least") >= d), F.lit(f"cis_{d // 1000}kb+")) for d in CIS_FROM],
    ]
    counted = cube.select(F.col("x.filter").alias("filter"), F.col("x.n").alias("n"), F.explode(F.array(*keys)).alias("key")).where("key is not null")
    spark = df.sparkSession
    out = counted.groupBy("filter", "key").agg(F.sum("n").alias("value"))
    fixed = ["total", "total_unmapped", "total_single_sided_mapped", "total_mapped", "total_dups", "total_nodups", "cis", "trans", *[f"cis_{d // 1000}kb+" for d in CIS_FROM]]
    zeros = spark.createDataFrame([(f, k, 0) for f in names for k in fixed], "filter string, key string, value long")
    sizes = {c: n for c, n in H.chromsizes(pairs.header).items() if chroms is None or c in chroms} if with_chromsizes else {}
    out = out.unionByName(zeros).groupBy("filter", "key").agg(F.sum("value").alias("value")).where((F.col("value") > 0) | F.col("key").isin(fixed))
    if sizes:
        out = out.unionByName(spark.createDataFrame([(f, f"chromsizes/{c}", n) for f in names for c, n in sizes.items()], "filter string, key string, value long"))
    return out


def merge_stats(tables: list[DataFrame]) -> DataFrame:
    """Counters of several runs added up (chromosome sizes taken once)."""
    all_ = functools.reduce(lambda a, b: a.unionByName(b), tables)
    value = F.when(F.col("key").startswith("chromsizes/"), F.max("value")).otherwise(F.sum("value"))
    return all_.groupBy("filter", "key").agg(value.alias("value"))


def by_tile(dups: DataFrame) -> DataFrame:
    """(tile, parent_tile, dup_count) of duplicates whose read ids have the form
    instrument:run:flowcell:lane:tile:x:y; needs parent_readID."""
    tile = lambda c: F.concat_ws(":", *[F.get(F.split(c, ":"), F.lit(k)) for k in (2, 3, 4)])
    rows = dups.where(F.col("parent_readID") != "").select(tile("readID").alias("tile"), tile("parent_readID").alias("parent_tile"))
    return rows.groupBy("tile", "parent_tile").agg(F.count("*").alias("dup_count"))


def to_lines(table: DataFrame) -> list[str]:
    """key<TAB>value lines of one filter's counters, in the order of keys."""
    return [f"{r.key}\t{r.value}" for r in table.orderBy("key").collect()]  # counters, not rows of data
