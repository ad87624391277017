"""Exact and near-duplicate removal.

Two mapped pairs are linked if their chromosomes, strands and extra columns agree and their
positions differ by at most max_mismatch (method max: on either side; sum: in total).
Families are connected components of links; the row with the smallest rid is kept.

Exact removal is one window over equal positions.  Near-duplicates are swept in tiles of
pos1 and pos2: rows near a tile's border also go to the tile beyond, each tile is swept in
numpy with a union-find, and the few rows of several tiles join their families.  So a key
block of any size, and chains through any number of tiles, are spread over all tasks; a
task holds one tile at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import PairsFrame, mapped
from ..schema import DUPLICATE
from ..shared import shared_table

BLOCK = ["chrom1", "chrom2", "strand1", "strand2"]
#: Side of a tile, in positions.
TILE = 1 << 12


@dataclass(frozen=True)
class Dedup:
    """What dedup returns: all rows with keeper, is_dup, is_mapped; and the three outputs."""

    classed: DataFrame
    pairs: PairsFrame
    dups: PairsFrame
    unmapped: PairsFrame


def sweep(block: np.ndarray, pos1: np.ndarray, pos2: np.ndarray, rid: np.ndarray, radius: int, method: str) -> np.ndarray:
    """Smallest rid of each row's family; rows of different block numbers are never linked.

    Rows are brought in order of (block, pos1); offset by offset each is compared with the
    rows after it, as long as pos1 is within reach, for all rows at once."""
    order = np.lexsort((rid, pos2, pos1, block))
    b, x, y, r = block[order], pos1[order].astype(np.int64), pos2[order].astype(np.int64), rid[order]
    label = np.arange(len(r))
    at, step, links = np.arange(len(r)), 1, []
    while len(at):
        at = at[at + step < len(r)]
        to = at + step
        live = (b[at] == b[to]) & (x[to] - x[at] <= radius)
        at, to = at[live], to[live]
        dx, dy = x[to] - x[at], np.abs(y[to] - y[at])
        near = (dx + dy if method == "sum" else np.maximum(dx, dy)) <= radius
        if near.any():
            links.append((at[near], to[near]))
        step += 1
    for i, j in links and [tuple(np.concatenate(p) for p in zip(*links))]:
        while len(i):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
    while (label[label] != label).any():
        label = label[label]
    best = np.full(len(r), np.iinfo(np.int64).max)
    np.minimum.at(best, label, r)
    out = np.empty(len(r), np.int64)
    out[order] = best[label]
    return out


def keepers(df: DataFrame, rid: str, max_mismatch: int, method: str = "max", extra: list[str] = (), tile: int = TILE) -> DataFrame:
    """(rid, keeper) of mapped rows."""
    if method not in ("max", "sum"):
        raise ValueError("method is max or sum")
    block = [*BLOCK, *extra]
    rows = df.where(mapped()).select(*block, "pos1", "pos2", F.col(rid).alias("rid"))
    if max_mismatch == 0:
        w = Window.partitionBy(*block, "pos1", "pos2")
        return rows.select("rid", F.min("rid").over(w).alias("keeper"))
    local = shared_table(_swept(rows, block, max_mismatch, method, tile), "families")
    # a row of several tiles joins their families
    links = local.where("copies > 1 and rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b"))
    joined = components(links).select(F.col("id").alias("root"), "component")
    return local.where("home").join(joined, "root", "left").select("rid", F.coalesce("component", "root").alias("keeper"))


def _swept(rows: DataFrame, block: list[str], radius: int, method: str, tile: int) -> DataFrame:
    """(rid, root, copies, home): the smallest rid of each row's family within a tile.

    A row within the radius of the next tile also goes there, along either axis, so any two
    linked rows meet in the tile of the larger of their coordinates."""
    tile = max(tile, 4 * radius)
    along = lambda p: F.array_distinct(F.array(F.floor(F.col(p) / tile), F.floor((F.col(p) + radius) / tile)))
    tiles = F.flatten(F.transform(along("pos1"), lambda x: F.transform(along("pos2"), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    dealt = rows.withColumn("_t", tiles).withColumn("copies", F.size("_t")).select("*", F.posexplode("_t").alias("_i", "_c"))
    dealt = dealt.select(F.xxhash64(*block, "_c").alias("cell"), *block, "pos1", "pos2", "rid", "copies", (F.col("_i") == 0).alias("home"))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cell = pdf["cell"].to_numpy()
            # the last tile may go on in the next batch
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield families(pdf.iloc[:cut])
        if rest is not None and len(rest):
            yield families(rest)

    def families(pdf: pd.DataFrame) -> pd.DataFrame:
        # block columns too, should two tiles share a hash
        number = pdf.groupby(["cell", *block], sort=False, dropna=False).ngroup().to_numpy()
        root = sweep(number, pdf["pos1"].to_numpy(), pdf["pos2"].to_numpy(), pdf["rid"].to_numpy(), radius, method)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "root": root, "copies": pdf["copies"].to_numpy(), "home": pdf["home"].to_numpy()})

    return dealt.mapInPandas(run, "rid long, root long, copies int, home boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest number reachable from each end of the links (a, b).

    Alternating large and small stars: two pre-aggregated minima and two joins a round,
    each round a shared table.  Only rows at tile borders get here."""
    cur = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur, seen = shared_table(cur, "links"), None
    while True:
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = shared_table(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    tops = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)


def dedup(pairs: PairsFrame, max_mismatch: int = 3, method: str = "max", extra: list[str] = (), mark_dups: bool = True, keep_parent_id: bool = False, tile: int = TILE) -> Dedup:
    """Three-way split of pairs; pairs.rid must be set (file order decides who is kept)."""
    if not pairs.rid:
        raise ValueError("dedup needs the rows' places in the file (rid)")
    rid, df = pairs.rid, pairs.df
    if max_mismatch == 0:
        w = Window.partitionBy(*BLOCK, *extra, "pos1", "pos2")
        keep = F.when(mapped(), F.min(rid).over(w))
        classed = df.withColumn("keeper", keep)
    else:
        k = keepers(df, rid, max_mismatch, method, extra, tile).withColumnRenamed("rid", "_r")
        classed = df.join(k, F.col(rid) == F.col("_r"), "left").drop("_r")
    classed = classed.withColumn("is_mapped", mapped()).withColumn("is_dup", F.coalesce(F.col("keeper") != F.col(rid), F.lit(False)))
    if keep_parent_id:
        parents = df.select(F.col(rid).alias("_p"), F.col("readID").alias("parent_readID"))
        dup_parent = F.when(F.col("is_dup"), F.col("keeper"))
        classed = classed.withColumn("_k", dup_parent).join(parents, F.col("_k") == F.col("_p"), "left").drop("_p", "_k")
        classed = classed.withColumn("parent_readID", F.coalesce("parent_readID", F.lit("")))
    if mark_dups and "pair_type" in df.columns:
        kind: Column = F.when(F.col("is_dup"), F.lit(DUPLICATE)).otherwise(F.col("pair_type"))
        classed = classed.withColumn("pair_type", kind)
    work = ["keeper", "is_mapped", "is_dup"]
    step = pairs.step("dedup", f"--max-mismatch {max_mismatch} --method {method}")

    def output(where: str, parent: bool) -> PairsFrame:
        out = classed.where(where).drop(*work, *([] if parent or not keep_parent_id else ["parent_readID"]))
        return step.with_df(out).named()

    return Dedup(classed, output("is_mapped and not is_dup", False), output("is_dup", True), output("not is_mapped", True))
