"""Row-wise operators: flip, mark duplicates, restrict, sample, phase, split."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame
from ..schema import DUPLICATE, FIELD_SEP, NO_CHROM, NO_FRAGMENT, NO_SAM, RECORD_SEP


def flip(pairs: PairsFrame, chroms: list[str] | None = None) -> PairsFrame:
    """Put the side that comes first (by chromosome order, then position) on the left.

    Unmapped ranks before all; of a ranked and an unranked chromosome the ranked one comes
    first; two unranked ones go by name and position.  All x1/x2 columns change sides, and
    pair_type's two letters."""
    order = [NO_CHROM, *(H.chromosomes(pairs.header) if chroms is None else chroms)]
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(dict.fromkeys(order)) for x in (c, i)])
    r1, r2 = (F.coalesce(F.element_at(ranks, F.col(c)), F.lit(-1)) for c in ("chrom1", "chrom2"))
    p1, p2 = F.col("pos1"), F.col("pos2")
    both, one = (r1 >= 0) & (r2 >= 0), (r1 >= 0) | (r2 >= 0)
    by_name = F.struct("chrom1", "pos1") <= F.struct(F.col("chrom2").alias("chrom1"), F.col("pos2").alias("pos1"))
    right = F.when(both, (r1 < r2) | ((r1 == r2) & (p1 <= p2))).when(one, r1 >= 0).otherwise(by_name)
    df = pairs.df.withColumn("_right", right)
    new: dict[str, Column] = {}
    for c in pairs.columns:
        other = c[:-1] + {"1": "2", "2": "1"}.get(c[-1], "")
        if c[-1] in "12" and other in pairs.columns:
            new[c] = F.when(F.col("_right"), F.col(c)).otherwise(F.col(other))
    if "pair_type" in pairs.columns:
        swapped = F.concat(F.substring("pair_type", 2, 1), F.substring("pair_type", 1, 1))
        new["pair_type"] = F.when(F.col("_right"), F.col("pair_type")).otherwise(swapped)
    return pairs.with_df(df.select(*[new.get(c, F.col(c)).alias(c) for c in pairs.df.columns])).step("flip")


def _tagged(packed: Column) -> Column:
    """Packed SAM records with the duplicate flag (0x400) and pair type tag set."""

    def one(record: Column) -> Column:
        f = F.split(record, FIELD_SEP)
        flag = (F.get(f, F.lit(1)).cast("int").bitwiseOR(F.lit(0x400))).cast("string")
        tags = F.transform(F.slice(f, F.lit(3), F.size(f)), lambda x: F.when(x.startswith("Yt:Z:"), F.lit(f"Yt:Z:{DUPLICATE}")).otherwise(x))
        return F.array_join(F.concat(F.slice(f, 1, 1), F.array(flag), tags), FIELD_SEP)

    done = F.array_join(F.transform(F.split(packed, RECORD_SEP), one), RECORD_SEP)
    return F.when(packed == NO_SAM, packed).otherwise(done)


def mark_duplicates(pairs: PairsFrame) -> PairsFrame:
    """Every pair becomes a duplicate: pair_type and the records in sam1, sam2."""
    new = {c: _tagged(F.col(c)) for c in ("sam1", "sam2") if c in pairs.columns}
    if "pair_type" in pairs.columns:
        new["pair_type"] = F.lit(DUPLICATE)
    return pairs.with_df(pairs.df.withColumns(new)).step("markasdup")


class Fragments:
    """Restriction sites per chromosome, from rows (chrom, start, end)."""

    def __init__(self, bed: list[tuple[str, int, int]]):
        per: dict[str, list[tuple[int, int]]] = {}
        for chrom, start, end in bed:
            per.setdefault(chrom, []).append((start, end))
        self.sites = {c: np.array([0, *(e + 1 for _, e in sorted(x))], np.int64) for c, x in per.items()}

    def find(self, chrom: pd.Series, pos: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, start, end) of the fragment of each position; past the end: the last one."""
        out = tuple(np.full(len(chrom), v, np.int32) for v in NO_FRAGMENT)
        codes, names = pd.factorize(chrom)
        for i, name in enumerate(names):
            sites = self.sites.get(name)
            if sites is None or name == NO_CHROM:
                continue
            at = np.flatnonzero(codes == i)
            k = np.clip(np.searchsorted(sites, pos.to_numpy()[at], side="right") - 1, 0, len(sites) - 2)
            for column, values in zip(out, (k, sites[k], sites[k + 1])):
                column[at] = values
        return out


def restrict(pairs: PairsFrame, bed: list[tuple[str, int, int]]) -> PairsFrame:
    """Six columns: number, start and end of either side's restriction fragment.

    Unmapped sides and chromosomes without fragments get -1, 0, 0.  The fragments of a
    genome (some million at most) are broadcast; each batch is one binary search."""
    spark = pairs.df.sparkSession
    shared = spark.sparkContext.broadcast(Fragments(bed))

    @F.pandas_udf("rfrag int, rfrag_start int, rfrag_end int")
    def find(chrom: pd.Series, pos: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("rfrag", "rfrag_start", "rfrag_end"), shared.value.find(chrom, pos))))

    df = pairs.df.withColumn("_f1", find("chrom1", "pos1")).withColumn("_f2", find("chrom2", "pos2"))
    new = {f"{c}{s}": F.col(f"_f{s}.{c}") for s in (1, 2) for c in ("rfrag", "rfrag_start", "rfrag_end")}
    return pairs.with_df(df.withColumns(new).drop("_f1", "_f2")).step("restrict").named()


def sample(pairs: PairsFrame, fraction: float, seed: int = 0, native: bool = False) -> PairsFrame:
    """Each row with probability `fraction`.

    Rows in file order take the draws of one seeded sequential generator (a row is kept if
    its draw is at most `fraction`): the result depends on nothing but the seed.  A task
    skips the draws of the rows before it.  native: Spark's own Bernoulli sample instead,
    another set of rows, for data where skipping costs too much."""
    step = pairs.step("sample", f"{fraction} --seed {seed}")
    if native or not pairs.rid:
        return step.with_df(pairs.df.sample(fraction=fraction, seed=seed))
    rid = pairs.rid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, at = random.Random(seed), 0
        for pdf in batches:
            keep = []
            for r in pdf[rid].tolist():
                while at < r:
                    rng.random()
                    at += 1
                keep.append(rng.random() <= fraction)
                at += 1
            yield pdf[np.array(keep, bool)]

    ordered = pairs.df.repartitionByRange(rid).sortWithinPartitions(rid)
    return step.with_df(ordered.mapInPandas(run, pairs.df.schema))


def _rivals(tag: Column, at: int, own: Column, mode: str) -> Column:
    """Chromosomes of the hits of an XA or XB tag that are as good as the best hit."""
    hits = F.transform(F.filter(F.split(tag, ";"), lambda x: x != ""), lambda x: F.split(x, ","))
    value = lambda x: F.get(x, F.lit(at)).cast("int")
    equal = F.filter(hits, lambda x: value(x) >= own if mode == "XB" else value(x) <= own)
    return F.transform(equal, lambda x: F.get(x, F.lit(0)))


def phase(pairs: PairsFrame, suffixes: tuple[str, str], tag_mode: str = "XB", clean: bool = False) -> PairsFrame:
    """Haplotype of either side from the chromosome's suffix and the aligner's other hits.

    Our own rule, from the public meaning of the tags (not checked against any other tool):
    a side whose best hit is unique (XS < AS) has the phase of its suffix; with hits of the
    same score on homologues with other suffixes it is `.` (undecided); with an equally
    good hit on another base chromosome it is `!`, and becomes unmapped (its letter M).
    A chromosome without one of the suffixes gives `!` as well.  phase1, phase2 are added;
    chromosomes lose their suffixes."""
    df, names = pairs.df, pairs.columns
    new: dict[str, Column] = {}
    letters = []
    for s in "12":
        chrom = F.col(f"chrom{s}")
        suffix = F.when(chrom.endswith(suffixes[0]), F.lit(suffixes[0])).when(chrom.endswith(suffixes[1]), F.lit(suffixes[1]))
        base = F.substring(chrom, F.lit(1), F.length(chrom) - F.length(suffix))
        own = F.when(suffix == suffixes[0], F.lit("0")).otherwise(F.lit("1"))
        best = F.col(f"AS{s}") if tag_mode == "XB" else F.col(f"NM{s}")
        rivals = _rivals(F.col(f"{tag_mode}{s}"), 4 if tag_mode == "XB" else 3, best, tag_mode)
        others = F.array_except(rivals, F.array(chrom))
        twin = F.size(others) > 0
        homologues = F.array(F.lit(NO_CHROM), *[F.concat(base, F.lit(x)) for x in suffixes])
        elsewhere = F.size(F.array_except(others, homologues)) > 0
        undecided = F.col(f"XS{s}") >= F.col(f"AS{s}")
        p = F.when((chrom == NO_CHROM) | suffix.isNull(), F.lit("!")).when(~undecided, own).when(elsewhere, F.lit("!")).when(twin, F.lit(".")).otherwise(own)
        lost = p == "!"
        new[f"phase{s}"] = p
        new[f"chrom{s}"] = F.when(lost, F.lit(NO_CHROM)).otherwise(base)
        new[f"pos{s}"] = F.when(lost, F.lit(0)).otherwise(F.col(f"pos{s}"))
        new[f"strand{s}"] = F.when(lost, F.lit("-")).otherwise(F.col(f"strand{s}"))
        letter = F.substring("pair_type", int(s), 1)
        letters.append(F.when(lost & (chrom != NO_CHROM), F.lit("M")).otherwise(letter))
    new["pair_type"] = F.concat(*letters)
    df = df.withColumns(new)
    if clean:
        keep = [c for c in names if c in ("readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type")]
        df = df.select(*keep, "phase1", "phase2", *([pairs.rid] if pairs.rid else []))
    return pairs.with_df(df).step("phase").named()


def split_pairs(pairs: PairsFrame) -> PairsFrame:
    """The pairs without their SAM records; one of the two sam columns alone is an error."""
    if ("sam1" in pairs.columns) != ("sam2" in pairs.columns):
        raise ValueError("only one of sam1 and sam2 is there")
    return pairs.with_df(pairs.df.drop("sam1", "sam2")).step("split").named()


def split_sam(pairs: PairsFrame) -> tuple[list[str], DataFrame]:
    """(SAM header lines, DataFrame of rid, side, k, line): side 1's records before side 2's."""
    if "sam1" not in pairs.columns or "sam2" not in pairs.columns:
        raise ValueError("sam1 and sam2 are needed")
    rid = F.col(pairs.rid) if pairs.rid else F.monotonically_increasing_id()
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"sam{s}").alias("packed")) for s in (1, 2)])).alias("x")
    rows = pairs.df.select(rid.alias("rid"), sides).select("rid", "x.*").where(F.col("packed") != NO_SAM)
    rows = rows.select("rid", "side", F.posexplode(F.split("packed", RECORD_SEP)).alias("k", "line"))
    return H.field(pairs.header, "samheader"), rows.withColumn("line", F.translate("line", FIELD_SEP, "\t"))
