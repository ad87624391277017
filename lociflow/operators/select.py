"""select and its companions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame
from ..functions.condition import condition_column
from ..schema import STANDARD


def select(pairs: PairsFrame, condition: str, chroms: list[str] | None = None, startup_code: str | None = None, type_cast: dict[str, str] | None = None) -> tuple[PairsFrame, PairsFrame]:
    """(rows that meet the condition, the rest)."""
    hit = condition_column(pairs.df, condition, startup_code, type_cast)
    if chroms is not None:
        hit = hit & F.col("chrom1").isin(chroms) & F.col("chrom2").isin(chroms)
    head = pairs.header if chroms is None else H.subset(pairs.header, chroms)
    return tuple(pairs.with_df(pairs.df.where(c), head).step("select", condition) for c in (hit, ~hit))


def subset_chroms(pairs: PairsFrame, chroms: list[str]) -> PairsFrame:
    """Pairs with both sides on the given chromosomes; the header loses the others."""
    both = F.col("chrom1").isin(chroms) & F.col("chrom2").isin(chroms)
    return pairs.with_df(pairs.df.where(both), H.subset(pairs.header, chroms))


def remove_columns(pairs: PairsFrame, names: list[str], warn=None) -> PairsFrame:
    """Without some columns; required or absent ones are told to `warn`, removing all is an error."""
    gone = [c for c in names if c in pairs.columns]
    if len(gone) == len(pairs.columns):
        raise ValueError("no column would be left")
    for c in names:
        if warn and (c in STANDARD or c not in gone):
            warn(f"{c} is {'required by the format' if c in STANDARD else 'not there'}")
    return pairs.with_df(pairs.df.drop(*gone)).named()
