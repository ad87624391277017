"""sort, merge, concat."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame

KEYS = ["chrom1", "chrom2", "pos1", "pos2", "pair_type"]


def keys_of(columns: list[str], keys: list[str | int]) -> list[str]:
    """Names of sort keys given by name or 0-based number; a missing one is an error."""
    out = [columns[int(k)] if str(k).isdigit() and int(k) < len(columns) and k not in columns else k for k in keys]
    if missing := [k for k in out if k not in columns]:
        raise ValueError(f"no such sort keys: {missing}")
    return out


def sort(pairs: PairsFrame, extra: list[str | int] = (), keys: list[str | int] = KEYS) -> PairsFrame:
    """By chromosomes (bytewise), positions, pair type and extra columns; ties in file order."""
    by = keys_of(pairs.columns, [*keys, *extra])
    out = pairs.with_df(pairs.df.orderBy(*by, *([pairs.rid] if pairs.rid else [])))
    out = out.step("sort", " ".join(map(str, extra)))
    return out.with_df(out.df, H.mark_sorted(out.header))


def concat(inputs: list[PairsFrame]) -> PairsFrame:
    """All rows, input by input (rid becomes (input, place) in one number)."""
    head = H.merge([p.header for p in inputs])
    names = inputs[0].columns
    frames = []
    for i, p in enumerate(inputs):
        rid = (F.lit(i).cast("long") * (1 << 48) + F.col(p.rid)) if p.rid else F.lit(None).cast("long")
        frames.append(p.df.select(*names, rid.alias("rid")))
    df = functools.reduce(lambda a, b: a.unionByName(b), frames)
    out = PairsFrame(df, head, "rid") if all(p.rid for p in inputs) else PairsFrame(df.drop("rid"), head)
    return out if len(inputs) == 1 else out.step("merge")


def merge(inputs: list[PairsFrame], keys: list[str] = KEYS) -> PairsFrame:
    """Rows of all inputs in the order of the keys; ties by input, then place in it."""
    out = concat(inputs)
    by = keys_of(out.columns, keys)
    return out.with_df(out.df.orderBy(*by, *([out.rid] if out.rid else [])))
