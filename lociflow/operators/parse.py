"""SAM alignments to pairs (parse), and complex walks (parse2).

Own rules, from the public SAM specification (not checked against any other tool):
alignments of a read name are gathered, secondary ones left out; each mapped one with at
least min_mapq is unique (U), a worse one multi-mapped (M), an unmapped one null (N).  On
each side alignments are ordered by their distance from the read's 5' end.  A pair joins
the two sides' alignments chosen by the walks policy; `all` (and parse2) gives every pair
of neighbours along the walk side 1, then side 2 backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame
from ..sources.bam import read_bam
from ..schema import FIELD_SEP, NO_CHROM, NO_SAM, RECORD_SEP, STANDARD, schema_of
from .rows import flip

POLICIES = ("mask", "5any", "5unique", "3any", "3unique", "all")
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def read_sam(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(header lines, one row per alignment line) of SAM text, or of BAM files by extension."""
    if path.lower().endswith(".bam"):
        return read_bam(spark, path)
    head = [r.value for r in spark.read.text(path).where(F.col("value").rlike("^@(HD|SQ|RG|PG|CO)\t")).collect()]
    lines = spark.read.text(path).where(~F.col("value").rlike("^@(HD|SQ|RG|PG|CO)\t"))
    return head, lines.select(F.substring_index("value", "\t", 1).alias("readID"), F.col("value").alias("line"))


def alignment(line: str, min_mapq: int, report_end: str) -> dict | None:
    """What a SAM line says; None for secondary alignments."""
    f = line.split("\t")
    flag, mapq = int(f[1]), int(f[4])
    if flag & 0x100:
        return None
    ops = [(int(n), o) for n, o in _CIGAR.findall(f[5])]
    span = sum(n for n, o in ops if o in "MDN=X")
    clip = lambda part: part[0][0] if part and part[0][1] in "SH" else 0
    head, tail = clip(ops), clip(ops[::-1])
    rev = bool(flag & 0x10)
    mapped = not flag & 4 and f[2] != "*"
    start = int(f[3])
    five, three = (start + span - 1, start) if rev else (start, start + span - 1)
    kind = "N" if not mapped else "U" if mapq >= min_mapq else "M"
    good = kind == "U"
    return {
        "side": 2 if flag & 0x80 else 1, "kind": kind, "chrom": f[2] if good else NO_CHROM,
        "pos": (five if report_end == "5" else three) if good else 0, "strand": ("-" if rev else "+") if good else "-",
        "from5": tail if rev else head, "mapq": mapq, "cigar": f[5], "read_len": len(f[9]) if f[9] != "*" else 0,
        "pos5": five if good else 0, "pos3": three if good else 0, "algn_ref_span": span if good else 0, "sam": line.replace("\t", FIELD_SEP),
    }


_NONE = {"side": 0, "kind": "N", "chrom": NO_CHROM, "pos": 0, "strand": "-", "from5": 0, "mapq": 0, "cigar": "*", "read_len": 0, "pos5": 0, "pos3": 0, "algn_ref_span": 0, "sam": NO_SAM}


def _chosen(side: list[dict], policy: str) -> dict:
    if not side:
        return _NONE
    unique = [a for a in side if a["kind"] == "U"]
    if policy.endswith("unique") and unique:
        return unique[0] if policy[0] == "5" else unique[-1]
    return side[-1] if policy[0] == "3" else side[0]


def pairs_of(lines: list[str], policy: str = "mask", min_mapq: int = 1, report_end: str = "5", expand: bool = False, max_expansion: int | None = None) -> Iterator[tuple[dict, dict, int, str]]:
    """(side 1, side 2, number in the walk, R1/R2/R1&2 kind of the step) of one read name."""
    got = [a for x in lines if (a := alignment(x, min_mapq, report_end))]
    sides = [sorted((a for a in got if a["side"] == s), key=lambda a: a["from5"]) for s in (1, 2)]
    walk = any(sum(a["kind"] != "N" for a in s) > 1 for s in sides)
    if policy == "all":
        chain = [*((a, "R1") for a in sides[0] or [_NONE]), *((a, "R2") for a in (sides[1] or [_NONE])[::-1])]
        far = len(chain) if expand and max_expansion is None else 1 + (max_expansion or 0) if expand else 1
        n = 0
        for gap in range(1, far + 1):
            for i in range(len(chain) - gap):
                n += 1
                a, b = chain[i], chain[i + gap]
                kind = a[1] if a[1] == b[1] else "R1-2"
                yield a[0], b[0], n, kind if gap == 1 else f"E{gap - 1}_{kind}"
    elif walk and policy == "mask":
        yield _NONE | {"kind": "W"}, _NONE | {"kind": "W"}, 1, "R1-2"
    else:
        yield _chosen(sides[0], policy), _chosen(sides[1], policy), 1, "R1-2"


def parse(spark: SparkSession, path: str, chroms: dict[str, int] | None = None, policy: str = "5unique", min_mapq: int = 1, report_end: str = "5", do_flip: bool = True, drop_sam: bool = False, add_columns: list[str] = (), add_pair_index: bool = False, readid_transform: str | None = None, assembly: str | None = None, expand: bool = False, max_expansion: int | None = None) -> PairsFrame:
    """Pairs of a SAM file; add_columns: base names of per-side columns (mapq, pos5, cigar ...).

    All alignments of a read name meet in one task; names are dealt evenly by hash."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    sam_head, rows = read_sam(spark, path)
    sq = H.chromsizes(H.generate([], sam=sam_head))
    sizes = {c: sq.get(c, n) for c, n in (chroms or {}).items()} | sq
    names = [*STANDARD, *([] if drop_sam else ["sam1", "sam2"]), *(["walk_pair_index", "walk_pair_type"] if add_pair_index else [])]
    names += [f"{c}{s}" for c in add_columns for s in (1, 2)]
    text = readid_transform

    def one(read: str, lines: list[str]):
        # alignments of either read, in a fixed order whatever the partitioning
        for a, b, n, kind in pairs_of(sorted(lines, key=lambda x: int(x.split("\t", 2)[1]) & 0x900), policy, min_mapq, report_end, expand, max_expansion):
            name = str(eval(text, {"readID": read, "re": re})) if text else read  # noqa: S307
            row = {"readID": name, "pair_type": a["kind"] + b["kind"], "walk_pair_index": n, "walk_pair_type": kind}
            for s, x in ((1, a), (2, b)):
                packed = RECORD_SEP.join(y.replace("\t", FIELD_SEP) for y in lines if (2 if int(y.split("\t", 2)[1]) & 0x80 else 1) == s)
                row |= {f"{c}{s}": x[c] for c in ("chrom", "pos", "strand", *[c for c in add_columns if c in x])} | {f"sam{s}": packed or NO_SAM}
                row |= {f"{c}{s}": "" for c in add_columns if c not in x}
            yield [row[c] for c in names]

    schema = schema_of(names)

    def run(batches):
        read, held = None, []
        for pdf in batches:
            out = []
            for r, line in zip(pdf["readID"], pdf["line"]):
                if r != read:
                    if held:
                        out += one(read, held)
                    read, held = r, []
                held.append(line)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(list(one(read, held)), columns=names)

    df = rows.repartition("readID").sortWithinPartitions("readID", "line").mapInPandas(run, schema)
    out = PairsFrame(df, H.generate(names, sizes, sam_head, assembly)).step("parse2" if expand or policy == "all" and not do_flip else "parse")
    return flip(out, list(sizes)) if do_flip else out


def parse2(spark: SparkSession, path: str, expand: bool = False, max_expansion: int | None = None, **options) -> PairsFrame:
    """Every step of each read's walk; with expand also pairs further apart (type E<gap>_...)."""
    return parse(spark, path, policy="all", do_flip=options.pop("do_flip", False), expand=expand, max_expansion=max_expansion, **options)

