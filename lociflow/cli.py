"""Command line: one subcommand per operator; files in, files out.

Options for threads, external compressors, memory and temporary folders are accepted
where scripts pass them, and left to Spark.
"""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from . import __version__
from . import header as H
from . import operators as O
from .frame import PairsFrame
from .operators import order
from .operators.parse import parse, parse2
from .operators.stats import to_lines as stats_lines
from .sources import open_pairs, write_pairs
from .sources.pairs import export_parquet, expand, read_header, set_columns, transfer_header


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("lociflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _first_column(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x.split()[0] for x in f if x.strip()]


def _sizes(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x.split()[0]: int(x.split()[1]) if len(x.split()) > 1 else 0 for x in f if x.strip()}


def _bed(path: str) -> list[tuple[str, int, int]]:
    with open(path, encoding="utf-8") as f:
        rows = [x.split("\t") for x in f if x.strip() and not x.startswith("#")]
    return [(r[0], int(r[1]), int(r[2])) for r in rows]


def _view(path: str | None) -> list[tuple[str, int, int]] | None:
    return None if path is None else [(r[0], int(r[1]), int(r[2])) for r in (x.rstrip("\n").split("\t") for x in open(path, encoding="utf-8").readlines()[1:])]


def _read(spark: SparkSession, path: str | None) -> PairsFrame:
    if path in (None, "", "-"):
        spool = tempfile.NamedTemporaryFile("wb", suffix=".pairs", delete=False)
        with spool:
            shutil.copyfileobj(sys.stdin.buffer, spool)
        path = spool.name
    return open_pairs(spark, path)


def _write(pairs: PairsFrame, path: str | None) -> None:
    if path in (None, "", "-"):
        sys.stdout.writelines(x + "\n" for x in H.set_columns(pairs.header, pairs.columns))
        from .sources.pairs import to_lines

        sys.stdout.writelines(r.value + "\n" for r in to_lines(pairs).toLocalIterator())
    else:
        write_pairs(pairs, path)


def _text(path: str | None, lines: list[str]) -> None:
    out = sys.stdout if path in (None, "-") else open(path, "w", encoding="utf-8")
    out.writelines(x + "\n" for x in lines)


def _table(df, path: str | None) -> None:
    rows = df.collect()  # dense summary tables
    _text(path, ["\t".join(df.columns), *("\t".join(map(str, r)) for r in rows)])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociflow", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    for flag in ("--verbose", "--debug", "--post-mortem"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--output-profile")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, many: bool = False, top=sub):
        q = top.add_parser(name)
        q.add_argument("input", nargs="*" if many else "?")
        q.add_argument("-o", "--output")
        for o in ("--nproc-in", "--nproc-out", "--cmd-in", "--cmd-out", "--nproc", "--memory", "--tmpdir", "--compress-program", "--max-nmerge"):
            q.add_argument(o)
        return q

    for name in ("csv-to-parquet", "parquet-to-csv", "markasdup"):
        add(name)
    q = add("sort")
    q.add_argument("--extra-col", action="append", default=[])
    for c in ("c1", "c2", "p1", "p2", "pt"):
        q.add_argument(f"--{c}", default=dict(zip(("c1", "c2", "p1", "p2", "pt"), order.KEYS))[c])
    add("merge", True).add_argument("--concatenate", action="store_true")
    q = sub.add_parser("select")
    q.add_argument("condition")
    q.add_argument("input", nargs="?")
    for o in ("-o/--output", "--output-rest", "--chrom-subset", "--startup-code"):
        q.add_argument(*o.split("/"))
    q.add_argument("-t", "--type-cast", nargs=2, action="append", default=[])
    q.add_argument("-r", "--remove-columns", default="")
    q = add("dedup")
    for o in ("--output-dups", "--output-unmapped", "--output-stats", "--output-bytile-stats", "--chrom-subset"):
        q.add_argument(o)
    q.add_argument("--max-mismatch", type=int, default=3)
    q.add_argument("--method", choices=("max", "sum"), default="max")
    q.add_argument("--no-mark-dups", action="store_true")
    q.add_argument("--keep-parent-id", action="store_true")
    q.add_argument("--extra-col-pair", nargs=2, action="append", default=[])
    q = add("filterbycov")
    for o in ("--output-highcov", "--output-unmapped", "--output-stats"):
        q.add_argument(o)
    q.add_argument("--max-cov", type=int, default=8)
    q.add_argument("--max-dist", type=int, default=500)
    q.add_argument("--method", choices=("max", "sum"), default="max")
    q.add_argument("--mark-multi", action="store_true")
    add("flip").add_argument("-c", "--chroms-path", required=True)
    q = sub.add_parser("sample")
    q.add_argument("fraction", type=float)
    q.add_argument("input", nargs="?")
    q.add_argument("-o", "--output")
    q.add_argument("-s", "--seed", type=int, default=0)
    add("restrict").add_argument("-f", "--frags", required=True)
    q = add("phase")
    q.add_argument("--phase-suffixes", nargs=2, required=True)
    q.add_argument("--tag-mode", choices=("XA", "XB"), default="XB")
    q.add_argument("--clean-output", action="store_true")
    q = add("stats", True)
    q.add_argument("--merge", action="store_true")
    q.add_argument("--filter", action="append", default=[])
    q.add_argument("--yaml", action="store_true")
    q.add_argument("--with-chromsizes", action="store_true")
    q.add_argument("--chrom-subset")
    q.add_argument("--n-dist-bins-decade", type=int, default=8)
    q = add("scaling")
    q.add_argument("--view")
    q.add_argument("--dist-range", type=int, nargs=2, default=(1, 10**9))
    q.add_argument("--n-dist-bins-decade", type=int, default=8)
    q = add("split")
    q.add_argument("--output-pairs")
    q.add_argument("--output-sam")
    for name in ("parse", "parse2"):
        q = add(name)
        q.add_argument("-c", "--chroms-path", required=True)
        q.add_argument("--assembly")
        q.add_argument("--min-mapq", type=int, default=1)
        q.add_argument("--walks-policy", default="5unique")
        q.add_argument("--report-alignment-end", choices="53", default="5")
        q.add_argument("--add-columns", default="")
        q.add_argument("--readid-transform")
        q.add_argument("--max-expansion-depth", type=int)
        for o in ("--drop-sam", "--no-flip", "--flip", "--add-pair-index", "--expand"):
            q.add_argument(o, action="store_true")
    h = sub.add_parser("header").add_subparsers(dest="action", required=True)
    q = add("generate", top=h)
    q.add_argument("--chroms-path")
    q.add_argument("--sam-path")
    q.add_argument("--assembly")
    q.add_argument("--columns", default=None)
    add("transfer", top=h).add_argument("-r", "--reference-file", required=True)
    add("set-columns", top=h).add_argument("-c", "--columns", required=True)
    q = add("validate-columns", top=h)
    q.add_argument("-r", "--reference-columns")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = _session()
    name = a.command
    if name in ("merge", "stats"):
        paths = expand(a.input)
        if name == "merge":
            got = [open_pairs(spark, x) for x in paths]
            return _write(O.concat(got) if a.concatenate else O.merge(got), a.output)
        if a.merge:
            rows = [("no_filter", k, int(v)) for x in paths for k, v in (line.rstrip("\n").split("\t") for line in open(x, encoding="utf-8"))]
            return _text(a.output, stats_lines(O.merge_stats([spark.createDataFrame(rows, "filter string, key string, value long")])))
        filters = dict(x.split(":", 1) for x in a.filter)
        filters = filters if a.yaml else dict(list(filters.items())[:1])
        chroms = _first_column(a.chrom_subset) if a.chrom_subset else None
        table = O.stats(_read(spark, paths[0] if paths else None), filters or None, chroms, a.with_chromsizes, a.n_dist_bins_decade)
        if not a.yaml:
            return _text(a.output, stats_lines(table))
        lines, last = [], None
        for r in table.orderBy("filter", "key").collect():  # counters
            lines += [f"{r.filter}:"] * (r.filter != last) + [f"  {r.key}: {r.value}"]
            last = r.filter
        return _text(a.output, lines)
    if name in ("parse", "parse2"):
        options = {"chroms": _sizes(a.chroms_path), "min_mapq": a.min_mapq, "report_end": a.report_alignment_end, "drop_sam": a.drop_sam, "add_columns": [c for c in a.add_columns.split(",") if c], "add_pair_index": a.add_pair_index, "readid_transform": a.readid_transform, "assembly": a.assembly}
        if name == "parse":
            return _write(parse(spark, a.input, policy=a.walks_policy, do_flip=not a.no_flip, **options), a.output)
        return _write(parse2(spark, a.input, a.expand, a.max_expansion_depth, do_flip=a.flip, **options), a.output)
    pairs = _read(spark, a.input)
    if name == "header":
        if a.action == "generate":
            sam = [x.rstrip("\n") for x in open(a.sam_path, encoding="utf-8") if x.startswith("@")] if a.sam_path else None
            names = a.columns.split(",") if a.columns else pairs.columns
            return _write(pairs.with_df(pairs.df, H.generate(names, _sizes(a.chroms_path) if a.chroms_path else None, sam, a.assembly)), a.output)
        if a.action == "transfer":
            return _write(transfer_header(pairs, read_header(a.reference_file)), a.output)
        if a.action == "set-columns":
            return _write(set_columns(pairs, a.columns.split(",")), a.output)
        H.validate(pairs.header, a.reference_columns.split(",") if a.reference_columns else pairs.columns)
        return _write(pairs, a.output)
    if name in ("csv-to-parquet", "parquet-to-csv"):
        return _write(pairs, a.output)
    if name == "sort":
        return _write(O.sort(pairs, a.extra_col, [a.c1, a.c2, a.p1, a.p2, a.pt]), a.output)
    if name == "select":
        chroms = _first_column(a.chrom_subset) if a.chrom_subset else None
        code = open(a.startup_code, encoding="utf-8").read() if a.startup_code else None
        gone = [c for c in a.remove_columns.split(",") if c]
        for p, path in zip(O.select(pairs, a.condition, chroms, code, dict(a.type_cast)), (a.output, a.output_rest)):
            if path or p is None or path == a.output:
                _write(O.remove_columns(p, gone, lambda m: print(m, file=sys.stderr)) if gone else p, path)
            if path is None and a.output_rest is None:
                break
        return None
    if name == "dedup":
        extra = [x for x, y in a.extra_col_pair if x == y]
        if len(extra) != len(a.extra_col_pair):
            raise SystemExit("an extra column pair must name one column twice")
        d = O.dedup(pairs, a.max_mismatch, a.method, extra, not a.no_mark_dups, a.keep_parent_id or bool(a.output_bytile_stats))
        if a.output_dups and a.output_dups == a.output:
            work = ["keeper", "is_mapped", "is_dup"]
            _write(d.dups.with_df(d.classed.where("is_mapped").drop(*work)), a.output)
        else:
            _write(d.pairs, a.output)
            if a.output_dups:
                _write(d.dups, a.output_dups)
        if a.output_unmapped:
            _write(d.unmapped, a.output_unmapped)
        if a.output_stats:
            marked = d.classed.withColumn("pair_type", _dup_type())
            _text(a.output_stats, stats_lines(O.stats(pairs.with_df(marked), chroms=_first_column(a.chrom_subset) if a.chrom_subset else None)))
        if a.output_bytile_stats:
            _table(O.by_tile(d.dups.df), a.output_bytile_stats)
        return None
    if name == "filterbycov":
        c = O.filter_by_coverage(pairs, a.max_cov, a.max_dist, a.method, a.mark_multi)
        for p, path in ((c.low, a.output), (c.high, a.output_highcov), (c.unmapped, a.output_unmapped)):
            if path or p is c.low:
                _write(p, path)
        if a.output_stats:
            from pyspark.sql import functions as F

            kind = F.when(F.col("coverage") > a.max_cov, F.lit("FF")).otherwise(F.col("pair_type"))
            _text(a.output_stats, stats_lines(O.stats(pairs.with_df(c.counted.withColumn("pair_type", kind)))))
        return None
    if name == "scaling":
        got = O.scaling(pairs, _view(a.view), *a.dist_range, a.n_dist_bins_decade)
        _table(got.cis.unionByName(got.trans, allowMissingColumns=True), a.output)
        return None
    if name == "split":
        if not (a.output_pairs or a.output_sam):
            raise SystemExit("at least one output is needed")
        if a.output_pairs:
            _write(O.split_pairs(pairs), a.output_pairs)
        if a.output_sam:
            head, lines = O.split_sam(pairs)
            _text(a.output_sam, [*head, *(r.line for r in lines.orderBy("rid", "side", "k").toLocalIterator())])
        return None
    out = {
        "markasdup": lambda: O.mark_duplicates(pairs),
        "flip": lambda: O.flip(pairs, _first_column(a.chroms_path)),
        "sample": lambda: O.sample(pairs, a.fraction, a.seed),
        "restrict": lambda: O.restrict(pairs, _bed(a.frags)),
        "phase": lambda: O.phase(pairs, tuple(a.phase_suffixes), a.tag_mode, a.clean_output),
    }[name]()
    return _write(out, a.output)


def _dup_type():
    from pyspark.sql import functions as F

    return F.when(F.col("is_dup"), F.lit("DD")).otherwise(F.col("pair_type"))


__all__ = ["export_parquet", "main", "parser"]
