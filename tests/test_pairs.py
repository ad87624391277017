"""Operators on pairs: hand-worked cases, relations that must hold, brute force."""

import random

import numpy as np
import pytest
from lociflow import header as H
from lociflow.frame import PairsFrame, number_rows
from lociflow.functions.condition import NotCompilable, compile_condition
from lociflow.operators import (
    by_tile, concat, coverage, dedup, filter_by_coverage, flip, mark_duplicates, merge, merge_stats, phase, remove_columns,
    restrict, sample, scaling, select, sort, split_pairs, split_sam, stats, subset_chroms,
)
from lociflow.operators.dedup import sweep
from lociflow.operators.rows import Fragments
from lociflow.operators.scaling import distance_edges
from lociflow.schema import FIELD_SEP, RECORD_SEP, STANDARD, base_name, type_of

SIZES = {"chr1": 1_000_000, "chr2": 1_000_000, "chr3": 1_000_000}


def frame(spark, rows, extra=(), header=None):
    names = [*STANDARD, *extra]
    kinds = ", ".join(f"{n} {type_of(n).simpleString()}" for n in names)
    data = [(*r, i) for i, r in enumerate(rows)]
    return PairsFrame(spark.createDataFrame(data, kinds + ", rid long"), header or H.make(names, SIZES), "rid")


def row(i, c1, p1, c2, p2, s="++", kind="UU", *more):
    return (f"r{i}", c1, p1, c2, p2, s[0], s[1], kind, *more)


def planted(n=300, seed=1):
    rng, out = random.Random(seed), []
    for _ in range(n):
        c = sorted(rng.choice(["chr1", "chr2", "chr3"]) for _ in "12")
        p1, p2, s = rng.randint(1, 99_999), rng.randint(1, 99_999), rng.choice(["++", "+-", "-+", "--"])
        for k in range(1 + rng.choice([0, 0, 1, 2])):
            out.append(row(len(out), c[0], p1 + k * rng.randint(0, 3), c[1], p2 + k * rng.randint(0, 3), s))
    out += [row(len(out) + k, "!", 0, "chr1", rng.randint(1, 9), "-+", "NU") for k in range(20)]
    rng.shuffle(out)
    return out


def brute_keepers(rows, radius, method):
    mapped = [i for i, r in enumerate(rows) if "!" not in (r[1], r[3])]
    keep = {i: i for i in mapped}
    link = {i: [] for i in mapped}
    for i in mapped:
        for j in mapped:
            a, b = rows[i], rows[j]
            if i < j and (a[1], a[3], a[5], a[6]) == (b[1], b[3], b[5], b[6]):
                d = abs(a[2] - b[2]), abs(a[4] - b[4])
                if (sum(d) if method == "sum" else max(d)) <= radius:
                    link[i].append(j)
                    link[j].append(i)
    for i in mapped:
        stack = [i] if keep[i] == i else []
        while stack:
            for j in link[stack.pop()]:
                if keep[j] > i:
                    keep[j] = i
                    stack.append(j)
    return keep


# --- names and headers


def test_types_follow_names():
    assert [type_of(c).simpleString() for c in ("pos1", "mapq1", "read_len2", "cigar1", "XX1", "rfrag_end2", "pos51")] == ["int", "int", "int", "string", "string", "int", "int"]
    assert base_name("mapq1") == "mapq" and base_name("readID") == "readID"


def test_headers():
    h = H.make(STANDARD, SIZES, "hg", ["@SQ\tSN:chr1\tLN:5", "@PG\tID:x"])
    assert H.columns(h) == STANDARD and H.chromsizes(h) == SIZES and H.chromosomes(h) == list(SIZES)
    two = H.add_step(H.add_step(h, "sort"), "sort")
    ids = [x for x in H.field(two, "samheader") if x.startswith("@PG")]
    assert len(ids) == 3 and "PP:lociflow_sort\t" in ids[2] and len(set(ids)) == 3
    assert H.chromsizes(H.subset(h, ["chr2"])) == {"chr2": 1_000_000}
    assert "#sorted: chr1-chr2-pos1-pos2" in H.mark_sorted(h)
    assert H.merge([h]) == h and H.columns(H.merge([h, two])) == STANDARD
    with pytest.raises(ValueError):
        H.merge([h, H.set_columns(h, ["a"])])
    assert H.columns(H.set_columns([x for x in h if "columns" not in x], ["a"])) == ["a"]
    H.validate(h, STANDARD)
    with pytest.raises(ValueError):
        H.validate(h, ["a"])


# --- order


def test_sort_breaks_ties_by_type_then_place(spark):
    rows = [row(i, "chr1", 5, "chr1", 9, "++", k) for i, k in enumerate(["UU", "DD", "WW", "NU", "DD"])]
    p = sort(frame(spark, rows))
    assert [r.readID for r in p.df.collect()] == ["r1", "r4", "r3", "r0", "r2"]
    with pytest.raises(ValueError):
        sort(frame(spark, rows), ["nothing"])


def test_merge_is_stable(spark):
    a = frame(spark, [row(i, "!", 0, "!", 0, "--", "NN") for i in range(200)])
    b = frame(spark, [row(1000 + i, "!", 0, "!", 0, "--", "NN") for i in range(200)])
    assert [r.readID for r in merge([a, b]).df.collect()] == [f"r{i}" for i in [*range(200), *range(1000, 1200)]]
    assert concat([a, b]).df.count() == 400


def test_rows_are_numbered_in_order(spark):
    df = frame(spark, planted()).df.drop("rid")
    order = ["chrom1", "chrom2", "pos1", "pos2", "readID"]
    got = [r.readID for r in number_rows(df, order).orderBy("rid").collect()]
    assert got == [r.readID for r in df.orderBy(*order).collect()]


# --- select

VECTOR = ["pair_type == 'UU'", "chrom1 == chrom2 and pos1 > 50", "not (chrom1 == '!')", "10 < pos1 <= 60000", "chrom1 in ['chr1', '!']", "abs(pos1 - pos2) % 3 == 1", "csv_match(chrom1, 'chr1,chr2')", "wildcard_match(chrom1, 'chr?')", "wildcard_match(readID, 'r1*')", "regex_match(chrom1, 'chr[12]')", "region_match(chrom1, pos1, 'chr1', 100, 50000)", "region_match(chrom2, pos2, 'chr1', 100)", "(pos1 - 70000) // 7 < -3", "len(readID) > 3", "readID.endswith('9')", "pair_type != 'UU' or strand1 == '-' and pos2 >= 5"]
ROWWISE = ["int(readID[1:]) % 2 == 0", "chrom1.upper() == 'CHR1'", "regex_match(readID, r'r(?P<x>\\d)(?P=x)')", "pos1 and pos2 > 5"]


@pytest.mark.parametrize("condition", VECTOR + ROWWISE)
def test_conditions_mean_what_python_means(spark, condition):
    from lociflow.functions.condition import HELPERS

    rows = planted(60)
    p = frame(spark, rows)
    if condition in VECTOR:
        compile_condition(condition, p.df.schema)
    else:
        with pytest.raises(NotCompilable):
            compile_condition(condition, p.df.schema)
    want = {r[0] for r in rows if eval(condition, dict(HELPERS), dict(zip(STANDARD, r)))}  # noqa: S307
    hit, rest = select(p, condition)
    assert {r.readID for r in hit.df.collect()} == want
    assert {r.readID for r in rest.df.collect()} == {r[0] for r in rows} - want


def test_select_options(spark):
    p = frame(spark, planted(40))
    assert select(p, "f(pos1)", startup_code="f = lambda x: x > 500")[0].df.count() == p.df.where("pos1 > 500").count()
    assert select(p, "pos1 == '7'", type_cast={"pos1": "str"})[0].df.count() == p.df.where("pos1 = 7").count()
    assert subset_chroms(p, ["chr1"]).df.where("chrom1 <> 'chr1' or chrom2 <> 'chr1'").count() == 0
    told = []
    assert remove_columns(p, ["strand1", "nope"], told.append).columns == [c for c in STANDARD if c != "strand1"] and len(told) == 2
    with pytest.raises(ValueError):
        remove_columns(p, STANDARD)


# --- dedup


@pytest.mark.parametrize("radius,method", [(0, "max"), (1, "max"), (3, "max"), (3, "sum"), (6, "sum")])
def test_dedup_equals_brute_force(spark, radius, method):
    rows = planted()
    want = brute_keepers(rows, radius, method)
    d = dedup(frame(spark, rows), radius, method, keep_parent_id=True, tile=16)
    got = {r.rid: r.keeper for r in d.classed.where("is_mapped").collect()}
    assert got == want
    assert d.unmapped.df.count() == 20 and d.pairs.columns == STANDARD
    for r in d.dups.df.collect():
        assert r.pair_type == "DD" and r.parent_readID == rows[want[r.rid]][0]


def test_chains_and_joined_families(spark):
    chain = [row(i, "chr1", 1000 + 3 * i, "chr1", 5000) for i in range(4)]
    assert [r.readID for r in dedup(frame(spark, chain)).pairs.df.collect()] == ["r0"]
    joined = [row(i, "chr1", 1000, "chr1", p) for i, p in enumerate((5000, 5004, 5002))]
    assert [r.readID for r in dedup(frame(spark, joined)).pairs.df.collect()] == ["r0"]


def test_extra_columns_and_marks(spark):
    rows = [row(i, "chr1", 5, "chr1", 9, "++", "UU", f"l{i % 2}") for i in range(4)]
    p = frame(spark, rows, ["lib"])
    assert dedup(p, 0, extra=["lib"]).pairs.df.count() == 2 and dedup(p, 3, extra=["lib"]).pairs.df.count() == 2
    assert dedup(p, 0, mark_dups=False).dups.df.where("pair_type = 'DD'").count() == 0


def test_sweep_keeps_blocks_apart():
    rng = np.random.default_rng(0)
    b, x, y = rng.integers(0, 3, 200), rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    got = sweep(b, x, y, np.arange(200), 2, "max")
    assert (b[got] == b).all() and (got <= np.arange(200)).all()


def test_by_tile(spark):
    rows = [(f"I:1:FC:{lane}:{tile}:{i}:1", "chr1", 5, "chr1", 9, "+", "+", "UU") for i, (lane, tile) in enumerate([(1, 1), (1, 1), (1, 2)])]
    got = by_tile(dedup(frame(spark, rows), keep_parent_id=True).dups.df).collect()
    assert sorted((r.tile, r.parent_tile, r.dup_count) for r in got) == [("FC:1:1", "FC:1:1", 1), ("FC:1:2", "FC:1:1", 1)]


# --- coverage


@pytest.mark.parametrize("d,method,want", [(500, "max", 2), (500, "sum", 3), (50, "max", 1), (50, "sum", 1)])
def test_own_other_end_counts(spark, d, method, want):
    got = coverage(frame(spark, [row(0, "chr1", 1000, "chr1", 1100)]).df, "rid", d, method).collect()
    assert [r.coverage for r in got] == [want]


@pytest.mark.parametrize("method", ["max", "sum"])
def test_tiles_do_not_change_counts(spark, method):
    rows = planted()
    df = frame(spark, rows).df
    ends = [(c, p, i) for i, r in enumerate(rows) if "!" not in (r[1], r[3]) for c, p in ((r[1], r[2]), (r[3], r[4]))]
    near = [sum(c == a and abs(p - q) <= 700 for a, q, _ in ends) - 1 for c, p, _ in ends]
    want = {}
    for (_, _, i), n in zip(ends, near):
        want.setdefault(i, []).append(n)
    want = {i: (max(n) if method == "max" else sum(n)) + 1 for i, n in want.items()}
    for tile in (3000, 1 << 22):
        assert {r._r: r.coverage for r in coverage(df, "rid", 700, method, tile).collect()} == want


def test_coverage_outputs_partition_the_input(spark):
    c = filter_by_coverage(frame(spark, planted()), 2, 40, mark_multi=True)
    n = [x.df.count() for x in (c.low, c.high, c.unmapped)]
    assert sum(n) == len(planted()) and n[2] == 20 and min(n) > 0
    assert c.high.df.where("pair_type <> 'DD'").count() == 0


# --- rows


def test_flip(spark):
    rows = [row(0, "chrX", 900, "chrX", 100, "+-", "UR"), row(1, "chrX", 100, "chrX", 900), row(2, "chr1", 5, "!", 0, "+-", "UN"), row(3, "chrX", 1, "chr2", 9), row(4, "chr2", 1, "chr3", 9, "+-", "UM")]
    p = flip(frame(spark, rows), ["chr3", "chr1", "chr2"])
    got = {r.readID: (r.chrom1, r.pos1, r.chrom2, r.pos2, r.strand1, r.pair_type) for r in p.df.collect()}
    assert got == {"r0": ("chrX", 100, "chrX", 900, "-", "RU"), "r1": ("chrX", 100, "chrX", 900, "+", "UU"), "r2": ("!", 0, "chr1", 5, "-", "NU"), "r3": ("chr2", 9, "chrX", 1, "+", "UU"), "r4": ("chr3", 9, "chr2", 1, "-", "MU")}
    again = flip(p, ["chr3", "chr1", "chr2"])
    assert sorted(map(str, again.df.collect())) == sorted(map(str, p.df.collect()))


def test_restrict(spark):
    bed = [("chr1", 0, 100), ("chr1", 100, 250), ("chr1", 250, 400)]
    f = Fragments(bed)
    assert f.sites["chr1"].tolist() == [0, 101, 251, 401]
    rows = [row(i, "chr1", p, c, 5) for i, (p, c) in enumerate([(0, "chr1"), (100, "chr9"), (101, "!"), (400, "chr1"), (9999, "chr1")])]
    got = {r.readID: (r.rfrag1, r.rfrag_start1, r.rfrag_end1, r.rfrag2) for r in restrict(frame(spark, rows), bed).df.collect()}
    assert got == {"r0": (0, 0, 101, 0), "r1": (0, 0, 101, -1), "r2": (1, 101, 251, -1), "r3": (2, 251, 401, 0), "r4": (2, 251, 401, 0)}


@pytest.mark.parametrize("fraction,seed", [(0.1, 1), (0.5, 42), (0.9, 12345)])
def test_sample_is_one_sequence_of_draws(spark, fraction, seed):
    rows = planted()
    rng = random.Random(seed)
    want = [r[0] for r in rows if rng.random() <= fraction]
    p = frame(spark, rows)
    for df in (p.df, p.df.repartition(7)):
        assert [r.readID for r in sample(p.with_df(df), fraction, seed).df.orderBy("rid").collect()] == want


def test_packed_records(spark):
    rec = lambda *f: FIELD_SEP.join(f)
    rows = [row(0, "chr1", 1, "chr2", 2, "++", "UU", rec("a", "65", "chr1", "Yt:Z:UU") + RECORD_SEP + rec("a", "2113", "x"), rec("a", "129", "y")), row(1, "!", 0, "chr2", 2, "-+", "NU", ".", rec("b", "129", "z"))]
    p = frame(spark, rows, ["sam1", "sam2"])
    head, lines = split_sam(p)
    assert [r.line for r in lines.orderBy("rid", "side", "k").collect()] == ["a\t65\tchr1\tYt:Z:UU", "a\t2113\tx", "a\t129\ty", "b\t129\tz"]
    assert split_pairs(p).columns == STANDARD and H.columns(split_pairs(p).header) == STANDARD
    with pytest.raises(ValueError):
        split_pairs(p.with_df(p.df.drop("sam2")))
    got = mark_duplicates(p).df.orderBy("rid").collect()
    assert got[0].sam1 == rec("a", "1089", "chr1", "Yt:Z:DD") + RECORD_SEP + rec("a", "3137", "x") and got[1].sam1 == "." and got[0].pair_type == "DD"


def test_phase(spark):
    def one(i, c1, xs, tag):
        return row(i, c1, 10, "!", 0, "+-", "UN", tag, "", 50, 0, xs, 0)

    rows = [one(0, "chr1_pat", 0, ""), one(1, "chr1_mat", 50, "chr1_pat,+10,50M,0,50,0;"), one(2, "chr1_mat", 50, "chr2_mat,+10,50M,0,50,0;"), one(3, "chr1", 0, ""), one(4, "chr1_mat", 50, "chr1_pat,+10,50M,0,40,0;")]
    got = phase(frame(spark, rows, ["XB1", "XB2", "AS1", "AS2", "XS1", "XS2"]), ("_pat", "_mat"), clean=True).df.orderBy("rid").collect()
    assert [(r.phase1, r.chrom1, r.pair_type) for r in got] == [("0", "chr1", "UN"), (".", "chr1", "UN"), ("!", "!", "MN"), ("!", "!", "MN"), ("1", "chr1", "UN")]


# --- scaling, stats


def test_areas_add_up(spark):
    p = frame(spark, [], header=H.make(STANDARD, {"a": 100, "b": 100, "c": 100}))
    s = scaling(p)
    total = sum(r.n_bp2 for r in s.cis.collect()) + sum(r.n_bp2 for r in s.trans.collect())
    assert total == 300_000 and s.cis.agg({"n_pairs": "sum"}).first()[0] == 0


def test_scaling_counts(spark):
    rows = planted()
    s = scaling(frame(spark, rows))
    edges = distance_edges()
    cis = [abs(r[2] - r[4]) for r in rows if r[1] == r[3] != "!"]
    got = {}
    for r in s.cis.collect():
        got[r.min_dist] = got.get(r.min_dist, 0) + r.n_pairs
    for lo, hi in zip(edges, edges[1:]):
        assert got.get(lo, 0) == sum(lo <= d < hi for d in cis)
    assert s.trans.agg({"n_pairs": "sum"}).first()[0] == sum(r[1] != r[3] and "!" not in (r[1], r[3]) for r in rows)
    view = scaling(frame(spark, rows), [("chr1", 0, 50000), ("chr1", 50000, 1000000)])
    assert view.cis.agg({"n_pairs": "sum"}).first()[0] == sum(r[1] == r[3] == "chr1" and (r[2] < 50000) == (r[4] < 50000) for r in rows)


def test_stats(spark):
    rows = planted()
    p = frame(spark, rows)
    d = dedup(p, 3)
    marked = p.with_df(d.classed)
    got = {r.key: r.value for r in stats(marked).collect()}
    dups = d.dups.df.count()
    assert got["total"] == len(rows) and got["total_dups"] == dups and got["total_mapped"] == len(rows) - 20
    assert got["total_nodups"] == got["total_mapped"] - dups == got["cis"] + got["trans"]
    assert got["pair_types/DD"] == dups and sum(v for k, v in got.items() if k.startswith("chrom_freq/")) == got["total_nodups"]
    assert sum(v for k, v in got.items() if k.startswith("dist_freq/")) == got["cis"]
    both = {(r["filter"], r.key): r.value for r in stats(p, {"a": "chrom1 == chrom2", "b": "pos1 > 9"}, with_chromsizes=True).collect()}
    assert both["a", "total"] == sum(r[1] == r[3] for r in rows) and both["b", "chromsizes/chr1"] == 1_000_000
    one = stats(p, with_chromsizes=True)
    twice = {r.key: r.value for r in merge_stats([one, one]).collect()}
    assert twice["total"] == 2 * len(rows) and twice["chromsizes/chr1"] == 1_000_000
