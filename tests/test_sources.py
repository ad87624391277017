"""Files in all formats, the command line, SAM input, streams, and the entry module."""

import json
import os

import pytest
from lociflow import header as H
from lociflow.cli import main
from lociflow.frame import PairsFrame
from lociflow.operators.parse import parse, parse2
from lociflow.schema import STANDARD, schema_of
from lociflow.sources import open_pairs, write_pairs
from lociflow.sources.pairs import export_parquet, read_header, set_columns, transfer_header

ROWS = [("NA", "chr1", 1, "chr1", 50, "+", "+", "UU", "x"), ("null", "!", 0, "chr2", 7, "-", "+", "NU", ""), ("", "chr2", 3, "chr3", 9, "+", "-", "UU", 'q"uote'), ("#hash", "chr1", 2, "chr2", 9, "+", "-", "UU", "")]
NAMES = [*STANDARD, "tag1"]


@pytest.fixture
def pairs(spark):
    head = H.make(NAMES, {"chr1": 100, "chr2": 100}, "g", ["@SQ\tSN:chr1\tLN:100"])
    head = [head[0], '#odd: "x\ty\\z"  ', *head[1:]]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "readID string, chrom1 string, pos1 int, chrom2 string, pos2 int, strand1 string, strand2 string, pair_type string, tag1 string, rid long")
    return PairsFrame(df.orderBy("rid").coalesce(1), head, "rid")


def rows_of(p):
    return [tuple(r[c] for c in p.columns) for r in p.df.orderBy("rid").collect()]


@pytest.mark.parametrize("name", ["a.pairs", "a.pairs.gz", "a.PARQUET", "a.arrow"])
def test_round_trips(spark, pairs, tmp_path, name):
    path = str(tmp_path / name)
    write_pairs(pairs, path)
    got = open_pairs(spark, path)
    assert rows_of(got) == ROWS and got.header == pairs.header and read_header(path) == pairs.header
    assert got.df.schema["pos1"].dataType.simpleString() == "int"


def test_exported_footer(spark, pairs, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "one.parquet")
    export_parquet(pairs, path)
    assert json.loads(pq.read_schema(path).metadata[b"pairs_header"]) == pairs.header
    assert rows_of(open_pairs(spark, path)) == ROWS


def test_text_numbering_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "big.pairs")
    head = H.make(STANDARD, {"chr1": 10**6})
    with open(path, "w") as f:
        f.writelines(x + "\n" for x in head)
        f.writelines(f"r{i}\tchr1\t{i}\tchr1\t{i}\t+\t+\tUU\n" for i in range(20000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = open_pairs(spark, path).df
        assert got.rdd.getNumPartitions() > 1 and got.where("rid <> pos1 or readID <> concat('r', pos1)").count() == 0 and got.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_only_file(spark, tmp_path):
    path = str(tmp_path / "none.pairs")
    with open(path, "w") as f:
        f.writelines(x + "\n" for x in H.make(STANDARD))
    assert open_pairs(spark, path).df.count() == 0
    with open(path, "w") as f:
        f.write("## pairs format v1.0.0\n")
    with pytest.raises(ValueError):
        open_pairs(spark, path)


def test_columns_by_place(pairs):
    got = set_columns(pairs, [*STANDARD, "mapq1"])
    assert got.df.schema["mapq1"].dataType.simpleString() == "int" and H.columns(got.header)[-1] == "mapq1"
    with pytest.raises(ValueError):
        set_columns(pairs, ["a"])
    assert transfer_header(pairs, H.make([*STANDARD, "cigar1"])).columns[-1] == "cigar1"


def test_command_line(spark, pairs, tmp_path):
    at = lambda n: str(tmp_path / n)
    write_pairs(pairs, at("in.pairs"))
    stop = spark.stop
    try:
        main(["sort", at("in.pairs"), "-o", at("s.parquet")])
        main(["parquet-to-csv", at("s.parquet"), "-o", at("s.pairs")])
        main(["select", "chrom1 == 'chr1'", at("s.parquet"), "-o", at("sel.pairs"), "--output-rest", at("rest.pairs")])
        main(["dedup", at("s.parquet"), "-o", at("d.pairs"), "--output-dups", at("dups.pairs"), "--output-unmapped", at("u.pairs"), "--output-stats", at("d.stats")])
        main(["stats", at("s.parquet"), "-o", at("x.stats")])
        main(["stats", "--merge", at("x.stats"), at("x.stats"), "-o", at("m.stats")])
        main(["merge", at("s.parquet"), at("s.pairs"), "-o", at("m.pairs")])
        main(["scaling", at("s.parquet"), "-o", at("sc.tsv")])
    finally:
        assert spark.stop == stop
    body = lambda n: [x.rstrip("\n") for x in open(at(n)) if not x.startswith("#") or x.startswith("#hash")]
    assert len(body("s.pairs")) == 4 and len(body("sel.pairs")) == 2 and len(body("rest.pairs")) == 2 and len(body("m.pairs")) == 8
    assert [len(body(n)) for n in ("d.pairs", "dups.pairs", "u.pairs")] == [3, 0, 1]
    assert "total\t4" in body("x.stats") and "total\t8" in body("m.stats") and "#sorted: chr1-chr2-pos1-pos2" in open(at("s.pairs")).read()


SAM = """@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:1000
a\t65\tchr1\t100\t60\t50M\t*\t0\t0\t*\t*
a\t145\tchr2\t200\t60\t50M\t*\t0\t0\t*\t*
b\t65\tchr1\t10\t60\t50M50S\t*\t0\t0\t*\t*
b\t2113\tchr2\t500\t60\t50S50M\t*\t0\t0\t*\t*
b\t129\tchr2\t600\t60\t50M\t*\t0\t0\t*\t*
c\t77\t*\t0\t0\t*\t*\t0\t0\t*\t*
c\t141\t*\t0\t0\t*\t*\t0\t0\t*\t*
d\t65\tchr1\t10\t0\t50M\t*\t0\t0\t*\t*
d\t129\tchr1\t90\t60\t50M\t*\t0\t0\t*\t*
"""


def test_sam(spark, tmp_path):
    path = str(tmp_path / "x.sam")
    with open(path, "w") as f:
        f.write(SAM)
    get = lambda **o: {r.readID: r for r in parse(spark, path, {"chr2": 0, "chr1": 0}, **o).df.collect()}
    got = get(policy="mask", add_columns=["mapq", "cigar"])
    assert (got["a"].chrom1, got["a"].pos1, got["a"].strand1, got["a"].pos2, got["a"].strand2, got["a"].pair_type) == ("chr2", 249, "-", 100, "+", "UU")
    assert got["b"].pair_type == "WW" and got["c"].pair_type == "NN" and got["d"].pair_type == "MU" and got["d"].mapq2 == 60
    assert get(policy="5unique")["b"].pair_type == "UU"
    assert get(policy="5any", readid_transform="readID + '!'")["b!"].readID == "b!"
    walks = [r for r in parse2(spark, path, add_pair_index=True).df.collect() if r.readID == "b"]
    assert sorted((r.walk_pair_index, r.walk_pair_type) for r in walks) == [(1, "R1"), (2, "R1-2")]
    wide = [r for r in parse2(spark, path, expand=True, add_pair_index=True).df.collect() if r.readID == "b"]
    assert sorted(r.walk_pair_type for r in wide) == ["E1_R1-2", "R1", "R1-2"]


def bam_of(sam):
    """The alignments as BAM: two gzip members, the second starting within a record."""
    import gzip
    import struct

    lines = sam.splitlines()
    head = [x for x in lines if x.startswith("@")]
    refs = [x.split("\t")[1][3:] for x in head]
    text = "\n".join(head).encode() + b"\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for r in refs:
        out += struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1000)
    import re

    for x in lines[len(head) :]:
        f = x.split("\t")
        cigar = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)([A-Z=])", f[5])]
        ref = refs.index(f[2]) if f[2] in refs else -1
        body = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(f[0]) + 1, int(f[4]), 0, len(cigar), int(f[1]), 3, -1, -1, 0)
        body += f[0].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in cigar) + b"\x12\x40" + bytes([1, 2, 3])
        body += b"NMC\x05" + b"XAZab\0" + b"ZBBs" + struct.pack("<i2h", 2, -1, 7)
        out += struct.pack("<i", len(body)) + body
    cut = len(out) // 2
    return gzip.compress(out[:cut]) + gzip.compress(out[cut:])


def test_bam_reads_as_its_sam(spark, tmp_path):
    from lociflow.sources.bam import sam_lines

    data = bam_of(SAM)
    lines = [x for _, x in sam_lines(data)]
    want = [x.split("\t") for x in SAM.splitlines() if not x.startswith("@")]
    assert [x.split("\t")[:6] for x in lines] == [x[:6] for x in want]
    assert lines[0].split("\t")[9:] == ["ACG", "\"#$", "NM:i:5", "XA:Z:ab", "ZB:B:s,-1,7"]
    with pytest.raises(ValueError):
        list(sam_lines(data[:-30]))
    for name, raw in (("x.bam", data), ("x.sam", SAM.encode())):
        with open(tmp_path / name, "wb") as f:
            f.write(raw)
    get = lambda n: sorted((r.readID, r.chrom1, r.pos1, r.chrom2, r.pos2, r.pair_type) for r in parse(spark, str(tmp_path / n), {"chr1": 0}).df.collect())
    assert get("x.bam") == get("x.sam") and len(get("x.sam")) == 4


def test_streams(spark, pairs, tmp_path):
    from lociflow.operators import flip, select
    from lociflow.streaming import drop_exact, running_stats, stream_parquet

    folder = str(tmp_path / "in")
    pairs.df.drop("rid").union(pairs.df.drop("rid")).write.parquet(folder)
    p = stream_parquet(spark, folder, pairs.header, NAMES)
    assert p.df.schema == schema_of(NAMES)
    once = select(flip(drop_exact(p)), "pos1 >= 0")[0]
    q = once.df.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 4
    q = running_stats(p).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("counts").collect()) == 8


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len([k for k in q if not k.startswith("op")]) > 40


@pytest.mark.parametrize("name", ["sort_default", "dedup_near_max", "coverage_sum", "flip", "restrict", "scaling_cis", "stats_totals", "split_sam", "select_bool_tree"])
def test_queries_equal_their_oracles(spark, name):
    import __spark_entry__ as e
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    got, want = e.queries()[name](spark, d).toPandas(), c.execute(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    flat = lambda x: sorted(map(str, x[cols].itertuples(index=False, name=None)))
    assert flat(got) == flat(want)
