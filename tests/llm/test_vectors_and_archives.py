"""Vector operators and archives against brute force, and on awkward rows."""

import base64
import collections
import gzip
import hashlib

import numpy as np
import pytest
from lociflow.llm import mih, pq_dedup, warc
from lociflow.llm.common import components, local_components

NAN, INF = float("nan"), float("inf")


def vectors(spark, n=400, dim=16):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, dim))
    for g in range(20):  # near copies, chains, exact copies
        for k in range(1, 5):
            x[g * 8 + k] = x[g * 8 + k - 1] + rng.normal(size=dim) * 0.06
        x[g * 8 + 5] = x[g * 8]
        x[g * 8 + 6] = 3 * x[g * 8]
    rows = [(i, [float(np.float32(v)) for v in r], 1, i) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * dim), (1002, [NAN] + [1.0] * (dim - 1)), (1003, [INF] + [1.0] * (dim - 1)), (1004, [None] + [1.0] * (dim - 1)), (1005, [1.0, 2.0]), (None, rows[0][1]), (3, rows[3][1])]
    return spark.createDataFrame(rows + [(i, v, 0, 0) for i, v in odd], "vec_id long, embedding array<float>, label int, rank int")


def good(df):
    rows = df.collect()
    ok = [r for r in rows if r.embedding and len(r.embedding) == 16 and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    return rows, ok, np.array([r.embedding for r in ok], np.float64)


def test_near_dedup_equals_brute_force(spark):
    df = vectors(spark)
    rows, ok, x = good(df)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    i, j = np.nonzero(link)
    label = local_components(len(ok), i, j)
    low = collections.defaultdict(list)
    for r, x_ in zip(ok, label):
        low[x_].append(r.vec_id)
    want = collections.Counter((r.vec_id, int(n), min(v for v in low[g] if v is not None)) for r, n, g in zip(ok, link.sum(1), label))
    want.update((r.vec_id, 0, r.vec_id) for r in rows if r not in ok)
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in pq_dedup.vector_components(df, margin=1.0, lists=12).collect())
    assert got == want
    found = sum(r.n_links for r in pq_dedup.vector_components(df).collect())
    assert found >= 0.9 * link.sum()
    assert pq_dedup.vector_components(df.limit(0)).count() == 0
    assert all(r.kept for r in pq_dedup.vector_components(df.where("vec_id in (1000, 1001)")).collect())


def test_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(i, [float(v) for v in base + rng.normal(size=8) * 0.01]) for i in range(150)]
    got = pq_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)} and sum(r.kept for r in got) == 1


def test_lookup_errors_bound_distances():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = pq_dedup.Quantiser(x, 8)
    home = q.home(u)
    codes, err = q.encode(u, home)
    for cell in range(3):
        m = np.flatnonzero(home == cell)
        true = np.linalg.norm(u[:40, None] - u[None, m], axis=2)
        assert (np.abs(q.distances(u[:40], cell, codes[m]) - true) <= err[m] + 1e-3).all()


def test_index_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, (800, mih.WORDS), dtype=np.uint64)
    words[:200, 0] &= np.uint64(0xF0F0F)  # some close codes
    index = mih.Index(words)
    for q in words[:20, 0]:
        for r in (0, 3, 7, 20, 27, 64):
            want = np.flatnonzero(np.bitwise_count(words[:, 0] ^ q) <= r)
            assert np.array_equal(index.probe(q, r), want)
            assert np.array_equal(np.flatnonzero(index.read(q) <= r), want)


def test_neighbours_leave_out_the_own_row_only(spark):
    one, two = [1.0] * 4, [2.0] * 4
    rows = [(100, one), (100, one), (100, two), (101, one), (102, [1.0] * 3), (200, [1.5] * 3), (300, None), (None, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in mih.nearest_neighbours(df, df.where("vec_id % 100 = 0"), 2).collect())
    assert got == sorted([(100, 1, 100, 0.0), (100, 2, 101, 0.0)] * 2 + [(100, 1, 100, 2.0), (100, 2, 100, 2.0), (200, 1, 102, 0.75**0.5)])


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD", 150)
    monkeypatch.setattr(mih, "QUERIES", 3)
    df = vectors(spark)
    _, ok, x = good(df)
    ids = [r.vec_id for r in ok]
    got = mih.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect()
    hit = n = 0
    for q in sorted({r.query_id for r in got}):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        all_ = sorted((s, i) for j, (s, i) in enumerate(zip(d, ids)) if i is not None and j != ids.index(q))
        for r in mine:
            assert any(i == r.vec_id and abs(s - r.score) < 1e-12 for s, i in all_)
        hit += len({i for _, i in all_[:10]} & {r.vec_id for r in mine})
        n += len({i for _, i in all_[:10]})
    assert n and hit >= 0.9 * n
    assert mih.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0
    few = mih.nearest_neighbours(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 4  # ids 1, 2, 3 and the row that repeats 3


def test_neighbours_recall_with_all_bits(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD", 500)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ok = [r for r in df.collect() if r.vec_id is not None and r.embedding and np.any(r.embedding)]
    x = np.array([r.embedding for r in ok], dtype=float)
    assert x.shape[1] == 64 and mih.BITS == 64 and len(x) > 3 * mih.SHARD
    ids = [r.vec_id for r in ok]
    got = collections.defaultdict(set)
    for r in mih.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hit = n = 0
    for q in sorted(i for i in ids if i % 100 == 0):
        d = ((x - x[ids.index(q)]) ** 2).sum(1)
        best = {i for _, i in sorted((s, i) for s, i in zip(d, ids) if i != q)[:10]}
        hit, n = hit + len(best & got[q]), n + len(best)
    print("recall", hit / n, n)
    assert n and hit >= 0.9 * n


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    i, j = np.array([e for e in edges if None not in e]).T
    label = local_components(1100, i, j)
    want = {int(v): int(label[v]) for v in {*i.tolist(), *j.tolist()} if (label == label[v]).sum() > 1}
    assert got == want


def pages(spark):
    rows = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "u\r\nx", ""), (5, "u", "é" * 200_000), (None, "n", "only"), (2, "http://b", "<p>one</p>"), (6, "r", "a\r\n\r\nb")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    df = pages(spark)
    table = warc.write_archives(df)
    want = collections.Counter()
    tops = {}
    for r in df.collect():
        tops[r.html or ""] = max(tops.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    for r in df.collect():
        raw = (r.html or "").encode()
        top = tops[r.html or ""]
        again = top >= 0 and r.page_id != top
        want[(r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None)] += 1
    rows = warc.read_archives(table).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {r.html or "" for r in df.collect()}
    warc.export(table, str(tmp_path)).collect()
    files = warc.read_files(spark, str(tmp_path), payloads=False).collect()
    assert collections.Counter((r.page_id, r.payload_digest) for r in files) == collections.Counter((k[0], k[2]) for k, n in want.items() for _ in range(n))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_reader_finds_faults():
    good_ = warc.record(1, "u", b"payload" * 40000, None)
    assert [h["warc-type"] for h, _ in warc.read_records(warc.warcinfo() + good_ + warc.record(2, "v", b"payload" * 40000, 1))] == ["warcinfo", "response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.read_records(good_[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(gzip.decompress(good_).replace(b"payload", b"PAYLOAD"))))
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")))


def test_archives_keep_large_ids_beside_nulls(spark):
    big = 2**53
    rows = [(big + 1, "u", "<a>"), (big + 3, "u", "<a>"), (None, "v", "<a>"), (2**63 - 1, None, None), (2**63 - 3, "w", ""), (None, None, "own"), (None, "x", "nn"), (None, "y", "nn")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    want = [(big + 1, "revisit", big + 3), (big + 3, "response", None), (None, "revisit", big + 3), (2**63 - 1, "response", None), (2**63 - 3, "revisit", 2**63 - 1)]
    assert got == collections.Counter(want + [(None, "response", None)] * 3)


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.02]), (5, [0.0, 1.0]), (6, None)]
    got = pq_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6)]
