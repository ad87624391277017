"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: principal axes of a bounded sample, turned by learned rotations
(iterative quantisation), sign of each coordinate.  The first `BITS` bits, one rotation, are
the indexed code, cut into `TABLES` substrings with a table each; further rotations give
further words that only refine.  A query probes, per substring, every value within
floor(R / tables) bits, which by the pigeonhole principle retrieves every code within Hamming
radius R (where the probes would touch most of the index, all its codes are read in order
instead: the same codes are retrieved).  Retrieved codes whose words differ in few enough
bits are ranked by exact distance on the original vectors.

The radius grows until the nearest k are certain enough: the sample tells how many bits
differ at a distance, on average and by how much it varies.  Once k are found, nothing
nearer than the k-th can differ in more bits than its distance allows, but for `SURE`
standard deviations; radius and refinement follow from that.  So close neighbours take a few
probes, and only vectors without any structure, where the neighbours are hardly nearer than
the rest, take long ones.  Recall is measured against brute force in the tests.

Rows are dealt to shards (of one vector length each); every row goes to one shard, once,
and queries stream past its index.  Equal vectors are searched for once, and k + 1 of them,
those with the smallest ids, are candidates: no list can hold more.

Defined results: vectors that are null, zero or hold null or non-finite components take no
part, nor do rows without an id; vectors of different lengths are no neighbours.  A query's
own row, one row of its id and vector, is left out; other rows of the same id are
candidates, and query rows that repeat an id get a list each.  Ties go to the smaller id.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table
from .vectors import sample, usable

BITS, WORDS, TABLES = 64, 4, 4
#: Rows of a shard: 64 MB of vectors with 64 components of 4 bytes.
SHARD = 1 << 18
#: Queries that pass one shard in one task; the shard is dealt again for as many more.
QUERIES = 1 << 20
SURE = 1.2
_SUB = BITS // TABLES
_VALUES = np.arange(1 << _SUB, dtype=np.uint16)
_BY_BITS = np.argsort(np.bitwise_count(_VALUES), kind="stable").astype(np.uint16)
_BALL = np.cumsum([comb(_SUB, i) for i in range(_SUB + 1)])


class BinaryCodes:
    """Centre, axes and rotations learned from a sample, and how bits follow from distances."""

    def __init__(self, x: np.ndarray, rounds: int = 30, seed: int = 9):
        self.mean = x.mean(0)
        c = x - self.mean
        _, axes = np.linalg.eigh(c.T @ c)
        self.bits = min(BITS, x.shape[1])
        axes = axes[:, ::-1][:, : self.bits]
        p = c @ axes
        self.maps = []
        for word in range(WORDS):
            turn = np.linalg.qr(np.random.default_rng([seed, word]).normal(size=(self.bits, self.bits)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
                turn = w.T @ u.T
            self.maps.append(axes @ turn)
        self._calibrate(x)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One row of WORDS 64-bit numbers per vector."""
        out = np.zeros((len(x), WORDS), np.uint64)
        for lo in range(0, len(x), 4096):
            c = x[lo : lo + 4096].astype(np.float64) - self.mean
            for w, m in enumerate(self.maps):
                bits = np.zeros((len(c), BITS), np.uint8)
                bits[:, : self.bits] = c @ m > 0
                out[lo : lo + 4096, w] = np.packbits(bits, axis=1).view(">u8")[:, 0]
        return out

    def _calibrate(self, x: np.ndarray, queries: int = 400, near: int = 50, bins: int = 8) -> None:
        """Share of differing bits, and its deviation for one word and for all, at distances between neighbours."""
        code, d, h = self.encode(x), [], []
        for i in range(min(queries, len(x))):
            gap = ((x - x[i]) ** 2).sum(1)
            gap[i] = np.inf
            at = np.argsort(gap)[: min(near, len(x) - 1)]
            d.append(np.sqrt(gap[at]))
            h.append(np.bitwise_count(code[at] ^ code[i]))
        self.at, self.share = np.zeros(1), np.zeros(1)
        self.dev = np.full(2, 0.5)
        if len(x) > 1:
            d, h = np.concatenate(d), np.concatenate(h).astype(float) / self.bits
            parts = [p for p in np.array_split(np.argsort(d), bins) if len(p)]
            self.at = np.concatenate((self.at, [d[p].mean() for p in parts]))
            self.share = np.concatenate((self.share, np.maximum.accumulate([h[p].mean() for p in parts])))
            left = np.interp(d, self.at, self.share)
            self.dev = np.array([(h[:, 0] - left).std(), (h.mean(1) - left).std()])

    def reach(self, distance: float) -> tuple[int, int]:
        """(bits of the indexed word, bits of all words) that a vector as near as this may differ in."""
        share = np.interp(distance, self.at, self.share)
        if distance > self.at[-1] > 0:
            share = min(1.0, self.share[-1] * distance / self.at[-1])
        one, all_ = share + SURE * self.dev
        return min(self.bits, int(np.ceil(one * self.bits))), min(self.bits * WORDS, int(np.ceil(all_ * self.bits * WORDS)))


class Index:
    """The substring tables of one shard."""

    def __init__(self, words: np.ndarray):
        self.words, self.codes = words, np.ascontiguousarray(words[:, 0])
        self.parts = [((self.codes >> np.uint64(_SUB * t)) & np.uint64((1 << _SUB) - 1)).astype(np.uint16) for t in range(TABLES)]
        self.order = [np.argsort(p, kind="stable").astype(np.int32) for p in self.parts]
        self.start = [np.concatenate(([0], np.cumsum(np.bincount(p, minlength=1 << _SUB)))) for p in self.parts]

    def costly(self, radius: int) -> bool:
        """Would the probes and what they hit cost more than reading all codes (an eighth each)?"""
        probes = TABLES * int(_BALL[min(radius // TABLES, _SUB)])
        return 8 * probes * (1 + len(self.codes) / (1 << _SUB)) >= len(self.codes)

    def probe(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ from `code` in at most `radius` bits: all of them."""
        ball, found = _BY_BITS[: _BALL[min(radius // TABLES, _SUB)]], []
        for t in range(TABLES):
            at = (ball ^ np.uint16((int(code) >> (_SUB * t)) & ((1 << _SUB) - 1))).astype(np.int64)
            lo, n = self.start[t][at], self.start[t][at + 1] - self.start[t][at]
            some = n > 0
            lo, n = lo[some], n[some]
            found.append(self.order[t][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        rows = np.unique(np.concatenate(found))
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]

    def read(self, code: np.uint64) -> np.ndarray:
        """Differing bits of every code."""
        return np.bitwise_count(self.codes ^ code)


class Shard:
    """Rows of one shard with their index; counts what the last searches ranked."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, model: BinaryCodes):
        self.ids, self.x, self.model = ids, x, model
        self.index = Index(model.encode(x))
        self.ranked = self.asked = 0

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest found to each row of q, one after another."""
        for v, words in zip(q, self.model.encode(q)):
            yield self._one(v.astype(np.float64), words, k)

    def _distances(self, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[rows].astype(np.float64) - v) ** 2).sum(1))

    def _one(self, v: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(k, len(self.ids))
        radius, known, best, apart = TABLES - 1, np.zeros(0, np.int64), np.inf, None
        while True:
            if apart is None and self.index.costly(radius):
                apart = self.index.read(words[0])
                radius = max(radius, int(np.partition(apart, k - 1)[k - 1]))
            rows = self.index.probe(words[0], radius) if apart is None else np.flatnonzero(apart <= radius)
            if len(rows) >= k:
                differ = np.bitwise_count(self.index.words[rows] ^ words).sum(1, dtype=np.int64)
                kth = int(np.partition(differ, k - 1)[k - 1])
                # the k-th distance so far, from the codes nearest in all words
                few = min(len(rows), 8 * k)
                some = self._distances(v, rows[np.argpartition(differ, few - 1)[:few]])
                best = min(best, float(np.partition(some, k - 1)[k - 1]))
                one, all_ = self.model.reach(best)
                if radius >= one:
                    known = rows[differ <= max(all_, kth)]
                    break
                radius = one
            elif radius >= self.model.bits:
                known = rows
                break
            else:
                radius = min(self.model.bits, radius + TABLES)
        d = self._distances(v, known)
        self.ranked, self.asked = self.ranked + len(known), self.asked + 1
        top = np.lexsort((self.ids[known], d))[:k]
        return known[top], d[top]


def _streams(models: dict[int, BinaryCodes], k: int):
    """For mapInPandas over rows sorted by (part, asks): each shard's rows, then its queries."""

    def run(batches):
        part, held, shard = None, [], None
        for pdf in batches:
            keys, asks = pdf["part"].to_numpy(), pdf["asks"].to_numpy(bool)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                if lo == hi:
                    continue
                if keys[lo] != part:
                    part, held, shard = keys[lo], [], None
                ids, x = pdf["id"].to_numpy()[lo:hi], np.stack(pdf["v"].iloc[lo:hi].to_list())
                if not asks[lo]:
                    held.append((ids, x))
                elif held or shard:
                    if shard is None:
                        shard, held = Shard(*map(np.concatenate, zip(*held)), models[x.shape[1]]), []
                    out = []
                    for qk, v, (rows, d) in zip(ids, x, shard.search(x, k)):
                        out.append(pd.DataFrame({"qk": qk, "vec_id": shard.ids[rows], "same": (shard.x[rows] == v).all(1), "score": d}))
                    yield pd.concat(out)

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query row's k nearest found."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType
    store = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    take = lambda df: df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(store).alias("v"))
    equal = Window.partitionBy("v").orderBy("id")
    rows = shared_table(take(vectors).withColumn("_r", F.row_number().over(equal)).where(F.col("_r") <= k + 1).drop("_r"), "neighbour-rows")
    asked = shared_table(take(queries).withColumn("qn", F.monotonically_increasing_id()), "neighbour-queries")
    once = shared_table(asked.groupBy("v").agg(F.min("qn").alias("qk")), "neighbour-asked")
    lengths = [r[0] for r in once.select(F.size("v")).distinct().collect()]  # of vectors: a few
    models = {n: BinaryCodes(drawn) for n in lengths if len(drawn := sample(rows.where(F.size("v") == n), "id", "v"))}
    if not models:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(models)  # per length: four matrices of length x 64
    size = rows.groupBy(F.size("v").alias("len")).agg(F.count("*").alias("rows"))
    asks = once.groupBy(F.size("v").alias("alen")).agg(F.count("*").alias("asks"))
    parts = size.join(asks, F.col("len") == F.col("alen")).select("len", F.ceil(F.col("rows") / SHARD).cast("int").alias("shards"), F.ceil(F.col("asks") / QUERIES).cast("int").alias("blocks"))
    parts = F.broadcast(parts)  # one row per length
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    base = rows.join(parts, F.size("v") == F.col("len")).select("id", "v", F.lit(False).alias("asks"), "len", F.pmod(F.xxhash64(F.lit(21), "id"), "shards").alias("shard"), every("blocks").alias("block"))
    ask = once.join(parts, F.size("v") == F.col("len")).select(F.col("qk").alias("id"), "v", F.lit(True).alias("asks"), "len", every("shards").alias("shard"), F.pmod(F.xxhash64(F.lit(22), "qk"), "blocks").alias("block"))
    dealt = base.unionByName(ask).select("id", "v", "asks", F.xxhash64("len", "shard", "block").alias("part"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "asks")
    search = _streams_of(shared, k + 1)
    found = shared_table(dealt.mapInPandas(search, "qk long, vec_id long, same boolean, score double"), "neighbours")
    best = Window.partitionBy("qk").orderBy("score", "vec_id")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    of = asked.join(once, "v").select("qn", F.col("id").alias("query_id"), "qk")
    lists = of.join(found, "qk").withColumn("_own", F.col("same") & (F.col("vec_id") == F.col("query_id")))
    # its own row: one of those equal in id and vector
    lists = lists.withColumn("_o", F.row_number().over(Window.partitionBy("qn", "_own").orderBy("score", "vec_id"))).where(~F.col("_own") | (F.col("_o") > 1))
    order = Window.partitionBy("qn").orderBy("score", "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _streams_of(shared, k: int):
    def run(batches):
        return _streams(shared.value, k)(batches)

    return run
