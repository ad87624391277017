"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Vectors are brought to unit length and put in the list of the nearest coarse centroid,
with a product-quantisation code of the residual and the code's exact error.  A vector
visits every list whose cell a partner could lie in: the cells whose border is nearer than
`margin` times the link radius (1.0 loses nothing; the default is for partners that differ
in any direction and is measured against brute force in the tests).  In a list, distances
from the lookup tables rule out what is further than radius + error - which loses
nothing - and the rest are compared by their exact cosine in double precision.

Equal vectors are collapsed first and counted by their number.  Lists are cut into blocks
(members x visitors) of bounded size; of a block's links only counts and a star per local
component are returned, so a group of thousands of near copies costs no more rows than it
has vectors.

Defined results: vectors that are null, zero or hold a null or non-finite component link
with nothing and are kept, alone in their component; vectors of different lengths are never
linked, each length has lists of its own.  Rows that repeat an id are vectors of their own; null ids get no name for a
component and the count of links all the same.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_components, shared_table
from .vectors import kmeans, nearest, sample, usable

PARTS, CODES, BLOCK = 8, 256, 2048


class Quantiser:
    """Coarse centroids, residual codebooks and the rule which lists a vector visits."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 3):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.centres = kmeans(x, lists, 8, seed)
        rest = x - self.centres[nearest(x, self.centres)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [kmeans(rest[:, c], CODES, 6, seed + i + 1) for i, c in enumerate(self.cuts)]
        self.norms = (self.centres * self.centres).sum(1)

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centres)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, exact error of the coded vector)."""
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.linalg.norm(rest - back, axis=1)

    def visits(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists whose cells come within `reach` of each vector (its own among them)."""
        d = self.norms - 2 * x @ self.centres.T
        # distances between centres, of the homes at hand only
        apart = self.norms[home][:, None] + self.norms - 2 * self.centres[home] @ self.centres.T
        gap = (d - d[np.arange(len(x)), home][:, None]) / (2 * np.sqrt(np.maximum(apart, 1e-12)))
        gap[np.arange(len(x)), home] = -1
        return [np.flatnonzero(g <= reach).astype(np.int32) for g in gap]

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: rows of x against coded members of a list, by table lookup."""
        total = np.zeros((len(x), len(codes)), np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            r = x[:, c] - self.centres[cell][c]
            table = ((r * r).sum(1)[:, None] - 2 * r @ b.T + (b * b).sum(1)).astype(np.float32)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _block_links(cell: int, members: pd.DataFrame, visitors: pd.DataFrame, q: Quantiser, least: float) -> pd.DataFrame:
    """(rep, links, root) of one block."""
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-5
    m, v = (np.stack([np.frombuffer(b, "<f8") for b in f["vec"]]) for f in (members, visitors))
    m_norm, v_norm = np.linalg.norm(m, axis=1), np.linalg.norm(v, axis=1)
    codes = np.stack([np.frombuffer(b, np.uint8) for b in members["codes"]])
    err = members["err"].to_numpy()
    m_id, v_id, m_n, v_n = (f[c].to_numpy() for f, c in ((members, "rep"), (visitors, "rep"), (members, "n"), (visitors, "n")))
    home = visitors["home"].to_numpy()
    back = [frozenset(np.frombuffer(b, "<i4").tolist()) for b in members["lists"]]
    ids, at = np.unique(np.concatenate((m_id, v_id)), return_inverse=True)
    m_at, v_at = at[: len(m_id)], at[len(m_id) :]
    links, found = np.zeros(len(ids), np.int64), []
    for lo in range(0, len(v), 256):
        near = q.distances(v[lo : lo + 256] / v_norm[lo : lo + 256, None], cell, codes) <= radius + err[None] + 1e-4
        i, j = np.nonzero(near)
        i += lo
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            cos = np.einsum("ij,ij->i", v[a], m[b]) / (v_norm[a] * m_norm[b])
            # a pair of one list is met from either side: take it once
            ok = (cos >= least) & (v_id[a] != m_id[b])
            ok &= (home[a] != cell) | (v_id[a] < m_id[b])
            a, b = a[ok], b[ok]
            np.add.at(links, v_at[a], m_n[b])
            # the member counts here too, unless it visits the visitor's own list
            once = np.array([h == cell or h not in back[y] for h, y in zip(home[a].tolist(), b.tolist())], bool)
            np.add.at(links, m_at[b[once]], v_n[a[once]])
            found.append((v_at[a], m_at[b]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    label = local_components(len(ids), i, j)
    some = (links > 0) | (label != np.arange(len(ids)))
    return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[label[some]]})


def vector_components(vectors: DataFrame, least: float = 0.95, margin: float = 0.5, lists: int | None = None, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), usable(F.col(vec_col)).alias("ok"))
    good = rows.where("ok")
    # equal vectors are one node, named by a number of its own: the hash of its content
    nodes = shared_table(good.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("rep", F.xxhash64("v", F.lit(1))), "vectors")
    sizes = nodes.groupBy(F.size("v")).count().collect()  # lengths of vectors: a few
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    made = {d: Quantiser(sample(nodes.where(F.size("v") == d), "rep", "v"), lists or max(4, min(4096, math.isqrt(n)))) for d, n in sizes}
    quantiser = rows.sparkSession.sparkContext.broadcast(made)  # per length: at most 4096 centroids
    reach = margin * math.sqrt(max(0.0, 2 - 2 * least))

    def assign(batches):
        pieces = (pdf.iloc[lo : lo + 1024] for pdf in batches for lo in range(0, len(pdf), 1024))
        for piece in pieces:
            for dim, part in piece.groupby(piece["v"].map(len)):
                q, x = quantiser.value[dim], np.stack(part["v"].to_list())
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                home = q.home(unit)
                codes, err = q.encode(unit, home)
                lists_of = q.visits(unit, home, reach)
                one = pd.DataFrame({"dim": dim, "rep": part["rep"].to_numpy(), "n": part["n"].to_numpy(), "home": home.astype(np.int32), "vec": [r.astype("<f8").tobytes() for r in x]})
                member = one.assign(cell=home.astype(np.int32), member=True, codes=[c.tobytes() for c in codes], err=err, lists=[t.tobytes() for t in lists_of])
                visit = one.loc[np.repeat(np.arange(len(one)), [len(t) for t in lists_of])].assign(cell=np.concatenate(lists_of), member=False, codes=None, err=0.0, lists=None)
                yield pd.concat([member, visit])[["dim", "cell", "member", "rep", "n", "home", "vec", "codes", "err", "lists"]]

    schema = "dim int, cell int, member boolean, rep long, n long, home int, vec binary, codes binary, err double, lists binary"
    dealt = shared_table(nodes.select("rep", "n", "v").mapInPandas(assign, schema), "lists")
    size = dealt.groupBy("dim", "cell").agg(F.count_if("member").alias("ms"), F.count_if(~F.col("member")).alias("vs"))
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    dealt = dealt.join(size.where("ms > 0").select("dim", "cell", cut("ms").alias("mb"), cut("vs").alias("vb")), ["dim", "cell"])
    own = F.when(F.col("member"), F.pmod("rep", F.col("mb"))).otherwise(F.pmod("rep", F.col("vb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("member"), F.col("vb")).otherwise(F.col("mb")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("x", F.when(F.col("member"), F.col("own")).otherwise(F.col("other"))).withColumn("y", F.when(F.col("member"), F.col("other")).otherwise(F.col("own")))

    def compare(key, pdf):
        member = pdf["member"].to_numpy(bool)
        if not member.any() or member.all():
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype(np.int64)
        return _block_links(key[1], pdf[member], pdf[~member], quantiser.value[key[0]], least)

    found = shared_table(dealt.groupBy("dim", "cell", "x", "y").applyInPandas(compare, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = nodes.join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(low, "component").select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(named, F.col("v") == F.col("w")).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
