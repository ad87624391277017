"""Near-duplicates by SimHash: pigeonhole blocks of the fingerprint, join on blocks, verify Hamming.

A document's words are lower-cased (A-Z only) runs of characters other than ASCII white
space; its features are its w-word shingles, repeats included (fewer words: the whole
sequence).  A fingerprint bit is 1 if it is set in over half of the features' XXH64
hashes (seed 42).  Texts that are null or have no word get fingerprint zero and are linked
like any other.  Equal fingerprints are collapsed first, so a group of thousands of copies
is one node; hot blocks are split (common.pair_blocks).  Rows with equal ids are rows of
their own and get equal results; null ids never become a component's name while another
id is there.  Extra columns are left as they are.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, components, local_components, map_text, pair_blocks, shared_table, whole_groups

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Rows of one hot block compared in one call.
BLOCK_ROWS = 4096
#: Shingles of one block where candidate groups are compared exactly (8 bytes each); a document counts as some more.
BLOCK_SHINGLES, ROW_SHINGLES = 1 << 20, 256


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, in order, as unsigned 64-bit numbers."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, n)
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(flat[s:e], SEED) for s, e in zip(starts[: n - w + 1].tolist(), ends[w - 1 :].tolist())], np.uint64
    )


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 hash bits of each feature: the splitmix64 finaliser of h + k * golden ratio."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority bits of hashes: `words` 64-bit numbers, the first from the hashes themselves."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(h) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            part = h[at : at + 4096]
            bits = np.unpackbits((_mixed(part, k) if k else part).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(0, dtype=np.uint32)
        out[k] = np.packbits(ones * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1, distinct: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, h, fp, sig) per row: h the text's hash, fp the first 64 bits as long, sig all bits as binary (big-endian)."""

    def compute(texts):
        hashes = (shingle_hashes(t, width) for t in texts)
        a = np.array([fingerprint(np.unique(h) if distinct else h, words) for h in hashes], np.uint64).reshape(len(texts), words)
        return a[:, 0].copy().view(np.int64), [x.tobytes() for x in a.astype(">u8")]

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return map_text(base, "text", compute, "fp long, sig binary")


def pigeonhole_keys(bits: int) -> list[list[int]]:
    """Block sets for `bits` differing bits of 64: cut into bits + 2 blocks, at least two of
    which are untouched, so any close pair agrees on one of the pairs of blocks."""
    blocks = np.array_split(np.arange(64), bits + 2)
    return [np.concatenate(c).tolist() for c in itertools.combinations(blocks, 2)]


def spread_keys(parts: int, chosen: int, n_keys: int, bits: int = 64) -> list[list[int]]:
    """n_keys sets of `chosen` of `parts` equal blocks of a signature, drawn evenly: for pairs
    beyond what a full pigeonhole can cover, each differing bit spoils one block only."""
    blocks = np.array_split(np.arange(bits), parts)
    rng, use, keys = np.random.default_rng(7), np.zeros(parts), set()
    while len(keys) < n_keys:
        pick = tuple(sorted(np.lexsort((rng.random(parts), use))[:chosen].tolist()))
        if pick in keys:
            pick = tuple(sorted(rng.choice(parts, chosen, replace=False).tolist()))
        if pick not in keys:
            keys.add(pick)
            use[list(pick)] += 1
    return [np.concatenate([blocks[b] for b in k]).tolist() for k in sorted(keys)]


def _key(i: int, positions: list[int]) -> Column:
    """Hash of key number i: the signature's bits at these positions (0: the first bit of fp)."""
    masks: dict[int, int] = {}
    for p in positions:
        masks[p // 64] = masks.get(p // 64, 0) | 1 << (63 - p % 64)
    words = {0: F.col("fp")}
    for k in masks:
        words.setdefault(k, F.conv(F.hex(F.substring("sig", 8 * k + 1, 8)), 16, -10).cast("long"))
    signed = {k: m - (1 << 64) if m >> 63 else m for k, m in masks.items()}
    return F.xxhash64(F.lit(i), *[words[k].bitwiseAND(F.lit(m)) for k, m in sorted(signed.items())])


def _close_pairs(nodes: DataFrame, keys: list[list[int]], max_bits: int, max_sig_bits: int | None) -> DataFrame:
    """Edges (a, b) that connect all nodes linked by a pair within max_bits; nodes: (rep, fp, sig).

    Every node goes to one bucket per key; a task reads its buckets sorted and compares
    within them in numpy.  Of a bucket's links only a star per local component is
    returned, never all pairs."""
    key = F.explode(F.array(*[_key(i, k) for i, k in enumerate(keys)])).alias("key")
    dealt = pair_blocks(nodes.select("rep", "fp", "sig", key), "key", "fp", BLOCK_ROWS)
    dealt = dealt.withColumn("group", F.xxhash64("key", "lo", "hi"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "rep")

    def links(pdf: pd.DataFrame):
        group, rep, blk = (pdf[c].to_numpy() for c in ("group", "rep", "blk"))
        fp = pdf["fp"].to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(pdf["sig"]), ">u8").reshape(len(pdf), -1).astype(np.uint64)
        cross = pdf["lo"].to_numpy() != pdf["hi"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        end = np.repeat(np.concatenate((start[1:], [len(pdf)])), np.diff(np.concatenate((start, [len(pdf)]))))
        at, step, found = np.arange(len(pdf)), 1, []
        while len(at):
            at = at[at + step < end[at]]
            to = at + step
            near = np.bitwise_count(fp[at] ^ fp[to]) <= max_bits
            i, j = at[near], to[near]
            keep = ~(cross[i] & (blk[i] == blk[j]))
            i, j = i[keep], j[keep]
            if max_sig_bits is not None and len(i):
                keep = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64) <= max_sig_bits
                i, j = i[keep], j[keep]
            if len(i):
                found.append((i, j))
            step += 1
        if not found:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        i, j = (np.concatenate(x) for x in zip(*found))
        label = local_components(len(pdf), i, j)
        own = np.flatnonzero(label != np.arange(len(pdf)))
        return pd.DataFrame({"a": rep[own], "b": rep[label[own]]}).drop_duplicates()

    rows = dealt.select("group", "lo", "hi", "blk", "rep", "fp", "sig")
    return rows.mapInPandas(whole_groups(links), "a long, b long").distinct()


def alike_components(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set of distinct hashes the first of those it is linked with: Jaccard >= least, chains count.

    A search from each open set in turn that compares with sets not reached yet only.
    Empty sets are linked with nothing."""
    sizes = np.array([len(x) for x in sets])
    label, rest = np.arange(len(sets)), np.flatnonzero(sizes)
    if len(rest) < 2:
        return label
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(flat.max() + 1, bool)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        flat, todo = np.concatenate([own[i] for i in rest]) if len(rest) else None, [seed]
        while todo and len(rest):
            x = todo.pop()
            mark[own[x]] = True
            both = np.add.reduceat(mark[flat], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
            mark[own[x]] = False
            near = both >= least * (sizes[x] + sizes[rest] - both) - 1e-9
            if near.any():
                label[rest[near]] = seed
                todo.extend(rest[near].tolist())
                flat, rest = flat[np.repeat(~near, sizes[rest])], rest[~near]
    return label


def _alike_edges(docs: DataFrame, nodes: DataFrame, width: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that connect nodes of one candidate group whose shingle sets are alike; nodes: (rep, rep_h, group_of).

    Every two nodes of a group meet in a task; groups of many shingles are cut into blocks."""
    several = shared_table(nodes.groupBy("group_of").agg(F.count("*").alias("_c")).where("_c > 1").select("group_of"), "groups")
    of = shared_table(nodes.join(several, "group_of").select("rep", "rep_h", "group_of"), "members")
    texts = docs.select(F.col(id_col).alias("rep"), F.xxhash64(text_col).alias("rep_h"), F.col(text_col).alias("text"))

    def compute(part):
        h = [np.unique(shingle_hashes(t, width)) for t in part]
        return [x.tobytes() for x in h], [len(x) + ROW_SHINGLES for x in h]

    sets = shared_table(map_text(texts.join(of, ["rep", "rep_h"]).select("rep", "group_of", "text"), "text", compute, "shingles binary, cost long"), "shingle-sets")
    dealt = pair_blocks(sets, "group_of", "rep", BLOCK_SHINGLES, "cost").withColumn("group", F.xxhash64("group_of", "lo", "hi"))
    dealt = dealt.select("group", "rep", "shingles").repartition("group").sortWithinPartitions("group", "rep")

    def links(pdf: pd.DataFrame):
        group, rep, out = pdf["group"].to_numpy(), pdf["rep"].to_numpy(), []
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
        for lo, hi in zip(start, [*start[1:], len(pdf)]):
            label = alike_components([np.frombuffer(b, np.uint64) for b in pdf["shingles"].iloc[lo:hi]], least)
            moved = np.flatnonzero(label != np.arange(hi - lo))
            out.append(np.stack((rep[lo + moved], rep[lo + label[moved]]), 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return dealt.mapInPandas(whole_groups(links), "a long, b long").distinct()


def simhash_components(
    docs: DataFrame,
    width: int = 4,
    max_bits: int = 4,
    keys: list[list[int]] | None = None,
    words: int = 1,
    max_sig_bits: int | None = None,
    distinct: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float | None = None,
) -> DataFrame:
    """One row per document: id_col, fp, sig, component_id (smallest id reachable by links).

    Links join documents whose fp differ in at most max_bits bits and, if max_sig_bits is
    given, whose `words` * 64 signature bits differ in at most so many.  With the default
    keys no link is lost (pigeonhole).  distinct: repeated shingles count once.  ids must be integers.

    least: the groups found are candidates only; of their documents those are linked, exactly,
    that share a Jaccard similarity of at least so much of their distinct shingles."""
    fps = shared_table(fingerprints(docs, width, words, distinct, id_col, text_col), "fingerprints")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h")))
    nodes = shared_table(fps.groupBy("fp", "sig").agg(first.alias("_f")).select("fp", "sig", F.col("_f.id").alias("rep"), F.col("_f.h").alias("rep_h")), "nodes")
    edges = _close_pairs(nodes.where("rep is not null"), keys or pigeonhole_keys(max_bits), max_bits, max_sig_bits)
    comp = components(edges).select(F.col("id").alias("rep"), "component")
    if least is not None:
        grouped = nodes.join(comp, "rep").select("rep", "rep_h", F.col("component").alias("group_of"))
        comp = components(_alike_edges(docs, grouped, width, least, id_col, text_col)).select(F.col("id").alias("rep"), "component")
    named = nodes.join(comp, "rep", "left").select("fp", "sig", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, ["fp", "sig"]).select(F.col("id").alias(id_col), "fp", "sig", "component_id")


def near_duplicates(docs: DataFrame, **names) -> DataFrame:
    """Components of documents that share a Jaccard similarity of 0.8 or more of their distinct five-word shingles.

    At 0.8 about 15 % of SimHash bits differ, of 256 39 on average, give or take 6.
    Candidates agree on 4 of 64 blocks of 4 bits (64 such block sets, which miss some 2 %
    of pairs at 0.8 and fewer above) and differ in at most 20 of the first 64 bits and 58 of
    all.  Each group of candidates is then compared exactly, so nothing below 0.8 is linked."""
    keys = spread_keys(64, 4, 64, 256)
    return simhash_components(docs, width=5, max_bits=20, keys=keys, words=4, max_sig_bits=58, distinct=True, least=0.8, **names)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row bearing its smallest id stays.

    Of rows that repeat this id the one whose text sorts first stays (one of them, if they
    are equal).  Rows with a null id have no name to be kept under and all stay."""
    names = docs.columns
    docs, (id_col, text_col) = by_place(docs, id_col, text_col)
    comp = near_duplicates(docs, id_col=id_col, text_col=text_col)
    keep = comp.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("_n"))
    kept = docs.join(keep, id_col)
    rest = [c for c in docs.columns if c != id_col]
    again = (
        kept.where("_n > 1").groupBy(id_col)
        .agg(F.min(F.struct(F.col(text_col).alias("_k"), F.struct(*rest).alias("_r"))).alias("_m"))
        .select(id_col, "_m._r.*")
    )
    nulls = docs.where(F.col(id_col).isNull())
    return kept.where("_n = 1").select(docs.columns).unionByName(again).unionByName(nulls).toDF(*names)
