"""Lines that agree in 3/5 of their tokens, place by place, found exactly: the numpy part of line_dedup.

Lines travel masked, many to a compressed chunk; tokens are hashed (64 bits) where a chunk is
read.  Two lines of n tokens agree if they differ in `differ(n)` places at most.

* First filter: agreeing lines share pairs of neighbouring tokens, `needed(n)` at least, since
  each difference touches one pair only.  Pairs go as 4 bytes to the bucket of their leading
  bits, which answers with one bit for each: does another stand there too.  No line that
  agrees with another is lost by that.
* Keys: blocks of five tokens.  Were there two differences or more in each block (three in the
  last), there would be more than `differ(n)`; so agreeing lines share all but one token
  of some block, or all but two of the last: keys of four tokens, and a few of three or five.
  A key that holds a pair of the first filter that no other line has is left out.
* Lines that share a key are compared in full.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from .common import local_components
from .simhash import _mixed

ANY = b"<*>"
#: Bytes of lines in a chunk, pairs of tokens in a bucket, bits of a pair.
CHUNK, BUCKET, BITS = 1 << 21, 1 << 22, 40
#: Rows of a key from which they are compared one with all others, else all pairs at once.
LARGE = 32
_SPECIAL = re.compile(rb"  |[\x09-\x0D0-9@:]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_VARIABLE = re.compile(rb"(?<![^\x20])(?:[^\x200-9@/]*+[0-9@]|[a-z]++://)[^\x20]*+")
_BYTE = _mixed(np.arange(256, dtype=np.uint64), 11)
_BYTE[[10, 32]] = 0  # what stands between tokens
_ODD = [np.uint64(int(x) | 1) for x in _mixed(np.arange(16, dtype=np.uint64), 12)]


def differ(n):
    """Places in which agreeing lines of n tokens may differ (SIMILAR of line_dedup is 3/5)."""
    return n * 2 // 5


def needed(n):
    """Pairs of tokens that agreeing lines of n tokens share."""
    return (n + 1) // 2 - differ(n)


def masked(line: bytes) -> bytes:
    """As line_dedup._masked."""
    if not _SPECIAL.search(line):
        return line.strip(b" ")
    return _VARIABLE.sub(ANY, _SPACE.sub(b" ", line).strip(b" "))


def chunks(least: int):
    """For mapInArrow over texts: (chunk, size, lines) of their masked lines of `least` tokens and more that hold a constant."""

    def packed(lines):
        text = b"\n".join(lines)
        size = sum(x.count(b" ") + 2 >> 1 for x in lines)
        codec = pa.compress(text, codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65]), pa.array([size]), pa.array([len(text)]), pa.array([codec])], names=["chunk", "size", "bytes", "lines"]
        )

    def run(batches):
        lines, n = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for line in (text.as_py() or b"").split(b"\n"):
                    line = masked(line)
                    if line.count(b" ") + 1 >= least and (ANY not in line or line.replace(ANY, b"").strip(b" ")):
                        lines.append(line)
                        n += len(line)
                        if n >= CHUNK:
                            yield packed(lines)
                            lines, n = [], 0
        if lines:
            yield packed(lines)

    return run


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(h, n): 64 bits of each token (0: a wildcard), and the tokens of each line."""
    a = np.frombuffer(text + b"\n", np.uint8)
    cut = np.flatnonzero((a == 32) | (a == 10))
    start = np.concatenate(([0], cut[:-1] + 1))
    size = cut - start
    at = np.arange(len(a)) - np.repeat(start, size + 1)
    weight = _mixed(np.arange(int(size.max()) + 1, dtype=np.uint64), 13) | np.uint64(1)
    h = _mixed(np.add.reduceat(_BYTE[a] * weight[at], start) + size.astype(np.uint64), 14)
    wild = np.flatnonzero(size == len(ANY))
    wild = wild[(a[start[wild]] == ANY[0]) & (a[start[wild] + 1] == ANY[1]) & (a[start[wild] + 2] == ANY[2])]
    h[wild] = 0
    last = np.flatnonzero(a[cut] == 10)
    return h, np.diff(np.concatenate(([-1], last)))


def token_pairs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, line, at) of the pairs of neighbouring constant tokens, two by two; at: the first token."""
    first = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(h)) - first[line]
    at = np.flatnonzero(i % 2 == 0)
    alone = i[at] + 1 == n[line[at]]
    a, b = h[at], np.where(alone, np.uint64(1), h[np.minimum(at + 1, len(h) - 1)])
    ok = (a != 0) & (b != 0)
    at, a, b = at[ok], a[ok], b[ok]
    place = (i[at] + (n[line[at]] << 32)).astype(np.uint64)
    return _mixed(a * _ODD[0] + b * _ODD[1] + place * _ODD[2], 15) >> np.uint64(64 - BITS), line[at], at


def _dealt(text: bytes, bits: int):
    """h, n, p, line, at as above, the pairs in the order of their buckets, and the buckets."""
    h, n = tokens(text)
    p, line, at = token_pairs(h, n)
    bucket = (p >> np.uint64(BITS - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return h, n, p[order], line[order], at[order], bucket[order].astype(np.int64)


def deal(bits: int):
    """For mapInArrow over chunks: (bucket, chunk, data), 4 bytes of each pair."""

    def run(batches):
        for batch in batches:
            for chunk, lines, size in zip(batch.column("chunk").to_pylist(), batch.column("lines"), batch.column("bytes").to_pylist()):
                _, _, p, _, _, bucket = _dealt(pa.decompress(lines.as_py(), size, "zstd", asbytes=True), bits)
                start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(p) else np.zeros(0, np.int64)
                low, end = p.astype(np.uint32), [*start[1:].tolist(), len(p)]
                data = [low[s:e].tobytes() for s, e in zip(start.tolist(), end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[start]), pa.array(np.full(len(start), chunk, np.int64)), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"]
                )

    return run


def answer(batches):
    """For mapInArrow over what deal gives, sorted by bucket: data becomes a bit for each pair, does it stand there again."""

    def settled(bucket, ids, data):
        rows = [np.frombuffer(x, np.uint32) for x in data]
        every = np.concatenate(rows)
        again = np.sort(every)
        again = np.unique(again[1:][again[1:] == again[:-1]])
        found = np.zeros(len(every), bool)
        if len(again):
            found = again[np.minimum(np.searchsorted(again, every), len(again) - 1)] == every
        bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum([len(x) for x in rows])[:-1])]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), bucket, np.int64)), pa.array(ids, pa.int64()), pa.array(bits, pa.binary())], names=["bucket", "chunk", "data"]
        )

    now, ids, data = None, [], []
    for batch in batches:
        for b, c, d in zip(*(batch.column(i).to_pylist() for i in ("bucket", "chunk", "data"))):
            if b != now and ids:
                yield settled(now, ids, data)
                ids, data = [], []
            now = b
            ids.append(c)
            data.append(d)
    if ids:
        yield settled(now, ids, data)


def survivors(bits: int):
    """For mapInArrow over chunks with their answers: (x, n, a, c) of lines that share enough pairs; a: the tokens' hashes, c: 1 where a shared pair begins."""

    def run(batches):
        for batch in batches:
            for lines, size, got in zip(batch.column("lines"), batch.column("bytes").to_pylist(), batch.column("got").to_pylist()):
                text = pa.decompress(lines.as_py(), size, "zstd", asbytes=True)
                h, n, p, line, at, bucket = _dealt(text, bits)
                found = np.zeros(len(p), bool)
                for g in got:
                    lo, hi = np.searchsorted(bucket, [g["bucket"], g["bucket"] + 1])
                    found[lo:hi] = np.unpackbits(np.frombuffer(g["data"], np.uint8), count=hi - lo)
                stay = np.flatnonzero(np.bincount(line[found], minlength=len(n)) >= needed(n))
                if not len(stay):
                    continue
                begins = np.zeros(len(h), np.uint8)
                begins[at[found]] = 1
                own, first = text.split(b"\n"), np.cumsum(n) - n
                x = np.array([xxhash.xxh64_intdigest(own[i], 42) for i in stay.tolist()], np.uint64).view(np.int64)
                a = [h[first[i] : first[i] + n[i]].tobytes() for i in stay.tolist()]
                c = [begins[first[i] : first[i] + n[i]].tobytes() for i in stay.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n[stay].astype(np.int32)), pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["x", "n", "a", "c"])

    return run


def blocks(n: int) -> list[tuple[int, int, int]]:
    """(from, to, e): two agreeing lines of n tokens (5 at least) differ in e places at most of one of these blocks."""
    m, r = n // 5, n % 5
    out = [(5 * j, 5 * j + 5, 1) for j in range(m)]
    if r == 4:
        out.append((n - 4, n, 1))
    elif r == 3:
        out[-1:] = [(n - 8, n - 3, 2), (n - 3, n, 0)]
    else:
        out[-1] = (n - r - 5, n, 2)
    return out


@functools.lru_cache(4096)
def _places(n: int) -> list[np.ndarray]:
    """The places of the keys of lines of n tokens, keys of equal length together."""
    keys = [k for lo, hi, e in blocks(n) for k in itertools.combinations(range(lo, hi), hi - lo - e)]
    return [np.array([k for k in keys if len(k) == size], np.int32) for size in sorted({len(k) for k in keys})]


def keys(batches):
    """For mapInArrow over (x, rest, n, a, c): (key, x, rest) of the keys whose whole pairs are shared ones."""
    for batch in batches:
        x, n = batch.column("x").to_numpy(), batch.column("n").to_numpy()
        rest, a, c = batch.column("rest").to_numpy(zero_copy_only=False), batch.column("a").to_pylist(), batch.column("c").to_pylist()
        for k in np.unique(n).tolist():
            own = np.flatnonzero(n == k)
            for part in np.array_split(own, len(own) * k // 100_000 + 1):
                h = np.frombuffer(b"".join(a[i] for i in part), np.uint64).reshape(-1, k)
                begins = np.frombuffer(b"".join(c[i] for i in part), np.uint8).reshape(-1, k) > 0
                for at in _places(k):
                    got = (at[:, 0].astype(np.uint64) * _ODD[8] + at[:, -1].astype(np.uint64) * _ODD[9] + np.full(len(at), k, np.uint64) * _ODD[10])[None, :]
                    ok = np.ones((len(part), len(at)), bool)
                    for j in range(at.shape[1]):
                        t = h[:, at[:, j]]
                        ok &= t != 0
                        whole = at[:, j] % 2 == 0
                        whole &= (at == at[:, j : j + 1] + 1).any(1) | (at[:, j] == k - 1)
                        ok &= begins[:, at[:, j]] | ~whole
                        # a key's places count as well: keys without different tokens are different keys
                        got = _mixed(got + t * _ODD[j], 16) + at[:, j].astype(np.uint64)
                    i, j = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_mixed(got[i, j], 17).view(np.int64)), pa.array(x[part[i]]), pa.array(rest[part[i]])], names=["key", "x", "rest"]
                    )


def links(stars: bool):
    """For whole_groups: rows (group, x, rest, cross, blk, n, a) that share a key; gives (x, y) of those that agree, x < y.

    stars: of the links of a group only as many as connect the same lines."""
    def compared(x, rest, cross, blk, a):
        """Links as indices, each line compared with the later ones; stars: with those not reached yet."""
        if not stars:
            for i in range(len(x) - 1):
                ok = (rest[i] | rest[i + 1 :]) & ((blk[i + 1 :] != blk[i]) | (not cross)) & (x[i + 1 :] != x[i])
                to = i + 1 + np.flatnonzero(ok)
                yield i, to[agree(a[i], a[to])]
            return
        left = np.arange(len(x))
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                i = todo.pop()
                ok = (rest[i] | rest[left]) & ((blk[left] != blk[i]) | (not cross))
                near = np.zeros(len(left), bool)
                near[ok] = agree(a[i], a[left[ok]])
                yield i, left[near]
                todo.extend(left[near].tolist())
                left = left[~near]

    def agree(one, many):
        return ((one == many) & (one != 0)).sum(1) * 5 >= 3 * many.shape[1]

    def small(x, rest, cross, blk, a, end, at):
        """Links as indices, of rows `at` whose groups end at `end`: every row with the next, the one after and so on."""
        step, found = 1, [np.zeros((2, 0), np.int64)]
        while len(at):
            at = at[at + step < end[at]]
            to = at + step
            ok = (rest[at] | rest[to]) & (~cross[at] | (blk[at] != blk[to])) & (x[at] != x[to])
            i, j = at[ok], to[ok]
            for lo in range(0, len(i), most := max(1, (1 << 20) // a.shape[1])):
                p, q = i[lo : lo + most], j[lo : lo + most]
                near = agree(a[p], a[q])
                found.append(np.stack((p[near], q[near])))
            step += 1
        i, j = np.concatenate(found, 1)
        if stars:
            label = local_components(len(x), i, j)
            i = np.flatnonzero(label != np.arange(len(x)))
            j = label[i]
        return i, j

    def run(pdf):
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # a key of other lines by chance: lines of one length only are compared
        for k, part in pdf.groupby("n", sort=False):
            group, x, rest, cross, blk = (part[c].to_numpy() for c in ("group", "x", "rest", "cross", "blk"))
            a = np.frombuffer(b"".join(part["a"]), np.uint64).reshape(-1, k)
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.concatenate((start, [len(x)])))
            end, large = np.repeat(start + size, size), size > LARGE
            i, j = small(x, rest, cross, blk, a, end, np.flatnonzero(~np.repeat(large, size)))
            u.append(x[i])
            v.append(x[j])
            for lo, n in zip(start[large].tolist(), size[large].tolist()):
                own = slice(lo, lo + n)
                for i, to in compared(x[own], rest[own], bool(cross[lo]), blk[own], a[own]):
                    u.append(np.full(len(to), x[lo + i]))
                    v.append(x[lo + to])
        u, v = np.concatenate(u), np.concatenate(v)
        return pd.DataFrame({"x": np.minimum(u, v), "y": np.maximum(u, v)}).drop_duplicates()

    return run
