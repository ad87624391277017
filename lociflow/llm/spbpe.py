"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

A text becomes one flat numpy array of symbols over all words of a batch.  Each round
finds the smallest merge rank of every word (a segmented minimum), merges the leftmost
pair of that rank in all words at once and compacts the arrays, until no word has a
mergeable pair.  Further pairs of the same rank in a word are merged in the same round
where no pair that the merges create ranks before them, so the result is that of merging
one by one.

Words are cut before each run of space marks: no piece of the model holds a mark after
another character (checked when it is loaded), so no merge crosses a cut.  Each distinct
word of a batch is encoded once; a bounded cache carries words over batches.

Null and empty texts have no ids.  Only what the model states is used (identity
normaliser, dummy prefix, byte fallback); any other kind of model is refused.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_WORDS = 300_000
_NONE = np.int64(1) << 40


def _fields(buf: bytes):
    """(number, value) of a protobuf message: ints of varints, bytes of the rest."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, buf[at : at + n]
            at += n


class SentencePieceBPE:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        pieces, scores, types, trainer, normal = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f[1].decode("utf-8"))
                scores.append(np.frombuffer(f[2], "<f4")[0] if 2 in f else 0.0)
                types.append(f.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError("only BPE models with the identity normaliser and a dummy prefix are supported")
        if any(t in (4, 5) for t in types) or any(MARK in p.lstrip(MARK) for t, p in zip(types, pieces) if t == 1):
            raise ValueError("models with user-defined or unused pieces, or with inner space marks, are not supported")
        self.pieces, self.types = pieces, types
        self.unk = types.index(2)
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types)) if t == 6}
        normal_ids = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t == 1}
        order = sorted(normal_ids.values(), key=lambda i: (-scores[i], i))
        rank = {i: r for r, i in enumerate(order)}
        # symbols: ids of pieces, then single characters that only occur inside pieces
        self.symbol = dict(normal_ids)
        for p in normal_ids:
            for c in p:
                self.symbol.setdefault(c, len(pieces) + len(self.symbol))
        keys, ranks, made = [], [], []
        for p, i in normal_ids.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(rank[i])
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self._keys = np.array(keys, np.int64)[at]
        self._ranks, self._made = np.array(ranks, np.int64)[at], np.array(made, np.int64)[at]
        self._cache: dict[str, tuple[str, int, bytes]] = {}
        self._text = [str(i) for i in range(len(pieces))]
        self._bytes = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else b" \xe2\x81\x87 " if t == 2 else p.replace(MARK, " ").encode() for p, t in zip(pieces, types)]

    @classmethod
    def load(cls, path: str) -> SentencePieceBPE:
        return _loaded(path)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, index) of the pairs; rank _NONE where no piece is made."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = (self._keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self._ranks[at], _NONE), at

    def merge(self, words: list[str]) -> list[list[int]]:
        """Symbols left in each word when no pair can be merged: piece ids, or -1 - code point."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        known: dict[str, int] = {}
        flat = "".join(words)
        for c in set(flat):
            known[c] = self.symbol.get(c, -1 - ord(c))
        sym = np.fromiter(map(known.__getitem__, flat), np.int64, n)
        word = np.repeat(np.arange(len(words)), sizes)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        rank = at = None
        while len(sym):
            if rank is None:
                rank, at = self._ranked(sym, word)
            best = np.full(len(words), _NONE)
            np.minimum.at(best, word, rank)
            done = best[word] == _NONE
            if done.any():
                ended.append((word[done], sym[done]))
                live = ~done
                sym, word, rank, at = sym[live], word[live], rank[live], at[live]
                if not len(sym):
                    break
            spot = np.flatnonzero(rank == best[word])
            # leftmost, not overlapping: within a run of neighbouring spots every second one
            run = np.concatenate(([True], np.diff(spot) > 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - first) % 2 == 0]
            lead = np.concatenate(([True], word[spot[1:]] != word[spot[:-1]]))
            made = self._made[at[spot]]
            if not lead.all():
                spot, made = self._safe(sym, word, best, spot, made, lead)
            sym[spot] = made
            stay = np.ones(len(sym), bool)
            stay[spot + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, rank, at = sym[stay], word[stay], rank[stay], at[stay]
            fresh = moved[spot]
            touch = np.concatenate((fresh, fresh[fresh > 0] - 1))
            rank[touch], at[touch] = self._ranked(sym, word, touch)
        if not ended:
            return [[] for _ in words]
        word, sym = (np.concatenate(x) for x in zip(*ended))
        sym = sym[np.argsort(word, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [sym[a:b] for a, b in zip([0, *ends], ends)]

    def _ranked(self, sym, word, where=None):
        where = np.arange(len(sym)) if where is None else where
        nxt = np.minimum(where + 1, len(sym) - 1)
        rank, at = self._look(sym[where], sym[nxt])
        return np.where((word[nxt] == word[where]) & (nxt > where), rank, _NONE), at

    def _safe(self, sym, word, best, spot, made, lead):
        """All spots of the words in which no new pair could come before the rest; else the first."""
        last = len(sym) - 1
        left, right = np.maximum(spot - 1, 0), np.minimum(spot + 2, last)
        new = np.full(len(sym), -1)
        new[spot] = made
        after_new = np.where(spot + 2 <= last, new[right], -1)
        low = np.full(len(spot), _NONE)
        for a, b, ok in (
            (sym[left], made, (spot > 0) & (word[left] == word[spot])),
            (made, sym[right], (spot + 2 <= last) & (word[right] == word[spot])),
            (made, after_new, after_new >= 0),
        ):
            low = np.minimum(low, np.where(ok, self._look(a, b)[0], _NONE))
        # a merge just before a spot gives it another left neighbour: covered from that side
        bad = np.zeros(len(best), bool)
        bad[word[spot[low < best[word[spot]]]]] = True
        take = lead | ~bad[word[spot]]
        return spot[take], made[take]

    def _ids(self, symbols: list[int]) -> list[int]:
        if symbols and min(symbols) >= 0 and max(symbols) < len(self.pieces):
            return symbols
        out: list[int] = []
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
            else:
                char = chr(-1 - s) if s < 0 else self._char(s)
                raw = char.encode("utf-8", "surrogatepass")
                if self.byte:
                    out += [self.byte[b] for b in raw]
                elif not out or out[-1] != self.unk:
                    out.append(self.unk)
        return out

    @lru_cache(1 << 16)  # noqa: B019
    def _char(self, s: int) -> str:
        return next(c for c, i in self.symbol.items() if i == s)

    def _learn(self, words: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """Encodings of words that the cache lacks; the cache takes them up until it is full.

        The common words come early, so a full cache keeps them."""
        todo, out = sorted(words), {}
        text, raw = self._text.__getitem__, self._bytes.__getitem__
        for at in range(0, len(todo), 50_000):
            part = todo[at : at + 50_000]
            for w, symbols in zip(part, self.merge(part)):
                ids = self._ids(symbols)
                out[w] = (",".join(map(text, ids)), len(ids), b"".join(map(raw, ids)))
        if len(self._cache) < CACHE_WORDS:
            self._cache.update(out)
        return out

    @staticmethod
    def words(text: str | None) -> list[str]:
        return _WORDS.findall((MARK + text).replace(" ", MARK)) if text else []

    def encode_joined(self, texts: list[str | None]) -> list[tuple[str, int]]:
        """(ids joined by commas, number of ids) of each text."""
        cut = [self.words(t) for t in texts]
        out, cache, at = [], self._cache, 0
        while at < len(cut):
            to, new = at, set()
            while to < len(cut) and len(new) < CACHE_WORDS // 4:
                new.update([w for w in set(cut[to]) if w not in cache])
                to += 1
            fresh = self._learn(new)
            known, rest = cache.get, fresh.get
            for ws in cut[at:to]:
                got = [known(w) or rest(w) for w in ws]
                out.append((",".join([g[0] for g in got]), sum([g[1] for g in got])))
            at = to
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, s.split(","))) if s else [] for s, _ in self.encode_joined(texts)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text: pieces joined, byte pieces read as UTF-8, the dummy prefix gone."""
        raw = b"".join(map(self._bytes.__getitem__, ids))
        first = next((i for i in ids if self.types[i] != 3), None)
        if first is not None and self.pieces[first].startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace").encode() if self.byte else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8")


@lru_cache(2)
def _loaded(path: str) -> SentencePieceBPE:
    with open(path, "rb") as f:
        return SentencePieceBPE(f.read())


def encode_documents(docs: DataFrame, model: str, ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>, if asked for).

    Encodes each text, then decodes its ids.  `model` is a path that every executor has."""

    def compute(texts):
        sp = SentencePieceBPE.load(model)
        joined = sp.encode_joined(texts)
        lists = [np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32) for s, _ in joined]
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        out = [[n for _, n in joined], [sha(s.encode()) for s, _ in joined], [sha(sp.decode_bytes(x.tolist())) for x in lists]]
        return [*out, lists] if ids else out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_text(docs.select(id_col, F.col(text_col).alias("_text")), "_text", compute, schema, rows=256)
