"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector (seeded by its code point).  An n-gram's vector binds
the vectors of its letters, each permuted (rolled) by its place; a text's vector bundles
(sums) those of all its n-grams; a language's prototype bundles its training texts, each
with unit length.  A text gets the language whose prototype has the largest cosine.

Texts are lower-cased; what is not a letter separates, and counts as one blank.  A text
that is null or has no letter gets `und` and score 0; ties go to the language first by
code point.  Training takes rows with a language and a letter; with none, all rows get
`und`.  Vectors of a batch are made for its distinct n-grams only, and texts are cut into
pieces of bounded size that are summed, so very long texts need no more memory.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, shared_table

DIM = 1024
GRAM = 3
#: Texts of one language to learn from, at most (about; chosen by hash; all, if there are fewer).
TRAIN_ROWS = 2000
_CHUNK = 1 << 19
_letters = np.zeros(0x110000, np.uint8)  # 0: not known yet, 1: letter, 2: none
_vectors: dict[int, np.ndarray] = {}


def _vector(letter: int) -> np.ndarray:
    """The letter's random vector; the blank's is that of code point 0."""
    if letter not in _vectors:
        _vectors[letter] = np.random.default_rng([77, letter]).choice(np.array([-1, 1], np.int8), DIM)
    return _vectors[letter]


def _codes(text: str) -> np.ndarray:
    """Code points of letters, 0 for each run of others."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    new = np.unique(cp[_letters[cp] == 0])
    for c in new.tolist():
        _letters[c] = 1 if chr(c).isalpha() else 2
    cp = np.where(_letters[cp] == 1, cp, 0)
    if not len(cp):
        return cp
    return cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]


def _bundles(texts: list[str | None]) -> np.ndarray:
    """One vector per text: the sum of its n-grams' vectors (zero without letters)."""
    out = np.zeros((len(texts), DIM), np.float32)
    held, size = [], 0

    def flush():
        flat = np.concatenate([c for _, c in held])
        row = np.repeat(np.array([r for r, _ in held]), [len(c) for _, c in held])
        letters, at = _dense(flat)
        a, n = len(letters), len(flat) - GRAM + 1
        code = np.zeros(n, np.int64)
        for k in range(GRAM):
            code = code * a + at[k : k + n]
        # within one text, around a letter
        some = (row[:n] == row[GRAM - 1 :]) & (flat[GRAM // 2 : GRAM // 2 + n] != 0)
        code, row = code[some], row[:n][some]
        if not len(code):
            return
        if a**GRAM <= 1 << 23:
            seen = np.zeros(a**GRAM, bool)
            seen[code] = True
            grams = np.flatnonzero(seen)
            place = np.zeros(a**GRAM, np.int32)
            place[grams] = np.arange(len(grams))
            idx = place[code]
        else:
            grams, idx = np.unique(code, return_inverse=True)
        rows, local = np.unique(row, return_inverse=True)
        table = np.stack([_vector(int(c)) for c in letters])
        for lo in range(0, len(grams), 8192):
            part = grams[lo : lo + 8192]
            v = np.ones((len(part), DIM), np.int8)
            rest = part
            for k in range(GRAM):
                v *= np.roll(table, k, axis=1)[rest % a]
                rest = rest // a
            here = (idx >= lo) & (idx < lo + len(part)) if len(grams) > 8192 else slice(None)
            counts = np.bincount(local[here] * len(part) + (idx[here] - lo), minlength=len(rows) * len(part))
            out[rows] += counts.reshape(len(rows), len(part)).astype(np.float32) @ v.astype(np.float32)

    for r, t in enumerate(texts):
        c = _codes(t or "")
        if not c.any():
            continue
        c = np.concatenate(([0] * bool(c[0]), c, [0] * bool(c[-1])))
        for at in range(0, max(1, len(c) - GRAM + 1), _CHUNK):
            piece = c[at : at + _CHUNK + GRAM - 1].astype(np.int64)
            held.append((r, piece))
            size += len(piece)
            if size >= _CHUNK:
                flush()
                held, size = [], 0
    if held:
        flush()
    return out


def _dense(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by a table."""
    seen = np.zeros(int(flat.max()) + 1, bool)
    seen[flat] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int32)
    place[letters] = np.arange(len(letters))
    return letters, place[flat].astype(np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def fit(rows: DataFrame, max_rows: int = TRAIN_ROWS, text_col="text", lang_col="lang") -> dict[str, np.ndarray]:
    """Prototype per language, from at most about max_rows different texts of each.

    They are those with the smallest hashes, so rare languages are learned from whole, and a
    text counts once however many rows hold it; each task sends one vector per language."""
    rows = rows.select(F.xxhash64(F.lit(11), text_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("text is not null and lang is not null")
    share = rows.groupBy(F.col("lang").alias("_l")).agg((F.least(F.lit(1.0), F.lit(max_rows) / F.count_distinct("h")) * (1 << 40)).alias("_most"))
    share = shared_table(share, "languages")  # one row per language; of known size
    some = rows.join(share, F.col("lang") == F.col("_l")).where(F.pmod("h", F.lit(1 << 40)) < F.col("_most"))
    some = some.dropDuplicates(["lang", "h"]).select("lang", "text").repartition(16)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                v = _unit(_bundles(part["text"].tolist()))
                for lang, idx in part.reset_index(drop=True).groupby("lang").groups.items():
                    total[lang] = total.get(lang, 0) + v[idx].sum(0)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [base64.b64encode(x.astype("<f8").tobytes()).decode() for x in total.values()]})

    out: dict[str, np.ndarray] = {}
    for lang, v in some.mapInPandas(run, "lang string, v string").collect():  # 16 tasks x languages
        out[lang] = out.get(lang, 0) + np.frombuffer(base64.b64decode(v), "<f8")
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col="text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, lang_pred and score (cosine, 0 to 1)."""
    langs = sorted(prototypes)
    table = _unit(np.array([prototypes[k] for k in langs], np.float64).reshape(len(langs), DIM)).astype(np.float32)
    base = docs.select(*keep, F.col(text_col).alias("_text"))

    def compute(texts):
        v = _bundles(texts)
        some = v.any(1) & bool(langs)
        cos = _unit(v) @ table.T if langs else np.zeros((len(texts), 1), np.float32)
        best = cos.argmax(1)
        found = np.where(some, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
        return [langs[b] if s else "und" for b, s in zip(best, some)], found

    return map_text(base, "_text", compute, "lang_pred string, score double")
