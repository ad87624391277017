"""Toxicity by weak supervision.

Voters are lexicons and patterns: words, and word beginnings of 3 to 6 characters, that
mark toxic rows in a bounded labelled sample, dealt into several lexicons, plus fixed
pattern voters (a short word list, shouting).  A generative label model estimates each
voter's rates of firing on either class by expectation-maximisation (a labelled row's
label is one more voter), estimates the voters' conditional correlations and discounts
voters that repeat each other.  Its posterior labels train a logistic classifier over the
single markers and the voters, which scores any text.

A text is its set of lower-case words (runs of letters, digits and underscores), so length
does not matter; null and empty texts are scored as texts without any marker.  Without
labelled rows of both kinds, or without any marker that they support, every score is 0.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, memory_freed, shared_table

#: Labelled rows to learn from, at most: of label 1, of label 0.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
STARTS = (3, 4, 5, 6)
LEXICONS = 6
#: Penalties of the classifier to choose from, by cross-validation in so many parts of the rows learned from.
PENALTIES, PARTS = (0.05, 0.2, 0.8), 2
_WORD = re.compile(r"\w+")
# fixed values: insults known beforehand
KNOWN = frozenset(["idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "dumb", "ugly", "filthy", "trash"])


@dataclass
class Model:
    """Markers (word -> number, start -> number), voters and the classifier's weights."""

    words: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0
    start_kind: list[int] = field(default_factory=list)
    _cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    @property
    def size(self) -> int:
        return len(self.words) + len(self.starts)

    def of_word(self, w: str) -> tuple[int, ...]:
        """Markers that a word holds."""
        got = self._cache.get(w)
        if got is None:
            got = tuple(x for x in (self.words.get(w), *(self.starts.get(w[:k]) for k in STARTS if len(w) > k)) if x is not None)
            if len(self._cache) > 500_000:
                self._cache.clear()
            self._cache[w] = got
        return got

    def markers(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        get = self._cache.get
        for w in words:
            got = get(w)
            if got is None:
                got = self.of_word(w)
            if got:
                out.update(got)
        return out

    def row(self, words: set[str]) -> np.ndarray:
        """Features: each marker, then each voter's vote."""
        x = np.zeros(self.size + N_VOTERS)
        at = sorted(self.markers(words))
        x[at] = 1
        x[self.size :] = votes(self, at, words)
        return x

    def score(self, text: str | None) -> float:
        words = set(_WORD.findall((text or "").lower()))
        at = self.markers(words)
        if not at and not (words & KNOWN) and self.size:
            z = self.bias + float(self.weights[self.size :] @ votes(self, (), words))
        else:
            z = self.bias + (float(self.weights @ self.row(words)) if self.size else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


N_VOTERS = LEXICONS + len(STARTS) + 3


def votes(model: Model, markers, words: set[str]) -> np.ndarray:
    """1 where a voter fires: word lexicons, lexicons of starts by length, two or more
    markers, three or more, a word known beforehand."""
    out = np.zeros(N_VOTERS)
    n_words = len(model.words)
    for m in markers:
        if m < n_words:
            out[m % LEXICONS] = 1
        else:
            out[LEXICONS + model.start_kind[m - n_words]] = 1
    out[-3] = len(markers) >= 2
    out[-2] = len(markers) >= 4
    out[-1] = bool(words & KNOWN)
    return out


def _distinct(rows: list[tuple[str, int]]) -> list[tuple[set[str], int, float]]:
    """(words, label, weight): rows that share their four smallest word hashes are near copies
    and share a weight of one."""
    sets = [set(map(sys.intern, t.split(" "))) if t else set() for t, _ in rows]  # one object per word
    marks = [tuple(sorted(zlib.crc32(w.encode()) for w in s)[:4]) for s in sets]
    many = Counter(marks)
    return [(s, y, 1.0 / many[m]) for s, m, (_, y) in zip(sets, marks, rows)]


def _choose(rows) -> Model:
    """Markers: words and starts that label 1 has far oftener than label 0."""
    counts = [Counter(), Counter()]
    total = [1e-9, 1e-9]
    for words, y, weight in sorted(rows, key=lambda r: -r[1]):
        total[y] += weight
        seen = set(words)
        for w in words:
            seen.update(w[:k] + "*" for k in STARTS if len(w) > k)
        # label 1 first: of label 0 only what can still be a marker is counted
        for f in seen if y else seen & counts[1].keys():
            counts[y][f] += weight
    # the commonest word behind each start: a start that one word carries says nothing beyond it
    top: Counter = Counter()
    for w in [f for f in counts[1] if not f.endswith("*")]:
        for k in STARTS:
            if len(w) > k:
                top[w[:k] + "*"] = max(top[w[:k] + "*"], counts[1][w])
    least = max(2.0, 0.006 * total[1])
    strong = 14.0  # of n * ln(rate ratio), which grows with the number of rows behind it
    model = Model()
    for f, n in sorted(counts[1].items()):
        rate, other = n / total[1], (counts[0][f] + 0.3) / total[0]
        if n >= least and 2 * top[f] <= n and rate >= 8 * other and n * np.log(rate / other) >= strong:
            if f.endswith("*"):
                model.starts[f[:-1]] = len(model.starts)
                model.start_kind.append(STARTS.index(len(f) - 1))
            else:
                model.words[f] = len(model.words)
    model.starts = {k: v + len(model.words) for k, v in model.starts.items()}
    return model


def label_model(v: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of votes v (0/1); y: labels, one more voter of fixed accuracy.

    Returns the posteriors and what was estimated: prior, rates, discounts, correlations."""
    label = np.where(y == 1, np.log(0.98 / 0.02), -np.log(0.98 / 0.02))
    p = np.where(y == 1, 0.98, 0.02)
    discount = np.ones(v.shape[1])
    for _ in range(rounds):
        w1, w0 = weight * p, weight * (1 - p)
        r1 = (w1 @ v + 0.1) / (w1.sum() + 0.2)
        r0 = (w0 @ v + 0.1) / (w0.sum() + 0.2)
        # what two voters share beyond the class they both see
        left = v - p[:, None] * r1 - (1 - p[:, None]) * r0
        cov = (left * weight[:, None]).T @ left
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / sd[:, None] / sd[None]
        np.fill_diagonal(corr, 0)
        discount = 1 / (1 + np.maximum(corr, 0).sum(1))
        prior = np.log(w1.sum() / w0.sum())
        on, off = np.log(r1 / r0), np.log((1 - r1) / (1 - r0))
        z = prior + label + (v * on + (1 - v) * off) @ discount
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, {"prior": prior, "fires": (r0, r1), "discount": discount, "correlation": corr}


def _logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels (Newton steps on the dual-sized normal matrix)."""
    a = np.concatenate((x, np.ones((len(x), 1))), 1)
    reg = np.full(a.shape[1], l2)
    reg[-1] = 1e-3
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = weight * np.maximum(q * (1 - q), 1e-4)
        step = np.linalg.solve((a * h[:, None]).T @ a + np.diag(reg), a.T @ (weight * (q - p)) + reg * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(rows: list[tuple[str, int]]) -> Model:
    """rows: (distinct lower-case words joined by blanks, label 0 or 1)."""
    data = _distinct(rows)
    if len({y for _, y, _ in data}) < 2:
        return Model()
    return _fitted(data, _penalty(data))


def _prepared(data) -> tuple[Model, np.ndarray, np.ndarray, np.ndarray]:
    """Markers chosen from data, its features, posterior labels and weights."""
    model = _choose(data)
    x = np.array([model.row(words) for words, _, _ in data])
    y, weight = np.array([y for _, y, _ in data]), np.array([w for _, _, w in data])
    return model, x, label_model(x[:, model.size :], y, weight)[0] if model.size else y, weight


def _fitted(data, penalty: float) -> Model:
    model, x, posterior, weight = _prepared(data)
    if not model.size:
        return Model()
    model.weights, model.bias = _logistic(x, posterior, weight, penalty, 15)
    return model


def _penalty(data) -> float:
    """The penalty with the least log loss on labels left out, inside the rows to learn from.

    Near copies share a part, as they share a weight; without both labels in each part the
    middle one is taken."""
    part = np.array([zlib.crc32(" ".join(sorted(words)[:8]).encode()) % PARTS for words, _, _ in data])
    y, weight = np.array([y for _, y, _ in data]), np.array([w for _, _, w in data])
    if any(len(set(y[part != k])) < 2 or not (part == k).any() for k in range(PARTS)):
        return PENALTIES[len(PENALTIES) // 2]
    loss = dict.fromkeys(PENALTIES, 0.0)
    for k in range(PARTS):
        model, x, posterior, w = _prepared([d for d, p in zip(data, part) if p != k])
        if not model.size:
            return PENALTIES[len(PENALTIES) // 2]
        out = part == k
        rest = np.array([model.row(words) for (words, _, _), o in zip(data, out) if o])
        for penalty in PENALTIES:
            weights, bias = _logistic(x, posterior, w, penalty, 15)
            z = np.clip((rest @ weights + bias) * np.where(y[out] == 1, 1, -1), -30, 30)
            loss[penalty] += float(weight[out] @ np.log1p(np.exp(-z)))
    return min(PENALTIES, key=lambda p: (loss[p], p))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """Learn from at most toxic_rows + clean_rows labelled texts: those with the smallest hashes
    of id and text.  Ids with several labels count as toxic if one of them is 1; a text that
    several rows of an id hold counts once.  Of each text its distinct words are gathered."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y"))
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    labelled = shared_table(texts.select("i", "h").join(one, "i").distinct(), "labelled")
    order = F.xxhash64(F.lit(31), "i", "h")
    pick = labelled.where("y = 1").orderBy(order, "i", "h").limit(toxic_rows).unionByName(labelled.where("y = 0").orderBy(order, "i", "h").limit(clean_rows))
    # proven bound: toxic_rows + clean_rows rows
    some = texts.join(F.broadcast(pick), ["i", "h"]).dropDuplicates(["i", "h"])

    def run(batches):
        for pdf in batches:
            words = [" ".join(sorted(set(_WORD.findall((t or "").lower())))) for t in pdf["t"]]
            yield pd.DataFrame({"t": words, "y": pdf["y"]})

    got = some.select("t", F.col("y").cast("int").alias("y")).mapInPandas(run, "t string, y int").collect()  # bounded as above
    rows = sorted((r.t, r.y) for r in got)
    del got
    model = learn(rows)
    del rows
    memory_freed()  # else the driver holds its peak through all that follows
    return model


def score(docs: DataFrame, model: Model, text_col="text", keep: list[str | Column] | None = None) -> DataFrame:
    """The columns of `keep` (default: all of docs), score (0 to 1) and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # markers of a bounded sample
    base = docs if keep is None else docs.select(*keep, F.col(text_col).alias("_text"))

    def compute(texts):
        s = np.array([shared.value.score(t) for t in texts], float)
        return s, (s >= 0.5).astype(np.int32)

    return map_text(base, text_col if keep is None else "_text", compute, "score double, predicted int", drop_text=keep is not None)
