"""Toxicity by a subsequence string-kernel support vector machine on Nyström landmarks."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents

#: Documented bounds of the training sample: rows of each label, and words of clean sentences that the machine sees.
MAX_TOXIC, MAX_CLEAN, MAX_NEGATIVES = 1000, 2000, 12_000
DECAY, ORDER, SPAN, WINDOW, LANDMARKS, LETTERS, COST = 0.5, 4, 10, 24, 64, 48, 2000.0
_SINGLES = re.compile(r"(?<![^\s])(?:[^\s][ \t]){2,}[^\s](?![^\s])")
_CACHE = 300_000


def units(text: str | None) -> set[str]:
    """The distinct units of a whole text: its words in lower case behind a start mark, runs of single characters
    joined ("i d i o t"), and words longer than WINDOW as overlapping windows, so that none costs more."""
    t = (text or "").lower()
    found = set(t.split())
    for m in _SINGLES.finditer(t):
        found.add("".join(m[0].split()))
    out = set()
    for w in found:
        if len(w) < WINDOW:
            out.add("^" + w)
        else:
            out.add("^" + w[: WINDOW - 1])
            out.update(w[i : i + WINDOW] for i in range(WINDOW // 2, len(w) - WINDOW // 4, WINDOW // 2))
    return out


@lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the subsequences of ORDER characters of a word of n characters that span SPAN at most, and their decay."""
    sub = np.array([(i, *(i + j for j in rest)) for i in range(n - ORDER + 1) for rest in combinations(range(1, min(SPAN, n - i)), ORDER - 1)])
    return sub, DECAY ** (sub[:, -1] - sub[:, 0] + 1)


class Kernel:
    """Gap-weighted subsequence kernel of order ORDER against landmarks, and its Nyström map.

    K(s, t) sums DECAY**(span in s + span in t) over common subsequences of ORDER characters within SPAN, so a gap
    or an inserted character lowers a match instead of losing it. Only subsequences of some landmark count, which
    makes K(., landmarks) a table lookup and a sum. The map is K(., L) V / sqrt(w) of the landmarks' own matrix.
    """

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        letters = [c for c, _ in Counter("".join(dict.fromkeys(landmarks))).most_common(LETTERS)]
        self.code = {c: i + 1 for i, c in enumerate(sorted(letters))}
        self.table = np.zeros((len(self.code) + 1) ** ORDER, np.int32)
        rows: list[Counter] = []
        for j, mark in enumerate(landmarks):
            at, fade = self._at([mark]), places(len(mark))[1]
            for k, f in zip(at[0], fade, strict=True):
                if k >= 0:
                    if not self.table[k]:
                        rows.append(Counter())
                        self.table[k] = len(rows)
                    rows[self.table[k] - 1][j] += f
        self.weight = np.zeros((len(rows) + 1, len(landmarks)))
        for r, row in enumerate(rows, 1):
            for j, x in row.items():
                self.weight[r, j] = x
        own = self.gram(landmarks)
        scale = 1 / np.sqrt(np.maximum(np.diag(own), 1e-12))
        self.weight *= scale
        own = own * scale[:, None] * scale
        w, v = np.linalg.eigh((own + own.T) / 2)
        keep = w > 1e-4 * max(1e-12, w.max(initial=0))
        self.basis = v[:, keep] / np.sqrt(w[keep])

    def _at(self, words: list[str]) -> np.ndarray:
        """Table place of each subsequence of words of one length; -1 where a character is in no landmark."""
        a = len(self.code) + 1
        sub, _ = places(len(words[0]))
        codes = np.array([[self.code.get(c, 0) for c in w] for w in words], np.int32)
        at, off = codes[:, sub[:, 0]], codes[:, sub[:, 0]] == 0
        for k in range(1, ORDER):
            c = codes[:, sub[:, k]]
            at = at * a + c
            off |= c == 0
        at[off] = -1
        return at

    def over(self, words: list[str], value: np.ndarray) -> np.ndarray:
        """Sum over each word's subsequences of decay times value[row of the table]."""
        out, many = np.zeros((len(words), *value.shape[1:])), 4096 if value.ndim == 1 else 64
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                by_length.setdefault(len(w), []).append(i)
        for n, ix in by_length.items():
            fade = places(n)[1]
            step = max(1, 1_000_000 // len(fade))
            for s in range(0, len(ix), step):
                part = np.array(ix[s : s + step])
                at = self._at([words[i] for i in part])
                r, c = np.nonzero(at >= 0)
                row = self.table[at[r, c]]
                r, c, row = r[row > 0], c[row > 0], row[row > 0]
                if len(r):
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    for lo in range(0, len(first), many):  # bounds the memory of the products
                        hi = first[lo + many] if lo + many < len(first) else len(r)
                        x = value[row[first[lo] : hi]]
                        x = x * (fade[c[first[lo] : hi]] if x.ndim == 1 else fade[c[first[lo] : hi], None])
                        out[part[r[first[lo : lo + many]]]] = np.add.reduceat(x, first[lo : lo + many] - first[lo], axis=0)
        return out

    def gram(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark."""
        return self.over(words, self.weight)

    def map(self, words: list[str]) -> np.ndarray:
        return self.gram(words) @ self.basis


@dataclass
class Model:
    """A document scores the logistic of its most toxic unit's margin."""

    landmarks: list[str]
    w: np.ndarray
    b: float
    slope: float
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(words), -1.0)
        if not hasattr(self, "_kernel"):
            self._kernel = Kernel(self.landmarks)
            self._value = self._kernel.weight @ self._kernel.basis @ self.w
        return self._kernel.over(words, self._value) + self.b

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def grams(u: str) -> set[str]:
    return {u[i : i + n] for n in range(4, 9) for i in range(len(u) - n + 1)}


def hash_of(g: str) -> int:
    return zlib.crc32(g.encode()) & ((1 << 22) - 1)


def choose_landmarks(bags: list[tuple[int, set[str]]], most: int = LANDMARKS, extra: int = 24) -> tuple[list[str], dict[str, str], dict[str, float]]:
    """Substrings of 4 to 8 characters that mark toxic documents, picked greedily by the toxic documents in which
    they explain a unit no earlier pick does, less clean ones; then units of clean documents as background.
    Also the witnesses: each unit that holds a pick, with that pick; and how many documents each pick explains."""
    df = ({}, {})
    for k, (y, bag) in enumerate(bags):
        for u in bag:
            df[y].setdefault(u, []).append(k)
    n_pos = sum(y for y, _ in bags)
    need = max(3, 0.008 * n_pos)
    share = n_pos / max(1, len(bags) - n_pos)
    rough = np.zeros(1 << 22, np.int32)  # hashed counts first, so that only frequent substrings are ever held by name
    for u, ks in df[1].items():
        for g in grams(u):
            rough[hash_of(g)] += len(ks)
    good, bad = Counter(), Counter()
    for u, ks in df[1].items():
        for g in grams(u):
            if rough[hash_of(g)] >= need:
                good[g] += len(ks)
    hope = {g for g, n in good.items() if n >= need}
    for u, ks in df[0].items():
        for g in grams(u) & hope:
            bad[g] += len(ks)
    hope = {g for g in hope if bad[g] * share * 20 <= good[g]}
    holds: dict[str, set[str]] = {g: set() for g in hope}
    for u in df[1]:
        for g in grams(u) & hope:
            holds[g].add(u)
    picked, witness, explains = [], {}, {}
    gain = {g: len({k for u in us for k in df[1][u]}) - 5 * bad[g] * share for g, us in holds.items()}
    while len(picked) < most and gain:
        best = max(gain, key=lambda g: (gain[g], len(g), g))
        if gain[best] < need:
            break
        picked.append(best)
        gone, explains[best] = holds[best], gain[best]
        witness.update(dict.fromkeys(gone, best))
        for g in {g for u in gone for g in grams(u) & hope}:
            holds[g] = holds[g] - gone
            gain[g] = len({k for u in holds[g] for k in df[1][u]}) - 5 * bad[g] * share
            if gain[g] < need:
                gain.pop(g, None)
                hope.discard(g)
    plain = sorted((u for u in df[0] if 5 <= len(u) <= 9 and u not in witness), key=lambda u: zlib.crc32(u.encode()))[:extra]
    return picked + [u for u in plain if u not in picked], witness, explains


def stretched(word: str, mark: str) -> list[str]:
    """Variants of a witness with a character put into its mark, as an evader would write it."""
    at = word.find(mark)
    lo = at + (2 if mark[0] == "^" else 1)
    return [word[:i] + c + word[i:] for i, c in zip(range(lo, at + len(mark)), ".*-_'1", strict=False)]


def hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps over the rows inside the margin; the bias is all but free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.r_[np.ones(x.shape[1]), 1e-3]
    loss = lambda w: (ridge * w * w).sum() / 2 + (cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        on = y * (z @ w) < 1
        h = np.diag(ridge) + 2 * z[on].T @ (z[on] * cost[on, None])
        to = np.linalg.solve(h, 2 * z[on].T @ (cost[on] * y[on])) - w
        step = 1.0
        while step > 1e-4 and loss(w + step * to) > loss(w):
            step /= 2
        w = w + step * to
        if abs(step * to).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def train(bags: list[tuple[int, set[str]]]) -> Model:
    """Bags are (label, units of a document). Toxic bags teach through their witness units, with gapped variants;
    clean bags through a bounded sample of units and, in a second pass, the units the
    machine gets wrong, some of which become landmarks too."""
    bags = list({(y, frozenset(bag)): (y, bag) for y, bag in bags}.values())  # exact copies teach once
    y = np.array([y for y, _ in bags])
    prior = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 0.45))
    flat = Model([], np.zeros(0), 0.0, 0.0, math.log(prior / (1 - prior)))
    if not y.any() or y.all():
        return flat
    marks, witness, explains = choose_landmarks(bags)
    if not witness:
        return flat
    clean = set().union(*(bag for y, bag in bags if not y)) - set(witness)
    some = sorted(witness, key=lambda u: zlib.crc32(u.encode()))[:4000]
    of = {s: witness[u] for u in some for s in stretched(u, witness[u]) if s not in clean} | {u: witness[u] for u in some}
    pos, per = sorted(of), Counter(of.values())
    share = np.array([explains[of[u]] / per[of[u]] for u in pos])
    ordered = sorted(clean, key=lambda u: zlib.crc32(u.encode()))
    neg = ordered[:MAX_NEGATIVES]
    for k in range(3):
        kernel = Kernel(marks)
        xp, xn = kernel.map(pos), kernel.map(neg)
        x, t = np.vstack([xp, xn]), np.r_[np.ones(len(xp)), -np.ones(len(xn))]
        w, b = hinge(x, t, COST * np.r_[share / share.sum(), np.full(len(xn), 1 / len(xn))])
        model = Model(marks, w, b, 1.0, 0.0)
        m = model.margins(ordered)
        worst = [ordered[i] for i in np.argsort(-m, kind="stable")[:3000] if m[i] > -0.7]
        if k == 2 or not set(worst) - set(neg):
            break
        neg = neg + sorted(set(worst) - set(neg))
        marks = marks + [u for u in worst[:: max(1, len(worst) // 80)] if len(u) <= 12 and u not in marks]
    every = sorted(set().union(*(bag for _, bag in bags)))
    margin = dict(zip(every, model.margins(every), strict=True))
    top = np.clip([max((margin[u] for u in bag), default=-3.0) for _, bag in bags], -3, 3)
    model.slope, model.shift = platt(top, y)
    return model


def platt(m: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic calibration of bag margins by Newton steps; the slope stays positive."""
    z, c = np.c_[m, np.ones(len(m))], np.zeros(2)
    t = np.where(y > 0, 0.98, 0.02)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - t) + 1e-3 * c)
        c = c - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(c[0]), 0.1), float(c[1])


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Train on labelled documents outside the held-out fifth: at most max_toxic and max_clean rows, least hash
    first. Only the sampled documents' distinct units come to the driver, so its memory is bounded by the sample. Null
    labels and ids teach nothing, a document labelled twice counts as toxic if either label says so, texts that repeat
    teach once; without labels of both kinds every text scores the prior."""
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    take = lab.where("y = 1").orderBy("h").limit(max_toxic).union(lab.where("y = 0").orderBy("h").limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(take.select("doc_id", "y")), "doc_id")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            yield pd.DataFrame({"y": x["y"], "u": [" ".join(sorted(units(t))) for t in x["text"]]})

    got = rows.mapInPandas(run, "y int, u string").toPandas().sort_values(["y", "u"], kind="stable")
    return train([(int(y), set(u.split(" ")) - {""}) for y, u in zip(got["y"], got["u"], strict=True)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs, over whole texts; null and empty texts have no unit and score lowest.

    Repeated rows score alike, a score of 0.5 predicts toxic, an empty table gives an empty result, other columns are
    not read; words longer than WINDOW are scored in overlapping windows, so long ones cost in proportion.
    The model is a few hundred kilobytes whatever the input. A worker remembers margins of _CACHE units at most.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        cache: dict[str, float] = {}
        for x in it:
            out = []
            for s in range(0, len(x), 256):
                bags = [units(t) for t in x["text"].iloc[s : s + 256]]
                new = list(set().union(*bags).difference(cache))
                if len(cache) + len(new) > _CACHE:
                    cache.clear()
                    new = list(set().union(*bags))
                for i in range(0, len(new), 20_000):
                    part = new[i : i + 20_000]
                    cache.update(zip(part, m.margins(part).tolist(), strict=True))
                out += [max(map(cache.__getitem__, bag), default=-3.0) for bag in bags]
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "score": m.score(np.clip(out, -3, 3))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
