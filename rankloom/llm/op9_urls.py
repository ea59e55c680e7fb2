"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.session import cut

# The rules.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: URLs of the labelled sample, the trees, and the frequent path segments and host words that are features.
SAMPLE, ROUNDS, DEPTH, RATE, BINS, WORDS, LEAST = 20_000, 60, 3, 0.2, 32, 32, 20
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "params", "hyphens", "longest_label", "longest_digits", "upper_ratio", "secure", "suffix_length", "suffix_share", "suffix_hosts")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule whose host is h or a parent of it and whose path p starts with; null if none."""
    out = F
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at = rule.index("/")
        fits = ((h == rule[:at]) | h.endswith("." + rule[:at])) & p.startswith(rule[at:])
        out = out.when(fits, F.lit(rule))
    return out.otherwise(F.lit(None)) if out is not F else F.lit(None).cast("string")


def entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.array(list(Counter(s).values()), float) / len(s)
    return float(-(n * np.log2(n)).sum())


def suffix(h: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(h, ".", -2)


def segment(p: Column) -> Column:
    """The first part of a path; empty where it is longer than a word."""
    return F.regexp_extract(p, r"^/([^/?#\s]{1,24})(?:/|$)", 1)


def host_words(h: Column) -> Column:
    """The words of a host before its last two labels."""
    own = F.substr(h, F.lit(1), F.char_length(h) - F.char_length(suffix(h)))
    return F.array_distinct(F.regexp_extract_all(own, F.lit(r"[^.-]{1,24}"), 0))


class Lexical:
    """Features of urls: FEATURES, then whether the first path segment or a word of the host is one of the frequent
    ones. None of them has seen a label. It is known by two lists of WORDS words at most."""

    def __init__(self, segments: list[str], words: list[str]) -> None:
        self.at = {k: i for i, k in enumerate(["/" + s for s in segments] + words, len(FEATURES))}
        self.wide = len(FEATURES) + len(self.at)

    def __call__(self, rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(rows), self.wide), np.float32)
        for i, r in enumerate(rows.itertuples(index=False)):
            u, h, labels = r.url or "", r.host, r.host.split(".")
            out[i, : len(FEATURES)] = [len(u), len(h), r.path.count("/"), len(labels), sum(c.isdigit() for c in u) / max(1, len(u)), entropy(u), entropy(h), u.count("=") if "?" in u else 0, h.count("-"), max(map(len, labels)), max(map(len, re.findall("[0-9]+", u)), default=0), sum(c.isupper() for c in u) / max(1, len(u)), u.startswith("https"), len(r.suffix), r.suffix_share, r.suffix_hosts]
            for k in ("/" + r.segment, *r.words):
                if k in self.at:
                    out[i, self.at[k]] = 1
        return out


class Boosted:
    """Gradient-boosted trees for the logistic loss on binned features; complete trees of DEPTH levels as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> None:
        self.base = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b = self._bin(x)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), np.log(self.base / (1 - self.base)))
        for _ in range(rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            score = score + self._leaf(b, tree)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << DEPTH) - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(len(b), np.int64)
        for k in range(inner):
            on = np.flatnonzero(node == k)
            if len(on) >= 20:
                gain, whole = 1e-6, g[on].sum() ** 2 / (h[on].sum() + 1)
                for j in range(b.shape[1]):
                    gs, hs = np.cumsum(np.bincount(b[on, j], g[on], BINS + 2)), np.cumsum(np.bincount(b[on, j], h[on], BINS + 2))
                    part = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                    if part.max() > gain:
                        gain, feature[k], cut[k] = part.max(), j, int(part.argmax())
            node[on] = 2 * k + 1 + (b[on, feature[k]] > cut[k])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        return feature, cut, value

    def _leaf(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - ((1 << DEPTH) - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), np.log(self.base / (1 - self.base)))
        for tree in self.trees:
            out += self._leaf(b, tree)
        return 1 / (1 + np.exp(-out))


_USED = ["url", "host", "path", "suffix", "segment", "words", "suffix_share", "suffix_hosts"]


def described(urls: DataFrame) -> DataFrame:
    """urls (url, ...) with host, path and what features need: suffix, segment, words and, over all rows, the suffix's
    share of urls and of hosts. Rows are counted by suffix before they are shuffled."""
    rows = urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("suffix", suffix(F.col("host"))).withColumn("segment", segment(F.col("path"))).withColumn("words", host_words(F.col("host")))
    per = rows.groupBy("suffix", "host").agg(F.count("*").alias("n")).groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"))
    per = cut(per)
    total = per.agg(F.sum("n").alias("n"), F.sum("hosts").alias("hosts"), F.count("*").alias("suffixes")).first()
    per = per.select("suffix", (F.col("n") / F.lit(float(total.n or 1))).alias("suffix_share"), (F.col("hosts") / F.lit(float(total.hosts or 1))).alias("suffix_hosts"))
    return rows.join(F.broadcast(per) if total.suffixes <= 100_000 else per, "suffix")


def frequent(rows: DataFrame, word: Column, most: int = WORDS, least: int = LEAST) -> list[str]:
    """The most frequent words, with at least so many rows."""
    got = rows.select(word.alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r.w for r in got.orderBy(F.desc("n"), "w").limit(most).collect()]


def train(rows: DataFrame, features: Lexical, sample: int = SAMPLE) -> Boosted:
    """rows: described urls with y, 1 for block, null where unknown. Fits on about sample distinct labelled urls, those
    of least hash, so a much repeated url teaches once. The features are made on the executors; the driver gets
    sample rows of them, whatever the urls' lengths."""
    got = rows.where("y is not null").groupBy(F.xxhash64("url").alias("h")).agg(F.max("y").alias("y"), *(F.first(c).alias(c) for c in _USED))
    got = cut(got)
    share = min(1.0, sample / max(1, got.count()))
    picked = got.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            yield pd.DataFrame({"h": x["h"], "y": x["y"], "x": [v.tobytes() for v in features(x[_USED])]})

    got = sorted(picked.mapInPandas(run, "h long, y int, x binary").collect())
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), features.wide)
    return Boosted(x, np.array([r.y for r in got], float))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every row of pages (page_id, url).

    Where a rule fits its verdict holds. Elsewhere the trees decide: block from a score of 0.5 on. They learn from
    labelled (url, y; 1 for block) or, without it, from the urls that the rules label; no feature is made from labels,
    so that a suffix whose labelled urls are all alike doesn't settle the verdicts on the others. A null or odd url
    has an empty host and path, fits no rule and is scored on these. Without labels of both kinds the base rate
    decides. Repeated rows are judged alike, rules of one length in the order of their text; an empty table gives an empty
    result. URLs of any length are read whole; other columns of pages are not read.
    """
    rows = described(pages.select("page_id", F.col("url").cast("string").alias("url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    fixed = F
    for r, v in rules.items():
        fixed = fixed.when(F.col("rule") == r, v)
    rows = rows.withColumn("fixed", fixed.otherwise(F.lit(None)) if rules else F.lit(None).cast("string"))
    features = Lexical(frequent(rows, F.col("segment")), frequent(rows, F.explode("words")))
    if labelled is None:
        taught = rows.withColumn("y", (F.col("fixed") == "block").cast("int"))
    else:
        taught = described(labelled.select(F.col("url").cast("string").alias("url"), F.col("y").cast("int").alias("y")))
    known = pages.sparkSession.sparkContext.broadcast(train(taught, features))

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        return pd.Series(known.value.score(features(x)))

    rows = rows.withColumn("score", scored(F.struct(*_USED)))
    verdict = F.coalesce(F.col("fixed"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
