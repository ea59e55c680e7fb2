"""Quality rules: base counts, and tokeniser fertility held against bands per language and length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents, packed, words
from rankloom.plans.session import cut

# The symbols, white space, and the base limits.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: Bands reach this many interquartile ranges beyond the quartiles; groups with fewer documents have no band.
SPREAD, WIDE, LEAST_DOCS, PRECISION = 3.0, 4.0, 100, 10_000
#: The least half-widths of the bands of a language's length class, and of a language whose classes are too small, so that
#: groups whose documents are all alike reject none of them; below SHORT words they grow as the scatter of a mean does.
FLOOR = {"chars_per_token": 0.12, "byte_share": 0.02, "entropy": 0.4, "rare_chars_per_token": 0.3}
SHORT = 256
WIDE_FLOOR = {"chars_per_token": 0.5, "byte_share": 0.05, "entropy": 2.0, "rare_chars_per_token": 1.0}
_CACHE = 200_000
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more. Windows are found by a 64-bit hash, and those
    it calls repeated are compared word by word."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _MULT[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    some = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    rows = np.stack([ids[some + k] for k in range(WINDOW)], axis=1)
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = some[count[back.reshape(-1)] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    t = text or ""
    w = words(t)
    lines, seen, dup = t.split("\n") if t else [], set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
    return len(w), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), dup, repeated_words(ids)


class Fertility:
    """Characters per token, byte-fallback share and token entropy of whole texts under a public sentencepiece
    vocabulary; and characters per token of the words it has no pieces for under a second one, of many languages. Pieces
    never span spaces, so a text's tokens are its words'; a cache holds _CACHE words at most."""

    def __init__(self, path: str, second: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.path = second
        self.known: dict[bytes, bytes] = {}
        self.rare: dict[bytes, tuple[int, int]] = {}

    @cached_property
    def second(self):
        """Loaded when the first rare word is met; most workers meet none."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, new: list[bytes]) -> None:
        text = [w.decode("utf-8", "replace") for w in new]
        for w, t, ids in zip(new, text, self.model.encode(text, num_threads=1), strict=True):
            ids = np.array(ids, np.uint16)
            self.known[w] = ids.tobytes()
            if self.byte[ids].any():
                self.rare[w] = len(t), len(self.second.encode_ordinary(t))

    def __call__(self, bags: list[list[bytes]], chars: list[int]) -> np.ndarray:
        if len(self.known) > _CACHE:
            self.known.clear()
            self.rare.clear()
        new = list(set().union(*bags).difference(self.known))
        for i in range(0, len(new), 10_000):
            self._learn(new[i : i + 10_000])
        out = np.full((len(bags), 4), np.nan)
        for r, (bag, c) in enumerate(zip(bags, chars, strict=True)):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, bag)), np.uint16)
            if len(ids):
                n = np.sort(ids)
                n = np.diff(np.r_[0, np.flatnonzero(n[1:] != n[:-1]) + 1, len(n)]) / len(n)
                out[r, :3] = c / len(ids), self.byte[ids].mean(), -(n * np.log2(n)).sum()
                if out[r, 1]:
                    a, b = np.array([self.rare[w] for w in bag if w in self.rare]).sum(axis=0)
                    out[r, 3] = a / b
        return out


_ROW = "doc_id long, lang string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, entropy double, rare_chars_per_token double"


def measure(docs: DataFrame, path: str, second: str) -> DataFrame:
    """One narrow row per row of docs: base counts and fertility measures (null without words)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fertility = Fertility(path, second)
        for x in it:
            for s in range(0, len(x), 256):
                y = x.iloc[s : s + 256]
                base = np.array([base_counts(t) for t in y["text"]], np.int64)
                got = fertility([words(t) for t in y["text"]], base[:, 1].tolist())
                out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
                out[list(FLOOR)] = got
                yield out.assign(doc_id=y["doc_id"].astype("Int64").to_numpy(), lang=y["lang"].to_numpy(), th=y["th"].to_numpy())

    text = F.col("text").cast("string")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), text, F.xxhash64(text).alias("th")).mapInPandas(run, _ROW)


def _quartiles(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and, as structs under name, the quartiles of each measure over the rows of groups that have LEAST_DOCS of it."""
    some = lambda c: F.when(F.count(c) >= LEAST_DOCS, F.percentile_approx(c, [0.25, 0.75], PRECISION)).alias(c)
    per = rows.groupBy(*by).agg(F.count("*").alias("n"), *map(some, FLOOR)).where(F.col("n") >= LEAST_DOCS)
    return cut(per.select(*by, F.struct(*FLOOR).alias(name)))


def banded(rows: DataFrame, spread: float = SPREAD) -> DataFrame:
    """rows with outside: a fertility measure lies outside its band. Measures scatter less in longer texts, so bands are for a
    language's documents of one length class (a doubling of words): the quartiles of its distinct texts that pass the
    base rules, widened by spread interquartile ranges, FLOOR at least and more in short texts. A class with fewer than LEAST_DOCS of them
    takes the language's band, which is wider; a language with fewer has none, and fertility rejects none of its
    documents: other languages' bands say nothing about it. Copies of a text count once, so they move no band."""
    rows = rows.withColumn("k", F.floor(F.log2(F.greatest("n_words", F.lit(1)).cast("double"))).cast("int"))
    fine = rows.where(~F.col("base_failed")).dropDuplicates(["lang", "th"])
    for by, name in ((["lang", "k"], "own"), (["lang"], "wide")):
        per = _quartiles(fine, by, name)
        rows = rows.join(F.broadcast(per) if per.count() <= 10_000 else per, by, "left")
    scatter = F.sqrt(F.greatest(F.lit(1.0), SHORT / F.greatest("n_words", F.lit(1))))
    out = F.lit(False)
    for c in FLOOR:
        for name, times, least in (("own", spread, FLOOR[c]), ("wide", WIDE, WIDE_FLOOR[c])):
            q = F.col(name)[c]
            reach = F.greatest(times * (q[1] - q[0]), least * scatter)
            off = F.coalesce((F.col(c) < q[0] - reach) | (F.col(c) > q[1] + reach), F.lit(False))
            out = out | (off if name == "own" else off & F.col("own").isNull())
    return rows.withColumn("outside", out).drop("k", "own", "wide")


def judge(docs: DataFrame, path: str | None = None, spread: float = SPREAD, second: str | None = None) -> DataFrame:
    """doc_id, th (hash of the text), base counts, fertility measures, base_failed and kept of every row of docs.

    Null and empty texts have counts 0, no measures, and fail the base rules. A null or missing lang is a language of
    its own. Repeated rows are judged alike, a measure at a band's edge lies inside, an empty table gives an empty
    result. Texts and words of any length are tokenised whole. path: a sentencepiece vocabulary, the public 32k one
    unless given; second: a byte-level one for the words it falls back to bytes for. Other columns are not read.
    """
    import public_tokenizers

    rows = cut(measure(docs, path or public_tokenizers.path("piece_bpe_32k.model"), second or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = banded(rows.withColumn("base_failed", failed), spread)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("outside"))


def keep(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    good = judge(docs, **params).where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    rows = packed(docs, id=F.col("doc_id").cast("long"), h=F.xxhash64(F.col("text").cast("string")))
    return rows.join(good, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_th")), "left_semi").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
