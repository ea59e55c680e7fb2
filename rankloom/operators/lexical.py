"""Lexical retrieval: postings, BM25, and character TF-IDF."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import fold, tokens
from rankloom.operators.vector import Best
from rankloom.plans.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs: DataFrame, queries: DataFrame, top: int = 10, block: int = 4096) -> DataFrame:
    """(qid, doc_id, rank, score): Okapi BM25 with k1 1.5, b 0.75; a negative idf becomes 0.25 times the mean idf over
    the vocabulary; one contribution per occurrence of a term in the query. Documents without a query term are not
    listed. Texts are tokenised once and written once; document frequencies are one aggregate, counted where they are
    read. The queries are a stated set, taken in blocks by hash: a task scores its documents against a block and passes
    on the top ones of each query, so that neither a common word nor a long list of hits is ever shuffled."""
    rows = cut(docs.select("doc_id", tokens(F.col("text")).alias("t")))
    size = rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).first()
    raw = rows.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = cut(raw.withColumn("idf", F.log(F.lit(float(size.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("idf")).first()[0]
    q = queries.select("qid", F.explode(tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))
    idf = F.when(F.col("idf") < 0, F.lit(mean) * EPSILON).otherwise(F.col("idf"))
    q = cut(q.join(raw, "term").select("qid", "term", (F.col("qf") * idf).alias("weight")))
    k = max(1, -(-q.select("qid").distinct().count() // block))
    out = None
    for b in range(k):
        asked = q.where(F.pmod(F.xxhash64("qid"), F.lit(k)) == b).collect()
        if asked:
            run = partial(_scored, asked=[tuple(r) for r in asked], top=top, avgdl=size.avgdl)
            found = rows.mapInPandas(run, "qid long, doc_id long, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "qid long, doc_id long, rank long, score double")
    w = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("qid", "doc_id", "rank", "score")


def _scored(it: Iterator[pd.DataFrame], asked: list[tuple[int, str, float]], top: int, avgdl: float) -> Iterator[pd.DataFrame]:
    ids = np.unique([a for a, _, _ in asked])
    terms: dict[str, tuple[list[int], list[float]]] = {}
    for a, term, weight in asked:
        own = terms.setdefault(term, ([], []))
        own[0].append(int(np.searchsorted(ids, a)))
        own[1].append(weight)
    kept = Best(ids, top)
    for x in it:
        for at in range(0, len(x), 1024):
            y = x.iloc[at : at + 1024]
            where: dict[str, tuple[list[int], list[float]]] = {}
            for i, t in enumerate(y["t"]):
                long = K1 * (1 - B + B * len(t) / avgdl)
                for term, tf in Counter(w for w in t if w in terms).items():
                    own = where.setdefault(term, ([], []))
                    own[0].append(i)
                    own[1].append(tf * (K1 + 1) / (tf + long))
            score, hit = np.zeros((len(ids), len(y))), np.zeros((len(ids), len(y)), bool)
            for term in sorted(where):
                cell = np.ix_(terms[term][0], where[term][0])
                score[cell] += np.outer(terms[term][1], where[term][1])
                hit[cell] = True
            kept.add(np.where(hit, np.round(score, 6), -np.inf), y["doc_id"].to_numpy(np.int64))
    yield from kept.rows()


def holding(docs: DataFrame, queries: DataFrame, block: int = 100_000) -> DataFrame:
    """(qid, doc_id) where the document's text contains the whole of the query's question. queries is a stated query set,
    taken in blocks by hash; one automaton of a block's questions goes over every text once, whatever their number."""
    k = max(1, -(-queries.count() // block))
    out = None
    for b in range(k):
        asked = [(r.question, r.qid) for r in queries.where(F.pmod(F.xxhash64("qid"), F.lit(k)) == b).select("qid", "question").collect() if r.question]
        found = docs.mapInPandas(partial(_hold, asked=asked), "qid long, doc_id long")
        out = found if out is None else out.unionByName(found)
    return out


def _hold(it: Iterator[pd.DataFrame], asked: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
    import ahocorasick

    ids: dict[str, list[int]] = {}
    for q, i in asked:
        ids.setdefault(q, []).append(i)
    machine = ahocorasick.Automaton()
    for q in ids:
        machine.add_word(q, q)
    machine.make_automaton()
    for x in it:
        hits = [(i, d) for d, t in zip(x["doc_id"], x["text"], strict=True) if t and ids for q in {q for _, q in machine.iter(t)} for i in ids[q]]
        yield pd.DataFrame(hits, columns=["qid", "doc_id"])


def char_tfidf(rows: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (3, 4, 5), min_df: int = 2, most: int = 180_000) -> DataFrame:
    """(key, gram, weight): character n-grams inside words padded by spaces, those of min_df rows at least and of them the
    most frequent (the cap is the vocabulary's stated size), sublinear tf, smoothed idf, unit norm."""
    total = rows.count()
    words = rows.select(key, F.explode(F.split(fold(F.col(text)), r"\s+")).alias("w")).where("w <> ''").select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    of = lambda n: F.when(F.char_length("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("w") - (n - 1))), lambda i: F.substr("w", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = words.select(key, F.explode(F.concat(*map(of, sizes))).alias("gram"))
    tf = cut(grams.groupBy(key, "gram").agg(F.count("*").alias("tf")))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("c")).where(F.col("df") >= min_df)
    df = df.orderBy(F.desc("c"), "gram").limit(most).select("gram", "df")
    w = tf.join(df, "gram").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    return w.select(key, "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).alias("weight"))


def pair_cosine(weights: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, cosine) of given pairs only, through the grams they share."""
    left = weights.select(F.col(key).alias("a"), "gram", F.col("weight").alias("wa"))
    right = weights.select(F.col(key).alias("b"), "gram", F.col("weight").alias("wb"))
    hit = pairs.join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def _grams(word: str, sizes: tuple[int, ...]) -> list[str]:
    return [w[i : i + n] for w in (f" {word} ",) for n in sizes for i in range(len(w) - n + 1)]


def char_vocabulary(texts: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), min_df: int = 2, most: int = 180_000, hold: int = 500_000) -> DataFrame:
    """(gram, df) of char_tfidf's vocabulary for texts with words, folded and joined by spaces. Tasks count what they read and
    pass on a row a gram, so rows grow with the vocabulary instead of with the texts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, tf = Counter(), Counter()
        known: dict[str, list[str]] = {}

        def made() -> pd.DataFrame:
            return pd.DataFrame({"gram": list(tf), "df": [df[g] for g in tf], "c": list(tf.values())})

        for x in it:
            for t in x["words"]:
                own: Counter = Counter()
                for w in (t or "").split(" "):
                    if w:
                        if w not in known:
                            if len(known) > 50_000:
                                known.clear()
                            known[w] = _grams(w, sizes)
                        own.update(known[w])
                df.update(own.keys())
                tf.update(own)
                if len(tf) > hold:
                    yield made()
                    df, tf = Counter(), Counter()
        yield made()

    part = texts.select("words").mapInPandas(run, "gram string, df long, c long")
    part = part.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("c").alias("c")).where(F.col("df") >= min_df)
    return part.orderBy(F.desc("c"), "gram").limit(most).select("gram", "df")


def pair_lexical(pairs: DataFrame, texts: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), chars: int = 8_000_000) -> DataFrame:
    """pairs (a, b, cosine) with lexical_cosine, the cosine of their character n-gram weights as char_tfidf gives them, and what
    texts (id, words, k array, g long) say of both: same<n> for each key of k, both, either: the bits set in both and in any g.

    Texts are dealt into chunks of about chars characters, and a block of two chunks holds the vectors of its texts, a row a
    text, and meets its pairs as a stream: a text is shuffled once a chunk and never once a pair or a gram."""
    spark = texts.sparkSession
    texts = cut(texts)
    size = texts.agg(F.count("words").alias("n"), F.sum(F.char_length("words")).alias("c")).first()
    rows = cut(char_vocabulary(texts, sizes)).collect()  # bounded by the vocabulary's stated size
    at = {r.gram: i for i, r in enumerate(rows)}
    idf = np.array([np.log((1 + size.n) / (1 + r.df)) + 1 for r in rows])
    del rows
    k = max(1, -(-(size.c or 0) // chars))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    own = texts.withColumn("c", chunk("id")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    own = own.select(F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("cosine"), "words", "k", "g")
    met = pairs.select(F.least(chunk("a"), chunk("b")).alias("i"), F.greatest(chunk("a"), chunk("b")).alias("j"), F.lit(1).alias("kind"), "a", "b", "cosine")
    tasks = spark.sparkContext.defaultParallelism * 4
    both = own.unionByName(met, allowMissingColumns=True).repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "kind", "a")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        dense, block = np.zeros(len(idf)), None
        none, blank = (np.zeros(0, np.int32), np.zeros(0)), ([None] * 3, 0)
        where: dict[int, int] = {}

        def vector(t: str | None) -> tuple[np.ndarray, np.ndarray]:
            found = []
            for w in (t or "").split(" "):
                if w:
                    if w not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[w] = np.array([at[g] for g in _grams(w, sizes) if g in at], np.int32)
                    found.append(known[w])
            if not found:
                return none
            i, n = np.unique(np.concatenate(found), return_counts=True)
            v = (1 + np.log(n)) * idf[i]
            return i, v / (np.sqrt((v * v).sum()) or 1.0)

        for x in it:
            keys = x[["i", "j"]].to_numpy()
            kinds = x["kind"].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])) + 1), len(x)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if block != tuple(keys[lo]):
                    block, where, vectors, about = tuple(keys[lo]), {}, [], []
                y = x.iloc[lo:hi]
                if not kinds[lo]:
                    for i, t, k, g in zip(y["a"], y["words"], y["k"], y["g"], strict=True):
                        where[i] = len(vectors)
                        vectors.append(vector(t))
                        about.append(([None] * 3 if k is None else list(k), 0 if pd.isna(g) else int(g)))
                    continue
                out, last, held = [], None, none[0]
                for a, b, c in zip(y["a"], y["b"].astype("int64"), y["cosine"], strict=True):
                    p, q = where.get(a, -1), where.get(b, -1)
                    va, vb = (vectors[p] if p >= 0 else none), (vectors[q] if q >= 0 else none)
                    if a != last:
                        dense[held] = 0
                        held, last = va[0], a
                        dense[held] = va[1]
                    lex = float(np.dot(dense.take(vb[0]), vb[1]))
                    (ka, ga), (kb, gb) = (about[p] if p >= 0 else blank), (about[q] if q >= 0 else blank)
                    out.append((a, b, c, lex, *(u is not None and u == v for u, v in zip(ka, kb, strict=True)), (ga & gb).bit_count(), (ga | gb).bit_count()))
                dense[held] = 0
                yield pd.DataFrame(out, columns=["a", "b", "cosine", "lexical_cosine", "same1", "same2", "same3", "both", "either"])

    return both.mapInPandas(run, "a long, b long, cosine double, lexical_cosine double, same1 boolean, same2 boolean, same3 boolean, both long, either long")
