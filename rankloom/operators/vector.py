"""Exact vector search and what is built on child similarities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.plans.session import cut

#: Queries that children hold at a time, and vectors of a chunk (and aimed at in a bucket) of near_pairs.
BLOCK, BUCKET = 4096, 16_384

#: Queries of one pass of the search, and queries and documents scored at a time within it.
PASS, PART, ROWS = 65_536, 256, 4096


def dot(a: Column, b: Column) -> Column:
    """Dot product in double, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A stated query set in blocks of about block rows by hash: (ids in order, matrix)."""
    k = max(1, -(-queries.count() // block))
    for b in range(k):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(k)) == b).select("qid", "embedding").toArrow().combine_chunks()
        if len(rows):
            ids = rows["qid"].to_numpy()
            order = np.argsort(ids, kind="stable")
            v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["embedding"].chunks])
            yield ids[order], v.astype(np.float64).reshape(len(rows), -1)[order]


def _matrix(x: pd.DataFrame, lo: int = 0, hi: int | None = None) -> np.ndarray:
    return np.ascontiguousarray(np.array(x["embedding"].tolist(), np.float64)[:, lo:hi])


def _scores(q: np.ndarray, ids: np.ndarray, docs: np.ndarray, v: np.ndarray, itself: bool) -> np.ndarray:
    """Scores of all queries with documents of vectors v; a query with itself gets -inf unless itself is set."""
    s = np.round(q @ v.T, 9)
    if not itself:
        own = np.searchsorted(ids, docs)
        hit = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == docs))
        s[own[hit], hit] = -np.inf
    return s


def topk(queries: DataFrame, docs: DataFrame, k: int, lo: int = 0, hi: int | None = None, itself: bool = False, block: int = PART) -> DataFrame:
    """(qid, doc_id, rank, score): the k documents of largest dot product over dimensions lo to hi, ties by doc_id; a
    document of the query's own id is left out unless itself is set.

    queries is a stated query set; up to PASS of them reach the driver for one pass over docs, in which a task scores
    block of them at a time. It keeps its k best of every query and passes these on at its end, so what is shuffled is
    the number of tasks times the queries times k, whatever the size of docs.
    """
    return topk_parts(queries, docs, k, {"": (lo, hi)}, itself, block).drop("part")


def topk_parts(queries: DataFrame, docs: DataFrame, k: int, parts: dict[str, tuple[int, int | None]], itself: bool = False, block: int = PART) -> DataFrame:
    """(part, qid, doc_id, rank, score): topk over each of several ranges of dimensions; the queries are fetched once."""
    out = None
    for ids, q in _blocks(queries, PASS):
        for name, (lo, hi) in parts.items():
            run = partial(_best, ids=ids, q=np.ascontiguousarray(q[:, lo:hi]), k=k, lo=lo, hi=hi, itself=itself, block=block)
            found = docs.select("doc_id", "embedding").mapInPandas(run, "qid long, doc_id long, score double").withColumn("part", F.lit(name))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "part string, qid long, doc_id long, rank long, score double")
    w = W.partitionBy("part", "qid").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("part", "qid", "doc_id", "rank", "score")


def _best(it: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray, k: int, lo: int, hi: int | None, itself: bool, block: int) -> Iterator[pd.DataFrame]:
    kept = Best(ids, k)
    for x in it:
        for at in range(0, len(x), ROWS):
            y = x.iloc[at : at + ROWS]
            docs, v = y["doc_id"].to_numpy(np.int64), _matrix(y, lo, hi)
            for first in range(0, len(ids), block):
                kept.add(_scores(q[first : first + block], ids[first : first + block], docs, v, itself), docs, first)
    yield from kept.rows()


class Best:
    """The k best documents of each query over the batches of a task, ties by document id; -inf is no document."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.n = np.zeros(len(ids), np.int64)
        self.score, self.doc = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, s: np.ndarray, docs: np.ndarray, first: int = 0) -> None:
        """Scores of the queries from the first on with docs."""
        k = self.k
        better = (s >= self.score[first : first + len(s), -1:]) & (s > -np.inf) if k else np.zeros_like(s, bool)
        for i in np.flatnonzero(better.any(axis=1)):
            at, new = first + i, np.flatnonzero(better[i])
            if len(new) > 4 * k:
                x = s[i, new]
                new = new[x >= np.partition(x, len(x) - k)[len(x) - k]]
            n = self.n[at]
            x, d = np.r_[self.score[at, :n], s[i, new]], np.r_[self.doc[at, :n], docs[new]]
            order = np.lexsort((d, -x))[:k]
            self.n[at] = len(order)
            self.score[at, : len(order)], self.doc[at, : len(order)] = x[order], d[order]

    def rows(self) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(self.ids), 1024):
            row, col = np.nonzero(np.arange(self.k) < self.n[lo : lo + 1024, None])
            yield pd.DataFrame({"qid": self.ids[lo + row], "doc_id": self.doc[lo + row, col], "score": self.score[lo + row, col]})


def children(queries: DataFrame, docs: DataFrame, parents: DataFrame, close: float = 0.025, block: int = BLOCK) -> DataFrame:
    """(qid, parent_id, n, s, witness): what a task's batch knows of each parent's children for each query: how many, the
    three best scores and all within close of the best, in descending order, and the best child. One row for a query, parent
    and batch; a query's own document is left out. parent_max, witness and support put these together."""
    rows = docs.join(parents, "doc_id").select("doc_id", "parent_id", "embedding")
    out = None
    for ids, q in _blocks(queries, block):
        found = rows.mapInPandas(partial(_children, ids=ids, q=q, close=close), "qid long, parent_id long, n long, s array<double>, witness long")
        out = found if out is None else out.unionByName(found)
    return out


def _children(it: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray, close: float) -> Iterator[pd.DataFrame]:
    for x in it:
        x = x.sort_values(["parent_id", "doc_id"], kind="stable").reset_index(drop=True)
        edges = np.flatnonzero(np.r_[True, np.diff(x["parent_id"].to_numpy()) != 0, True]) if len(x) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            y = x.iloc[lo:hi]
            s = _scores(q, ids, y["doc_id"].to_numpy(np.int64), _matrix(y), False)
            n = (s > -np.inf).sum(axis=1)
            some = np.flatnonzero(n)
            order = np.argsort(-s, axis=1, kind="stable")
            top = np.take_along_axis(s, order, axis=1)
            keep = np.minimum(n, np.maximum(3, (top >= top[:, :1] - close).sum(axis=1)))
            yield pd.DataFrame({"qid": ids[some], "parent_id": int(y["parent_id"].iloc[0]), "n": n[some], "s": [top[i, : keep[i]] for i in some], "witness": y["doc_id"].to_numpy()[order[some, 0]]})


def parent_max(found: DataFrame, k: int) -> DataFrame:
    """Best child per parent, then the k best parents of each query."""
    best = found.groupBy("qid", "parent_id").agg(F.max(F.element_at("s", 1)).alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "parent_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def witness(found: DataFrame) -> DataFrame:
    """The child of largest similarity for each (query, parent); the smaller id wins ties."""
    best = F.max(F.struct(F.element_at("s", 1).alias("score"), (-F.col("witness")).alias("w")))
    return found.groupBy("qid", "parent_id").agg(best.alias("x")).select("qid", "parent_id", (-F.col("x.w")).alias("vec_id"), "x.score")


def support(found: DataFrame, close: float = 0.025) -> DataFrame:
    """Best, second and third child similarity (the last repeats), their gap, and log counts of children, all and close."""
    rows = found.groupBy("qid", "parent_id").agg(F.sort_array(F.flatten(F.collect_list("s")), asc=False).alias("s"), F.sum("n").alias("n"))
    at = lambda i: F.element_at("s", F.least(F.lit(i), F.size("s")))
    near = F.size(F.filter("s", lambda x: x >= at(1) - close))
    return rows.select("qid", "parent_id", at(1).alias("best"), at(2).alias("second"), at(3).alias("third"), (at(1) - at(2)).alias("gap"), F.log1p(F.col("n").cast("double")).alias("log_n"), F.log1p(near.cast("double")).alias("log_close"))


def near_pairs(vectors: DataFrame, least: float, miss: float = 1e-6, bucket: int = BUCKET, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """((a, b, cosine), (id, rep)) for rows (id, embedding): the pairs a < b of representatives with cosine least or
    more, and the representative, the least id, of every row. Equal vectors are one class, so copies are never paired.

    Signs of random projections deal the classes into buckets, of about bucket rows, in as many tables as keep the
    chance that a pair at exactly least meets in none below miss, where that compares at most a quarter of all pairs;
    else all are one bucket and nothing is missed. A bucket is compared in blocks of two chunks of bucket rows, in
    parts of bounded size, each pair where its first common table has it. Null and zero vectors and those with a null
    or not finite number are in no pair and stand for themselves.
    """
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("id", F.when(fine, e).alias("e"))
    classes = cut(rows.where("e is not null").groupBy("e").agg(F.min("id").alias("rep")))
    member = rows.join(classes, "e", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    n = classes.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / bucket)))
    tables = 1 if not bits else math.ceil(math.log(miss) / math.log1p(-((1 - math.acos(least) / math.pi) ** bits)))
    if tables > 2**bits / 4:
        bits, tables = 0, 1
    keys = ["t", "code", "i", "j"]

    def units(e: pd.Series) -> np.ndarray:
        v = np.array(e.tolist(), np.float64).reshape(len(e), -1)
        v = v / np.abs(v).max(axis=1, initial=1e-300)[:, None]
        return v / np.sqrt((v * v).sum(axis=1))[:, None]

    def codes(v: np.ndarray, upto: int) -> np.ndarray:
        planes = np.random.default_rng(seed).standard_normal((tables, bits, v.shape[1]))[:upto]
        return np.concatenate([((np.einsum("nd,tbd->ntb", v[lo : lo + 2048], planes) > 0) << np.arange(bits)).sum(axis=2) for lo in range(0, len(v), 2048)])

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            for lo in range(0, len(x), 2048):
                y = x.iloc[lo : lo + 2048]
                c = codes(units(y["e"]), tables)
                for t in range(tables):
                    yield y.assign(t=t, code=c[:, t])

    def compare(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        t, _, i, j = (int(v) for v in x[keys].iloc[0])
        x = x.sort_values("rep")
        v, rep, side = units(x["e"]), x["rep"].to_numpy(), x["c"].to_numpy()
        own, other = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if not len(own) or not len(other):
            return
        seen = codes(v, t) if t else None
        small, slack = v.astype(np.float32), (v.shape[1] + 4) * 1.2e-7
        to = np.ascontiguousarray(small[other].T)
        for lo in range(0, len(own), step := max(1, 2**22 // len(other))):
            at = own[lo : lo + step]
            first = lo if i == j else 0  # rows are in order, so what lies before is met elsewhere
            p, q = np.nonzero(small[at] @ to[:, first:] >= np.float32(least - slack))
            for k in range(0, len(p), 65_536):
                a, b = at[p[k : k + 65_536]], other[q[k : k + 65_536] + first]
                s = np.round(np.einsum("nd,nd->n", v[a], v[b]), 9)
                near = (s >= least) & (a < b if i == j else a != b)
                if t:
                    near &= ~(seen[a] == seen[b]).any(axis=1)
                a, b, s = a[near], b[near], s[near]
                yield pd.DataFrame({"a": rep[np.minimum(a, b)], "b": rep[np.maximum(a, b)], "cosine": s})

    placed = classes.mapInPandas(place, "e array<double>, rep long, t int, code long")
    full = placed.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1").select("t", "code", F.ceil(F.col("n") / bucket).cast("int").alias("k"))
    if not bits:
        placed, full = classes.select("*", F.lit(0).alias("t"), F.lit(0).cast("long").alias("code")), None
    chunks = F.lit(max(-(-n // bucket), min(4, n // 2048 + 1)))  # so that a few thousand rows already make ten blocks
    blocks = (placed.withColumn("k", chunks.cast("int")) if full is None else placed.join(full, ["t", "code"])).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = blocks.select("e", "rep", "c", "t", "code", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    tasks = vectors.sparkSession.sparkContext.defaultParallelism * 4
    return blocks.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(partial(by_runs, keys=keys, run=compare), "a long, b long, cosine double"), member


def by_runs(it: Iterator[pd.DataFrame], keys: list[str], run: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """run over each stretch of rows with equal keys of a sorted stream, its results passed on as they come."""
    held: list[pd.DataFrame] = []
    for x in it:
        if not len(x):
            continue
        k = x[keys].to_numpy()
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(x)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and (held[-1][keys].iloc[-1].to_numpy() != k[lo]).any():
                yield from run(pd.concat(held))
                held = []
            held.append(x.iloc[lo:hi])
    if held:
        yield from run(pd.concat(held))


def centroids(docs: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, pos, value): mean of the children's vectors, then unit norm."""
    rows = docs.join(parents, "doc_id").select("parent_id", F.posexplode("embedding").alias("pos", "v"))
    mean = rows.groupBy("parent_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    w = W.partitionBy("parent_id")
    return mean.select("parent_id", F.col("pos").cast("long").alias("pos"), (F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(w))).alias("value"))


def child_ranges(rows: DataFrame) -> DataFrame:
    """rows (parent_id, row): (parent_id, lo, hi) where a parent's rows are lo to hi, hi exclusive; others raise."""
    x = rows.groupBy("parent_id").agg(F.min("row").alias("lo"), (F.max("row") + 1).alias("hi"), F.count_distinct("row").alias("n"), F.count("*").alias("m"))
    bad = F.assert_true((F.col("n") == F.col("hi") - F.col("lo")) & (F.col("n") == F.col("m")), F.concat(F.lit("rows of a parent are not contiguous: "), F.col("parent_id").cast("string")))
    return x.select("parent_id", "lo", F.coalesce(bad.cast("long"), F.col("hi")).alias("hi"))


def normalised(vectors: DataFrame) -> DataFrame:
    """vectors with embedding at length 1 in double; a zero vector or a number that is not finite raises."""
    n = norm(F.col("embedding"))
    bad = F.assert_true((n > 0) & ~F.isnan(n) & (n < float("inf")), F.lit("a vector is zero or not finite"))
    return vectors.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") / F.coalesce(bad.cast("double"), n)))
