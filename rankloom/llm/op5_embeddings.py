"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import spanning, whole_groups
from rankloom.operators.graph import connected_components
from rankloom.plans.session import cut

#: Trees, vectors of one label aimed at in a leaf, and half the width of the band that goes both ways: SPILL of a node's
#: spread, and REACH of the distance of vectors that just link at least.
TREES, LEAF, SPILL, REACH = 8, 256, 0.2533, 0.4
#: Rows of the sample the upper splits are fitted on, of which a fitted leaf holds FITTED at least; vectors that one
#: group of leaves holds and one task compares; and rows of one block of products.
SAMPLE, FITTED, GROUP, BLOCK = 16_384, 32, 16_384, 1024
LEAST = 0.93


@dataclass
class Tree:
    """A node splits at a random direction; a vector between low and high goes to both children, so that pairs close
    to a split stay together in one of them. The split is where the band holds few, so that it goes round a dense
    group; and a node so dense that most of its pairs link splits no more: all go left. The upper levels are fitted on a
    bounded sample. Below them, any number of levels follow: each splits at a direction of its own through the fitted
    leaf's centre, with a band of the same width. So depth follows the input, and what is known of a tree stays bounded."""

    number: int
    dims: int
    apart: float  # distance of unit vectors that just link
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    _made: dict = field(default_factory=dict, repr=False)

    @property
    def depth(self) -> int:
        return int(len(self.low) + 1).bit_length() - 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def direction(self, level: int) -> np.ndarray:
        """Directions of a fitted level's nodes, or the one of a level below."""
        if level not in self._made:
            shape = (1 << level, self.dims) if level < self.depth else (self.dims,)
            self._made[level] = np.random.default_rng([5, self.number, level]).standard_normal(shape).astype(np.float32)
        return self._made[level]

    def paths(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, path) of every node at depth that a row of x reaches; a path's bits are the turns from the root."""
        row, path = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(depth):
            w = self.direction(level)
            if level < self.depth:
                at, node = np.einsum("ij,ij->i", x[row], w[path]), (1 << level) - 1 + path
                left, right = at <= self.high[node], at >= self.low[node]
            else:
                leaf = path >> (level - self.depth)
                at, half = (x @ w)[row] - (self.centre @ w)[leaf], np.maximum(REACH * self.apart, SPILL * self.spread)[leaf]
                dense = (self.spread <= self.apart / math.sqrt(2))[leaf]
                left, right = dense | (at <= half), ~dense & (at >= -half)
            row, path = np.r_[row[left], row[right]], np.r_[2 * path[left], 2 * path[right] + 1]
        return row, path


_SPLITS = np.linspace(0.3, 0.7, 9)


def _spread(x: np.ndarray) -> float:
    return float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())) if len(x) else 0.0


def fit_tree(number: int, sample: np.ndarray, depth: int, least: float) -> Tree:
    """The tree's fitted levels; sample has unit rows."""
    nodes, dims, apart = (1 << depth) - 1, sample.shape[1], math.sqrt(max(0.0, 2 - 2 * least))
    tree = Tree(number, dims, apart, np.full(nodes, np.inf), np.full(nodes, np.inf), np.zeros((1 << depth, dims), np.float32), np.zeros(1 << depth))
    members = [np.arange(len(sample))]
    for level in range(depth):
        below = []
        for k, ix in enumerate(members):
            at, node, spread = sample[ix] @ tree.direction(level)[k], (1 << level) - 1 + k, _spread(sample[ix])
            if spread > apart / math.sqrt(2):
                half, own = max(REACH * apart, SPILL * spread), np.sort(at)
                split = np.quantile(own, _SPLITS)
                both = (np.searchsorted(own, split + half, "right") - np.searchsorted(own, split - half)) / len(own)
                c = split[np.argmin(both + np.abs(_SPLITS - 0.5) / 3)]
                tree.low[node], tree.high[node] = c - half, c + half
            below += [ix[at <= tree.high[node]], ix[at >= tree.low[node]]]
        members = below
    for k, ix in enumerate(members):
        if len(ix):
            tree.centre[k], tree.spread[k] = sample[ix].mean(axis=0), _spread(sample[ix])
    return tree


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first, so that no norm over- or underflows."""
    v = v / np.maximum(np.abs(v).max(axis=1, initial=0), np.finfo(np.float64).tiny)[:, None]
    return v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None]


def _units(e: pd.Series) -> np.ndarray:
    """Unit rows of equally long vectors."""
    return unit(np.array(e.tolist(), np.float64).reshape(len(e), -1))


def _fitted(v: np.ndarray, dims: int) -> np.ndarray:
    """v with dims columns, as trees take them: short vectors padded by zeros, long ones by their first components."""
    return np.pad(v, ((0, 0), (0, max(0, dims - v.shape[1]))))[:, :dims].astype(np.float32)


def fit(classes: DataFrame, n: int, depth: int, trees: int, least: float, sample: int) -> list[Tree]:
    """One task a tree; the driver gets splits, centres and spreads, and no vector."""
    share = min(1.0, sample / n)
    picked = classes.where(F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40)))
    dims = int(picked.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).first().dims) if not picked.isEmpty() else 1

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        parts = [_fitted(_units(e), dims) for _, e in x.groupby("dims")["e"]]
        t = fit_tree(int(key[0]), np.vstack(parts), depth, least)
        return pd.DataFrame([(t.number, *(a.tobytes() for a in (t.low, t.high, t.centre, t.spread)))])

    every = picked.select("dims", "e", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    got = every.groupBy("tree").applyInPandas(run, "tree int, low binary, high binary, centre binary, spread binary").collect()
    got = got or [(t, b"", b"", bytes(4 * dims), bytes(8)) for t in range(trees)]
    apart = math.sqrt(max(0.0, 2 - 2 * least))
    return [Tree(t, dims, apart, np.frombuffer(lo), np.frombuffer(hi), np.frombuffer(c, np.float32).reshape(-1, dims), np.frombuffer(s)) for t, lo, hi, c, s in sorted(map(tuple, got))]


def place(batches: Iterator[pd.DataFrame], forest: list[Tree]) -> Iterator[pd.DataFrame]:
    """The groups of leaves that each row reaches: its node at depth top of every tree."""
    for x in batches:
        for (dims, top), g in x.groupby(["dims", "top"]):
            for s in range(0, len(g), 4096):
                y = g.iloc[s : s + 4096].reset_index(drop=True)
                v = _fitted(_units(y["e"]), forest[0].dims)
                for t in forest:
                    row, path = t.paths(v, int(top))
                    yield y.iloc[row].assign(tree=t.number, node=path).reset_index(drop=True)


def compare(batches: Iterator[pd.DataFrame], forest: list[Tree], least: float) -> Iterator[pd.DataFrame]:
    """Per group of leaves: how often each vector's links have their first common leaf here, first by tree and then by
    path, so that no link counts twice; and the root of its tree in a spanning forest of those links. Pairs stay in
    the block of products they are found in."""
    keys = ["label", "dims", "tree", "node", "i", "j"]
    for x in whole_groups(batches, keys, 4096):
        for (_, _, tree, node, i, j), g in x.groupby(keys, sort=False):
            if len(g) < 2:
                continue
            top, depth = int(g["top"].iloc[0]), int(g["depth"].iloc[0])
            v, n, cid = _units(g["e"]), g["mult"].to_numpy(), g["cid"].to_numpy()
            side = g["c"].to_numpy() == i if i != j else None
            w = _fitted(v, forest[0].dims)
            row, path = forest[tree].paths(w, depth)
            own = np.lexsort((row, path))
            own = own[path[own] >> (depth - top) == node]
            edges = np.flatnonzero(np.r_[True, np.diff(path[own]) != 0, True]) if len(own) else [0]
            reach = None
            add, root = np.zeros(len(g), np.int64), np.arange(len(g))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                members, leaf = row[own[lo:hi]], path[own[lo]]
                for s in range(0, len(members), BLOCK):
                    a = members[s : s + BLOCK]
                    for u in range(s, len(members), BLOCK):
                        b = members[u : u + BLOCK]
                        near = v[a] @ v[b].T >= least
                        if s == u:
                            near = np.triu(near, 1)
                        if side is not None:
                            near &= side[a][:, None] != side[b][None, :]
                        if not near.any():
                            continue
                        if reach is None:
                            reach = _reach(forest[: tree + 1], w, depth)
                        near &= ~_met(reach, a, b, near, tree, leaf)
                        add[a] += near @ n[b]
                        add[b] += near.T @ n[a]
                        p, q = np.nonzero(near)
                        root = spanning(len(g), np.r_[np.arange(len(g)), a[p]], np.r_[root, b[q]])
            on = np.flatnonzero(add)
            if len(on):
                yield pd.DataFrame({"cid": cid[on], "add": add[on], "root": cid[root[on]]})


def _reach(trees: list[Tree], w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each row, tree, path, number of each distinct leaf) of all leaves that the rows reach, by row."""
    found = [t.paths(w, depth) for t in trees]
    row = np.concatenate([r for r, _ in found])
    tree = np.repeat(np.arange(len(trees)), [len(r) for r, _ in found])
    path = np.concatenate([p for _, p in found])
    order = np.argsort(row, kind="stable")
    tree, path = tree[order], path[order]
    by = np.lexsort((path, tree))
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(np.r_[0, (np.diff(path[by]) != 0) | (np.diff(tree[by]) != 0)])
    return np.searchsorted(row[order], np.arange(len(w) + 1)), tree, path, number


def _met(reach: tuple, a: np.ndarray, b: np.ndarray, near: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Which pairs of a and b with a link share a leaf before this one."""
    start, trees, path, number = reach
    sides = []
    for rows, some in ((a, near.any(axis=1)), (b, near.any(axis=0))):
        rows, at = rows[some], np.flatnonzero(some)
        width = start[rows + 1] - start[rows]
        ix = np.repeat(start[rows] - np.cumsum(width) + width, width) + np.arange(width.sum())
        early = (trees[ix] < tree) | (path[ix] < leaf)
        sides.append((np.repeat(at, width)[early], number[ix][early]))
    both = np.intersect1d(sides[0][1], sides[1][1])
    held = []
    for (at, leaves), size in zip(sides, near.shape, strict=True):
        m = np.zeros((size, len(both)), np.float32)
        k = np.searchsorted(both, leaves)
        fits = (k < len(both)) & (both[np.minimum(k, len(both) - 1)] == leaves) if len(both) else np.zeros(len(k), bool)
        m[at[fits], k[fits]] = 1
        held.append(m)
    return held[0] @ held[1].T > 0


def _levels(n: F.Column, most: int) -> F.Column:
    """Levels after which a node holds about most of n vectors; each leaves half and a tenth, the band's."""
    return F.greatest(F.lit(0), F.ceil(F.log(n / F.lit(float(most))) / -math.log(0.6))).cast("int")


def near_vectors(vectors: DataFrame, least: float = LEAST, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing. Equal vectors of one label are one class that is compared once and counts as often as it occurs, so
    copies are never paired. Every class is in at least one leaf of every tree; a label's depth follows its number of
    classes. A vector is sent once to each group of leaves it reaches, a subtree that one task holds, and meets
    its leaves there; a group of over group classes is compared in blocks of two chunks. Vectors of different
    lengths never link. Repeated vec_ids are rows of their own; ties can't occur, as links have no order. Other
    columns of vectors are not read. An empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)["embedding"]
    e = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(F.coalesce(fine, F.lit(False)), e).alias("e"))
    good = rows.where(F.col("e").isNotNull()).groupBy("label", "e").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    classes = cut(good.withColumn("cid", F.monotonically_increasing_id()).withColumn("dims", F.size("e")))
    alone = rows.where(F.col("e").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    per = classes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    per = per.select("label", "dims", "n", _levels(F.col("n"), leaf).alias("depth"), _levels(F.col("n"), group).alias("top"))
    size = per.agg(F.sum("n").alias("n"), F.max("depth").alias("depth")).first()
    if not size.n:
        return alone.withColumn("kept", F.lit(True))
    forest = fit(classes, size.n, min(size.depth, int(math.log2(max(1, min(size.n, sample) / FITTED)))), trees, least, sample)
    known = classes.sparkSession.sparkContext.broadcast(forest)

    many = classes.join(per.where("n > 1").drop("n"), ["label", "dims"]).select("label", "dims", "depth", "top", "cid", "mult", "e")
    fields = f"label long, dims int, depth int, top int, cid long, mult long, e {'array<float>' if kind == 'array<float>' else 'array<double>'}, tree int, node long"
    placed = many.mapInPandas(lambda it: place(it, known.value), fields)
    full = placed.groupBy("label", "dims", "tree", "node").agg(F.count("*").alias("n"))
    full = full.where("n > 1").select("label", "dims", "tree", "node", F.ceil(F.col("n") / group).cast("int").alias("k"))
    blocks = placed.join(full, ["label", "dims", "tree", "node"]).withColumn("c", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = blocks.withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).drop("o", "k")
    key = ["label", "dims", "tree", "node", "i", "j"]
    links = cut(blocks.repartition(*key).sortWithinPartitions(*key).mapInPandas(lambda it: compare(it, known.value, least), "cid long, add long, root long"))
    degree = links.groupBy("cid").agg(F.sum("add").alias("add"))
    nodes = connected_components(links.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "cid", "component": "top"})
    classes = classes.join(degree, "cid", "left").join(nodes, "cid", "left").withColumn("top", F.coalesce("top", "cid"))
    tops = classes.groupBy("top").agg(F.min("least").alias("component_id"))
    classes = classes.join(tops, "top").select("label", "e", (F.col("mult") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where(F.col("e").isNotNull()).join(classes, ["label", "e"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
