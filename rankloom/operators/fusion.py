"""Ranking, score normalisation and fusion. All windows are by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_query() -> WindowSpec:
    return W.partitionBy("qid")


# Fixed values of a source that does not list a candidate: present, reciprocal rank, rank/50, z, gap.
MISSING = (0.0, 0.0, 1.2, -3.0, 4.0)


def ranked(rows: DataFrame, score: str = "score", by: str = "doc_id", partition: tuple[str, ...] = ("qid",), name: str = "rank") -> DataFrame:
    """Rank by score descending; ties by the column by ascending (document id, or position for a stable order)."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(F.desc(score), by)).cast("long"))


def z(x: Column, over: WindowSpec | None = None, eps: float = 1e-8) -> Column:
    """Population z-score; a deviation below eps counts as 1."""
    over = over or by_query()
    s = F.stddev_pop(x).over(over)
    return (x - F.avg(x).over(over)) / F.when(s < eps, 1.0).otherwise(s)


def gap_to_top(x: Column, over: WindowSpec | None = None, eps: float = 1e-8) -> Column:
    over = over or by_query()
    s = F.stddev_pop(x).over(over)
    return (F.max(x).over(over) - x) / F.when(s < eps, 1.0).otherwise(s)


def rrf(lists: DataFrame, k: int = 60, top: int | None = 100) -> DataFrame:
    """Reciprocal-rank fusion of (source, qid, doc_id, rank)."""
    rows = lists.groupBy("qid", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf"))
    rows = ranked(rows, "rrf")
    return rows if top is None else rows.where(F.col("rank") <= top)


def candidate_features(lists: DataFrame, sources: list[str], depth: int = 50) -> DataFrame:
    """Five columns per source and nine over all, for the union of the sources' first depth documents.

    z and gap are taken over each source's whole list before it is cut. One aggregate by (qid, doc_id) pivots the
    sources; the constants of absent sources are put in after it, so aggregates never see them.
    """
    own = W.partitionBy("source", "qid")
    rows = lists.withColumn("z", z(F.col("score"), own)).withColumn("gap", gap_to_top(F.col("score"), own)).where(F.col("rank") <= depth)
    r = F.col("rank")
    agg = [F.count("*").cast("double").alias("source_count"), F.max(1 / (10.0 + r)).alias("best_rr10"), F.sum(1 / (10.0 + r)).alias("_rr"), F.sum(1 / (60.0 + r)).alias("rrf60"), F.min(r / 50).alias("min_rank"), F.avg(r / 50).alias("mean_rank")]
    agg += [F.sum((r <= n).cast("double")).alias(f"count_top{n}") for n in (5, 10, 20)]
    for s in sources:
        here = F.col("source") == s
        for name, value in (("present", F.lit(1.0)), ("rr10", 1 / (10.0 + r)), ("rank", r / 50), ("z", F.col("z")), ("gap", F.col("gap"))):
            agg.append(F.max(F.when(here, value)).alias(f"{s}_{name}"))
    out = rows.groupBy("qid", "doc_id").agg(*agg).withColumn("mean_rr10", F.col("_rr") / len(sources)).drop("_rr")
    for s in sources:
        for name, value in zip(("present", "rr10", "rank", "z", "gap"), MISSING, strict=True):
            out = out.withColumn(f"{s}_{name}", F.coalesce(f"{s}_{name}", F.lit(value)))
    return out


def blend_grid(scores: DataFrame, weights: list[float]) -> DataFrame:
    """scores (qid, doc_id, a, b): weight*z(a) + (1-weight)*z(b) for each weight, ranked."""
    rows = scores.withColumn("za", z(F.col("a"))).withColumn("zb", z(F.col("b")))
    grid = rows.sparkSession.createDataFrame([(w,) for w in weights], "w double")
    rows = rows.crossJoin(F.broadcast(grid)).withColumn("score", F.round(F.col("w") * F.col("za") + (1 - F.col("w")) * F.col("zb"), 9))
    return ranked(rows, partition=("w", "qid"))


def orthogonal(r: Column, b: Column, over: WindowSpec | None = None, eps: float = 1e-8) -> Column:
    """r without its part along b, per query."""
    over = over or by_query()
    bb = F.sum(b * b).over(over)
    return r - F.sum(r * b).over(over) / F.when(bb < eps, 1.0).otherwise(bb) * b


def anchored_merge(a: DataFrame, b: DataFrame, k: int, size: int = 5) -> DataFrame:
    """(qid, slot, doc_id): the first k of a, filled from b in its order without repeats."""
    rows = a.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(0).alias("p"), "rank").unionByName(b.select("qid", "doc_id", F.lit(1).alias("p"), "rank"))
    rows = rows.groupBy("qid", "doc_id").agg(F.min(F.struct("p", "rank")).alias("o"))
    return rows.withColumn("slot", F.row_number().over(by_query().orderBy("o", "doc_id")).cast("long")).where(F.col("slot") <= size).select("qid", "slot", "doc_id")


def top_sets(rows: DataFrame, k: int = 5, name: str = "top") -> DataFrame:
    """(qid, array of the first k doc_ids in rank order)."""
    return rows.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))


#: Weight of a where a configuration's condition does not hold.
BASE_WEIGHT = 0.75


def config_grid() -> list[tuple[str, float, int, float, float]]:
    """(kind, w, k, hi, at) of 110 configurations: blends of z, Borda and reciprocal ranks by weight, and three that raise
    the weight to hi where the top fives share at most at documents, or where the gap at the boundary of the blend or
    the spread of a's ranks 5 to 8 lies below the at quantile of all queries."""
    broad = [i / 100 for i in range(55, 100, 5)]
    out = [("z", i / 1000, 0, 0.0, 0.0) for i in range(650, 901, 25)] + [("borda", w, 0, 0.0, 0.0) for w in broad]
    out += [("rrf", w, k, 0.0, 0.0) for k in (0, 2, 5, 10, 20, 60) for w in broad]
    raised = [(h, x) for h in (0.8, 0.85, 0.9, 0.95) for x in (0, 1, 2)]
    out += [("agree", BASE_WEIGHT, 0, h, float(x + 2)) for h, x in raised]
    return out + [(kind, BASE_WEIGHT, 0, h, (0.2, 0.35, 0.5)[x]) for kind in ("boundary", "plateau") for h, x in raised]


def tournament(scores: DataFrame, configs: list[tuple] | None = None, k: int = 5) -> DataFrame:
    """scores (qid, doc_id, a, b): each configuration's first k documents, (kind, w, k, hi, at, qid, doc_id, rank).

    Per-query conditions come from one aggregate over each short list and their quantiles from one row, so the grid
    multiplies rows only for the ranking itself."""
    grid = scores.sparkSession.createDataFrame(config_grid() if configs is None else configs, "kind string, w double, k int, hi double, at double")
    x = scores.withColumn("za", z(F.col("a"))).withColumn("zb", z(F.col("b")))
    x = ranked(ranked(x, "a", name="ra"), "b", name="rb")
    down = lambda c: F.sort_array(F.collect_list(F.round(c, 9)), asc=False)
    per = x.groupBy("qid").agg(F.sum(((F.col("ra") <= k) & (F.col("rb") <= k)).cast("long")).alias("shared"), down(BASE_WEIGHT * F.col("za") + (1 - BASE_WEIGHT) * F.col("zb")).alias("s"), down(F.col("za")).alias("p"), F.collect_list(F.struct("doc_id", "za", "zb", "ra", "rb")).alias("list"))
    per = per.select("qid", "shared", "list", F.round(F.get("s", F.lit(k - 1)) - F.get("s", F.lit(k)), 9).alias("gap"), F.round(F.get("p", F.lit(k - 1)) - F.get("p", F.lit(k + 2)), 9).alias("spread"))
    levels = sorted({c[4] for c in (config_grid() if configs is None else configs) if c[0] in ("boundary", "plateau")}) or [0.5]
    limit = per.agg(*(F.percentile(c, F.array(*map(F.lit, levels))).alias(f"{c}_at") for c in ("gap", "spread")))
    x = per.crossJoin(F.broadcast(limit)).crossJoin(F.broadcast(grid.withColumnRenamed("k", "c")))
    nth = F.array_position(F.array(*map(F.lit, levels)), F.col("at")).cast("int")
    low = lambda c: F.col(c) <= F.round(F.get(f"{c}_at", nth - 1), 9)
    raised = F.when(F.col("kind") == "agree", F.col("shared") <= F.col("at")).when(F.col("kind") == "boundary", low("gap")).when(F.col("kind") == "plateau", low("spread")).otherwise(F.lit(False))
    w = F.when(raised, F.col("hi")).otherwise(F.col("w"))
    score = lambda y: F.when(F.col("kind") == "borda", -(F.col("w") * y["ra"] + (1 - F.col("w")) * y["rb"])).when(F.col("kind") == "rrf", F.col("w") / (F.col("c") + y["ra"]) + (1 - F.col("w")) / (F.col("c") + y["rb"])).otherwise(w * y["za"] + (1 - w) * y["zb"])
    # A query's short list is ranked within one row per configuration, so the grid is neither shuffled nor sorted.
    best = F.slice(F.sort_array(F.transform("list", lambda y: F.struct((-F.round(score(y), 9)).alias("low"), y["doc_id"].alias("doc_id")))), 1, k)
    out = x.select("kind", "w", F.col("c").cast("long").alias("k"), "hi", "at", "qid", F.posexplode(best).alias("rank", "y"))
    return out.select("kind", "w", "k", "hi", "at", "qid", "y.doc_id", (F.col("rank") + 1).cast("long").alias("rank"))


def fill_up(first: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """first and base (qid, doc_id, rank): (qid, slot, doc_id): first, then what it lacks of base in base's order, size slots a
    query; slots still empty repeat the first document."""
    both = first.select("qid", "doc_id", F.struct(F.lit(0).alias("p"), "rank").alias("o")).unionByName(base.select("qid", "doc_id", F.struct(F.lit(1).alias("p"), "rank").alias("o")))
    one = both.groupBy("qid", "doc_id").agg(F.min("o").alias("o"))
    x = one.withColumn("slot", F.row_number().over(by_query().orderBy("o", "doc_id")).cast("long")).where(F.col("slot") <= size)
    head = x.groupBy("qid").agg(F.max("slot").alias("n"), F.min_by("doc_id", "slot").alias("doc_id")).where(F.col("n") < size)
    more = head.select("qid", F.explode(F.sequence(F.col("n") + 1, F.lit(size).cast("long"))).alias("slot"), "doc_id")
    return x.select("qid", "slot", "doc_id").unionByName(more)


def residual_grid(rows: DataFrame, signals: list[str], betas: list[float], boundary: tuple[int, int] = (4, 9)) -> DataFrame:
    """rows (qid, doc_id, pos, base and the signals, all z-scores): (signal, mode, beta, qid, doc_id, rank) of the first five by base +
    beta * x, where x is the signal, its part orthogonal to base, or that part at the positions of boundary alone. The grid
    is laid out within the row, and ranks are windows by configuration and query."""
    orth = {c: orthogonal(F.col(c), F.col("base")) for c in signals}
    wide = rows.select("qid", "doc_id", "pos", "base", *signals, *(orth[c].alias(f"_{c}") for c in signals))
    near = F.col("pos").between(*boundary).cast("int")
    part = lambda c, m, x: F.struct(F.lit(c).alias("signal"), F.lit(m).alias("mode"), x.alias("x"))
    parts = [y for c in signals for y in (part(c, "raw", F.col(c)), part(c, "orth", F.col(f"_{c}")), part(c, "boundary", F.col(f"_{c}") * near))]
    x = wide.select("qid", "doc_id", "base", F.explode(F.array(*parts)).alias("p")).select("qid", "doc_id", "base", "p.*", F.explode(F.array(*map(F.lit, betas))).alias("beta"))
    x = x.withColumn("score", F.round(F.col("base") + F.col("beta") * F.col("x"), 9))
    return ranked(x, partition=("signal", "mode", "beta", "qid")).where(F.col("rank") <= 5).select("signal", "mode", "beta", "qid", "doc_id", "rank")
