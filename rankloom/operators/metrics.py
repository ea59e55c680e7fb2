"""Evaluation of ranked lists against gold pairs (qid, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 5, 10, 20, 50)


def per_query(ranks: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(qid, n_gold, hits, returned, recall, precision) of each query that has gold; without an answer, or with over
    five, both measures are 0. A document returned twice hits once and counts twice."""
    g = gold.distinct().withColumn("gold", F.lit(1))
    size = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    ans = ranks.where(F.col("rank") <= k).join(g, ["qid", "doc_id"], "left")
    got = ans.groupBy("qid").agg(F.count("*").alias("returned"), F.count_distinct(F.when(F.col("gold") == 1, F.col("doc_id"))).alias("hits"))
    rows = size.join(got, "qid", "left").fillna(0, ["returned", "hits"])
    fine = F.col("returned").between(1, 5) if k <= 5 else F.col("returned") > 0
    return rows.withColumn("recall", F.when(fine, F.col("hits") / F.col("n_gold")).otherwise(0.0)).withColumn("precision", F.when(fine, F.col("hits") / F.col("returned")).otherwise(0.0))


def macro(per: DataFrame) -> DataFrame:
    """One row: means, F2 of the macro means, recall of single- and multi-gold queries, mean answers."""
    m = per.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg(F.when(F.col("n_gold") == 1, F.col("recall"))).alias("single"), F.avg(F.when(F.col("n_gold") > 1, F.col("recall"))).alias("multi"), F.avg("returned").alias("mean_returned"))
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f2", F.when(4 * p + r > 0, 5 * p * r / (4 * p + r)).otherwise(0.0))


def curve(ranks: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, macro_recall, full_coverage, micro_recall): one join, then one aggregate for all k."""
    g = gold.distinct().join(ranks.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    per = g.groupBy("qid").agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    cells = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("h")) for k in ks))).alias("x")
    rows = per.select("n", cells).select("n", "x.k", "x.h")
    return rows.groupBy("k").agg(F.avg(F.col("h") / F.col("n")).alias("macro_recall"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("full_coverage"), (F.sum("h") / F.sum("n")).alias("micro_recall"))


def union_oracle(lists: DataFrame, gold: DataFrame, subsets: list[list[str]], k: int, cap: int | None = None) -> DataFrame:
    """(subset, recall, full, pool): what the union of the sources' first k could reach, for each subset. A subset is
    a bit mask over the sources, and a candidate's sources are one mask, so all subsets share one aggregate. cap: the
    answers that may be given at most."""
    names = sorted({s for x in subsets for s in x})
    bit = F
    for i, s in enumerate(names):
        bit = bit.when(F.col("source") == s, F.lit(1 << i))
    mask = lists.where(F.col("rank") <= k).groupBy("qid", "doc_id").agg(F.bit_or(bit.otherwise(F.lit(0))).alias("m"))
    wanted = lists.sparkSession.createDataFrame([("+".join(x), sum(1 << names.index(s) for s in x)) for x in subsets], "subset string, sm int")
    g = gold.distinct()
    rows = mask.join(g.withColumn("gold", F.lit(1)), ["qid", "doc_id"], "left").crossJoin(F.broadcast(wanted)).where(F.col("m").bitwiseAND(F.col("sm")) > 0)
    per = rows.groupBy("subset", "qid").agg(F.count("*").alias("pool"), F.count_if(F.expr("gold = 1")).alias("h"))
    size = g.groupBy("qid").agg(F.count("*").alias("n")).crossJoin(F.broadcast(wanted.select("subset")))
    per = size.join(per, ["subset", "qid"], "left").fillna(0, ["pool", "h"])
    per = per if cap is None else per.withColumn("h", F.least("h", F.lit(cap)))
    return per.groupBy("subset").agg(F.avg(F.col("h") / F.col("n")).alias("recall"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("full"), F.avg("pool").alias("pool"))


def query_auc(rows: DataFrame) -> DataFrame:
    """(qid, auc) by rank sums: ties count half; queries with one class only are left out. No pairs are made."""
    from pyspark.sql import Window as W

    w = W.partitionBy("qid").orderBy("score")
    r = rows.withColumn("r", F.rank().over(w) + (F.count("*").over(W.partitionBy("qid", "score")) - 1) / 2)
    g = r.groupBy("qid").agg(F.sum("label").alias("p"), F.count("*").alias("n"), F.sum(F.col("r") * F.col("label")).alias("s")).where("p > 0 and p < n")
    return g.select("qid", ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def paired_gain(a: DataFrame, b: DataFrame, promote: float = 0.0) -> DataFrame:
    """One row: mean difference b - a of recall, wins, losses, ties and a decision."""
    d = a.select("qid", F.col("recall").alias("ra")).join(b.select("qid", F.col("recall").alias("rb")), "qid").withColumn("d", F.col("rb") - F.col("ra"))
    out = d.agg(F.avg("d").alias("delta"), F.count_if(F.expr("d > 0")).alias("wins"), F.count_if(F.expr("d < 0")).alias("losses"), F.count_if(F.expr("d = 0")).alias("ties"))
    return out.withColumn("decision", F.when((F.col("delta") > promote) & (F.col("wins") > F.col("losses")), "PROMOTE").otherwise("KILL"))


def marginal(lists: DataFrame, gold: DataFrame, base: list[str], challenger: str, depth: int) -> DataFrame:
    """One row: recall of the base sources' first depth, with the challenger's, the difference, and the queries, wholly
    covered queries and gold documents that the challenger rescues."""
    near = lists.where((F.col("rank") <= depth) & F.col("source").isin(*base, challenger))
    found = near.groupBy("qid", "doc_id").agg(F.max(F.col("source").isin(*base).cast("int")).alias("b"))
    per = gold.distinct().join(found, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("hb"), F.count("b").alias("he"))
    r = per.agg(F.avg(F.col("hb") / F.col("n")).alias("base_recall"), F.avg(F.col("he") / F.col("n")).alias("expanded_recall"), F.count_if(F.col("he") > F.col("hb")).alias("query_rescues"), F.count_if((F.col("hb") < F.col("n")) & (F.col("he") == F.col("n"))).alias("full_rescues"), F.sum(F.col("he") - F.col("hb")).alias("gold_rescues"))
    return r.select("base_recall", "expanded_recall", (F.col("expanded_recall") - F.col("base_recall")).alias("delta"), "query_rescues", "full_rescues", "gold_rescues")


def complementarity(lists: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """For each pair of sources: recall and full coverage of their union, queries and gold documents that only one of
    them has, and the mean Jaccard of their first depth. A candidate's sources are one set, so no list meets another."""
    g = gold.distinct().withColumn("gold", F.lit(1))
    names = sorted(r.source for r in lists.select("source").distinct().collect())  # sources are few
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]))).alias("x")
    held = lists.where(F.col("rank") <= depth).groupBy("qid", "doc_id").agg(F.collect_set("source").alias("s")).join(g, ["qid", "doc_id"], "left")
    rows = held.select("qid", "s", F.col("gold").isNotNull().alias("gold"), pairs).select("qid", "gold", "x.a", "x.b", F.array_contains("s", F.col("x.a")).alias("ia"), F.array_contains("s", F.col("x.b")).alias("ib"))
    ia, ib, hit = F.col("ia"), F.col("ib"), F.col("gold")
    per = rows.groupBy("a", "b", "qid").agg((F.count_if(ia & ib) / F.count_if(ia | ib)).alias("j"), F.count_if(hit & ia & ~ib).alias("ga"), F.count_if(hit & ib & ~ia).alias("gb"), F.count_if(hit & (ia | ib)).alias("gu"))
    per = per.join(g.groupBy("qid").agg(F.count("*").alias("n")), "qid")
    return per.groupBy("a", "b").agg(F.avg(F.col("gu") / F.col("n")).alias("union_recall"), F.avg((F.col("gu") == F.col("n")).cast("int")).alias("union_full"), F.count_if(F.col("ga") > 0).alias("a_rescues"), F.count_if(F.col("gb") > 0).alias("b_rescues"), F.sum("ga").alias("a_unique_gold"), F.sum("gb").alias("b_unique_gold"), F.avg("j").alias("jaccard"))


def arm_wins(per: DataFrame, order: list[str]) -> DataFrame:
    """per (arm, qid, recall): (arm, wins): how often an arm is the best of a query; of equals the first in order."""
    at = F
    for i, a in enumerate(order):
        at = at.when(F.col("arm") == a, F.lit(i))
    best = per.groupBy("qid").agg(F.max_by("arm", F.struct("recall", -at.otherwise(F.lit(len(order))))).alias("arm"))
    return best.groupBy("arm").agg(F.count("*").alias("wins"))


def summary(rows: DataFrame) -> DataFrame:
    """rows (feature, value), one a fold: (feature, mean, std, low, high, place), place by the mean's size."""
    x = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return x.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round(F.abs("mean"), 9)), "feature")).cast("long"))  # one row a feature


def paired_folds(a: DataFrame, b: DataFrame, fold: Column, need: int = 3) -> DataFrame:
    """(fold, delta, wins, losses) of b against a per fold, and a row of fold -1 over all; decision there: PROMOTE if the mean
    gains, wins outnumber losses and at least need folds gain."""
    x = a.select("qid", F.col("recall").alias("ra")).join(b.select("qid", F.col("recall").alias("rb")), "qid").select(fold.alias("fold"), F.round(F.col("rb") - F.col("ra"), 12).alias("v"))
    agg = [F.avg("v").alias("delta"), F.count_if(F.col("v") > 0).alias("wins"), F.count_if(F.col("v") < 0).alias("losses")]
    per = x.groupBy("fold").agg(*agg)
    gains = per.agg(F.count_if(F.col("delta") > 0).alias("gains"))
    total = x.agg(*agg).crossJoin(F.broadcast(gains))  # one row each
    good = (F.col("delta") > 0) & (F.col("wins") > F.col("losses")) & (F.col("gains") >= need)
    total = total.select(F.lit(-1).cast("long").alias("fold"), "delta", "wins", "losses", F.when(good, "PROMOTE").otherwise("KILL").alias("decision"))
    return per.select(F.col("fold").cast("long").alias("fold"), "delta", "wins", "losses", F.lit(None).cast("string").alias("decision")).unionByName(total)


def slice_grid(per: DataFrame, members: DataFrame) -> DataFrame:
    """per (qid, fold, recall), members (slice, qid): (slice, queries, recall) overall, per fold and per slice; slices may
    overlap. A query's memberships are a short list beside it, so one aggregate gives all rows."""
    own = members.groupBy("qid").agg(F.collect_set("slice").alias("s"))
    every = F.concat(F.array(F.lit("all"), F.concat(F.lit("fold_"), F.col("fold").cast("string"))), F.coalesce("s", F.array().cast("array<string>")))
    x = per.join(own, "qid", "left").select("recall", F.explode(every).alias("slice"))
    return x.groupBy("slice").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"))
