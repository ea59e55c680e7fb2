"""Feature tables and label signals beyond plain fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.fusion import by_query, gap_to_top, ranked, z


def rerank_features(shortlist: DataFrame) -> DataFrame:
    """shortlist (qid, doc_id, pos, ce): reciprocal and normalised position, raw, z, gap and reciprocal rank of ce."""
    rows = ranked(shortlist, "ce", "doc_id", name="ce_rank")
    return rows.select("qid", "doc_id", "pos", (1 / (10.0 + F.col("pos"))).alias("selector_rr10"), (F.col("pos") / 30).alias("selector_rank"), F.col("ce").alias("ce_raw"), z(F.col("ce")).alias("ce_z"), gap_to_top(F.col("ce")).alias("ce_gap_z"), (1 / (10.0 + F.col("ce_rank"))).alias("ce_rr10"))


def gap_features(ranks: DataFrame) -> DataFrame:
    """(qid, s1_s5, s4_s5, s5_s6, s5_s7, s5_s10, std_1_5, std_6_10) of the ranked scores."""
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    std = lambda a, b: F.stddev_pop(F.when(F.col("rank").between(a, b), F.col("score")))
    pairs = ((1, 5), (4, 5), (5, 6), (5, 7), (5, 10))
    return ranks.groupBy("qid").agg(*((at(a) - at(b)).alias(f"s{a}_s{b}") for a, b in pairs), std(1, 5).alias("std_1_5"), std(6, 10).alias("std_6_10"))


def title_features(pairs: DataFrame, titles: DataFrame, short: int = 30) -> DataFrame:
    """pairs (qid, doc_id, pos, t, nums, years, kinds) and titles (doc_id, t, nums, years, kinds), t the tokens in order and the
    others sets: twelve features. idf = ln((N+1)/(df+1)) + 1 over titles, 1 for a token of none; the z of the idf ratio and its
    rank, ties by position, are within the query. Token counts come from one aggregate over titles."""
    n = titles.count()
    df = titles.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    whole = pairs.select("qid", F.explode(F.array_distinct("t")).alias("term")).distinct().join(df, "term", "left").groupBy("qid").agg(F.sum(F.coalesce("idf", F.lit(1.0))).alias("idf_q"))
    y = titles.select("doc_id", F.struct("t", "nums", "years", "kinds").alias("d"))
    both = pairs.join(y, "doc_id").select("*", F.array_distinct("t").alias("q"), F.array_distinct("d.t").alias("w"))
    both = both.withColumn("x", F.array_intersect("q", "w"))
    idf = both.select("qid", "doc_id", F.explode("x").alias("term")).join(df, "term").groupBy("qid", "doc_id").agg(F.sum("idf").alias("idf_overlap"))
    two = lambda t: F.array_distinct(F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    share = lambda a, b: F.size(a) / F.greatest(b, F.lit(1))
    same = lambda c: F.size(F.array_intersect(F.col(c), F.col(f"d.{c}"))).cast("long")
    rows = both.select("qid", "doc_id", "pos", F.size("x").cast("long").alias("overlap"), share("x", F.size("q")).alias("query_coverage"), share("x", F.size("w")).alias("title_coverage"), share("x", F.size(F.array_union("q", "w"))).alias("jaccard"), same("nums").alias("numbers"), same("years").alias("years"), (same("kinds") > 0).alias("instrument"), share(F.array_intersect(two("t"), two(F.col("d.t"))), F.size(two("t"))).alias("bigram_coverage"))
    rows = rows.join(idf, ["qid", "doc_id"], "left").join(whole, "qid", "left").fillna(0.0, ["idf_overlap"])
    rows = rows.withColumn("idf_ratio", F.col("idf_overlap") / F.coalesce("idf_q", F.lit(1.0)))
    rows = positional_rank(rows.withColumn("_o", F.round("idf_ratio", 9)), "_o", "_r")
    return rows.select("qid", "doc_id", "overlap", "idf_overlap", "idf_ratio", "query_coverage", "title_coverage", "jaccard", "numbers", "years", "instrument", "bigram_coverage", z(F.col("idf_ratio")).alias("idf_z"), (F.col("_r") / F.lit(float(short))).alias("title_rank"))


def colabel_graph(items: DataFrame, most: int = 10_000, rows: int = 400_000) -> DataFrame:
    """items (basket, item): for pairs a < b that share a basket, support, P(b|a), Jaccard and PMI. Every pair of a basket is an
    edge of the result, so one of over most different items raises instead of growing with its square; an item's
    frequency comes from one aggregate, and equal pairs are counted before they are shuffled. Baskets are dealt once, about
    rows rows a task and pairs alike, whatever their number, and pairs are made within the basket."""
    m = F.col("m")
    size = items.groupBy("basket").agg(F.count("*").alias("m")).where("basket is not null")
    size = size.agg(F.count("*").alias("n"), F.sum("m").alias("rows"), F.sum(m * (m - 1) / 2).alias("pairs"), F.max("m").alias("most")).first()
    if (size.most or 0) > most:  # repeats count above, so look closer
        wide = items.where("basket is not null").distinct().groupBy("basket").agg(F.count("*").alias("m")).agg(F.max("m").alias("most")).first()
        if wide.most > most:
            raise ValueError(f"a basket holds {wide.most} items, over {most}")
    cores = items.sparkSession.sparkContext.defaultParallelism
    dealt, counted = (max(cores, int(-(-(x or 0) // rows))) for x in (size.rows, size.pairs))
    # What is dealt by a part of the baskets is also grouped by it, so pairs are counted where they are made.
    part = F.pmod(F.xxhash64("basket"), F.lit(64 * dealt)).alias("part")
    held = items.where("basket is not null and item is not null").select(part, "basket", "item").repartition(dealt, "part")
    held = held.groupBy("part", "basket").agg(F.sort_array(F.collect_set("item")).alias("s"))
    freq = held.select(F.explode("s").alias("item")).groupBy("item").agg(F.count("*").alias("f")).hint("merge")
    pairs = held.select("part", "s", F.posexplode("s").alias("i", "a")).select("part", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    pairs = pairs.groupBy("part", "a", "b").agg(F.count("*").alias("c")).repartition(counted, "a", "b").groupBy("a", "b").agg(F.sum("c").alias("support"))
    found = pairs.join(freq.toDF("a", "fa"), "a").join(freq.toDF("b", "fb"), "b")
    return found.select("a", "b", "support", (F.col("support") / F.col("fa")).alias("cond"), (F.col("support") / (F.col("fa") + F.col("fb") - F.col("support"))).alias("jaccard"), F.log(F.col("support") * F.lit(float(size.n)) / (F.col("fa") * F.col("fb"))).alias("pmi"))


def colabel_best(graph: DataFrame, anchors: DataFrame, min_support: int = 2, mode: str = "hybrid") -> DataFrame:
    """(key, best, score): for anchors (key, item, i) the neighbour of best score, weight 1/(1+i/4) per anchor. mode: cond, jaccard
    or hybrid = sqrt(cond*jaccard) * log1p(support) * (1 + max(pmi, 0)/10)."""
    return colabel_bests(graph, anchors, min_support, (mode,)).drop("mode")


#: Values of one item nearer than this may give equal rounded scores, for anchors up to the ten thousandth.
NEAR = 3e-6


def colabel_bests(graph: DataFrame, anchors: DataFrame, min_support: int, modes: tuple[str, ...]) -> DataFrame:
    """(key, best, score, mode): colabel_best of several modes over one reading of the graph.

    A key of n items leaves out n - 1 neighbours of an item at most, so an item keeps only the neighbours that fewer than n
    others surely beat, n being its largest key; an anchor then finds its best within its row, and keys meet one row an
    anchor instead of all neighbours of all their items."""
    hybrid = F.sqrt(F.col("cond") * F.col("jaccard")) * F.log1p(F.col("support").cast("double")) * (1 + F.greatest(F.col("pmi"), F.lit(0.0)) / 10)
    low = [(-(hybrid if m == "hybrid" else F.col(m))).alias(f"low{j}") for j, m in enumerate(modes)]
    names = [f"low{j}" for j in range(len(modes))]
    edge = graph.where(F.col("support") >= min_support).select("a", "b", *low)
    ways = F.explode(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("to")), F.struct(F.col("b").alias("item"), F.col("a").alias("to")))).alias("x")
    edge = edge.select(ways, *names).select("x.item", "x.to", *names)

    held = anchors.groupBy("key").agg(F.collect_list(F.struct("item", "i")).alias("g"))
    own = F.when(F.col("key").isNull(), F.array().cast("array<bigint>")).otherwise(F.filter(F.transform("g", lambda x: x["item"].cast("bigint")), lambda x: x.isNotNull()))
    held = held.select("key", own.alias("own"), F.explode("g").alias("x")).select("key", "own", "x.item", "x.i")
    most = held.groupBy("item").agg(F.max(F.greatest(F.size("own"), F.lit(1))).alias("m"))

    edge = edge.join(most.hint("merge"), "item")
    for v in names:
        over = W.partitionBy("item").orderBy(v)
        twin = F.row_number().over(W.partitionBy("item").orderBy(v, "to")) - F.rank().over(over)
        beaten = F.expr(f"count(1) over (partition by item order by {v} range between unbounded preceding and {NEAR}D preceding)")
        edge = edge.withColumn(f"_{v}", (twin < F.col("m")) & (beaten < F.col("m")))
    edge = edge.where(" or ".join(f"_{v}" for v in names))
    tops = edge.groupBy("item").agg(F.collect_list(F.struct("to", *names)).alias("tops"))

    x = held.join(tops.hint("merge"), "item").select("key", "i", F.filter("tops", lambda t: ~F.array_contains("own", t["to"])).alias("tops"))
    best = lambda v: F.array_max(F.transform("tops", lambda t: F.struct(F.round(-t[v] / (1 + 0.25 * F.col("i")), 9).alias("score"), (-t["to"]).alias("b"))))
    x = x.select("key", *(best(v).alias(v) for v in names)).groupBy("key").agg(*(F.max(v).alias(v) for v in names))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(v).alias("x")) for m, v in zip(modes, names, strict=True)))).alias("y")
    return x.select("key", each).where("y.x is not null").select("key", (-F.col("y.x.b")).alias("best"), F.col("y.x.score").alias("score"), F.col("y.mode").alias("mode"))


def propensity(rows: DataFrame, source_folds: int = 4) -> DataFrame:
    """rows (item, fold, positive): (item, fold, log_freq, log_rate) from all folds but the row's own, counts scaled
    to four source folds. Leave-one-fold-out is total minus own, one window over item-fold counts."""
    per = rows.groupBy("item", "fold").agg(F.count("*").alias("e"), F.sum(F.col("positive").cast("long")).alias("g"))
    w = W.partitionBy("item")
    e, g = (F.sum("e").over(w) - F.col("e")) * (4.0 / source_folds), (F.sum("g").over(w) - F.col("g")) * (4.0 / source_folds)
    return per.select("item", "fold", F.log1p(g).alias("log_freq"), F.log((g + 0.5) / (e + 10)).alias("log_rate"))


def hard_negatives(ranks: DataFrame, gold: DataFrame, per: int = 3) -> DataFrame:
    """(qid, doc_id, reason): gold, and the strongest per negatives by rank."""
    g = gold.distinct().withColumn("gold", F.lit(1))
    rows = ranks.join(g, ["qid", "doc_id"], "left").withColumn("neg", F.col("gold").isNull())
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("qid", "neg").orderBy("rank")))
    return rows.where(~F.col("neg") | (F.col("nth") <= per)).select("qid", "doc_id", F.when(F.col("neg"), "negative").otherwise("gold").alias("reason"))


def mirrored_pairs(rows: DataFrame, most: int = 48) -> DataFrame:
    """rows (qid, doc_id, rank, score, positive): (qid, first, second, label, difference) of a query's first most pairs of a
    positive and a negative, in the order of their ranks, each both ways. A query's rows are a short list."""
    side = lambda p, n: rows.where(F.col("positive") == p).select("qid", F.col("doc_id").alias(f"{n}d"), F.col("rank").alias(f"{n}r"), F.col("score").alias(f"{n}s"))
    x = side(True, "p").join(side(False, "n"), "qid").withColumn("nth", F.row_number().over(W.partitionBy("qid").orderBy("pr", "nr"))).where(F.col("nth") <= most)
    x = x.select("qid", "pd", "nd", (F.col("ps") - F.col("ns")).alias("v"))
    way = lambda a, b, y, v: x.select("qid", F.col(a).alias("first"), F.col(b).alias("second"), F.lit(y).cast("int").alias("label"), v.alias("difference"))
    return way("pd", "nd", 1, F.col("v")).unionByName(way("nd", "pd", 0, -F.col("v")))


def slot_swaps(ranks: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """(qid, old, new, swapped, rescued): slot 5 gives way to slot 6 if it leads by less than threshold."""
    at = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c)))
    rows = ranks.join(gold.distinct().withColumn("gold", F.lit(1)), ["qid", "doc_id"], "left").fillna(0, ["gold"])
    rows = rows.groupBy("qid").agg(at("doc_id", 5).alias("old"), at("doc_id", 6).alias("next"), (at("score", 5) - at("score", 6)).alias("lead"), at("gold", 5).alias("g5"), at("gold", 6).alias("g6")).where("next is not null")
    swap = F.col("lead") < threshold
    return rows.select("qid", "old", F.when(swap, F.col("next")).otherwise(F.col("old")).alias("new"), swap.alias("swapped"), (swap & (F.col("g6") > F.col("g5"))).alias("rescued"))


def disagreement(lists: DataFrame, k: int = 5) -> DataFrame:
    """(qid, disagreement): one less the mean Jaccard of the sources' first k, over all source pairs."""
    tops = lists.where(F.col("rank") <= k).groupBy("qid", "source").agg(F.collect_set("doc_id").alias("s"))
    pairs = tops.toDF("qid", "sa", "a").join(tops.toDF("qid", "sb", "b"), "qid").where("sa < sb")
    return pairs.groupBy("qid").agg(F.round(1 - F.avg(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))), 6).alias("disagreement"))


def softmax_rrf(lists: DataFrame, utility: DataFrame, temperature: float = 12.0, k: int = 20, depth: int = 50) -> DataFrame:
    """Reciprocal ranks weighted by the softmax of the sources' utility (qid, source, u)."""
    e = F.exp(temperature * (F.col("u") - F.max("u").over(by_query())))
    w = utility.withColumn("e", e).withColumn("w", F.col("e") / F.sum("e").over(by_query())).select("qid", "source", "w")
    rows = lists.where(F.col("rank") <= depth).join(w, ["qid", "source"]).groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))
    return ranked(rows).where(F.col("rank") <= depth)


def boundary_stats(rows: DataFrame, values: list[str], base: str, cand: str, k: int = 5) -> DataFrame:
    """Per query the churn between two rankings, and mean, most and least of each value over the documents that enter
    and that leave the first k; 0 where none does. One aggregate."""
    moves = {"enter": (F.col(cand) <= k) & (F.col(base) > k), "leave": (F.col(base) <= k) & (F.col(cand) > k)}
    agg = [F.sum((moves["enter"] | moves["leave"]).cast("long")).alias("churn")]
    for move, on in moves.items():
        for v in values:
            x = F.when(on, F.col(v))
            agg += [F.coalesce(f(x), F.lit(0.0)).cast("double").alias(f"{move}_{v}_{name}") for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return rows.groupBy("qid").agg(*agg)


def agreement(lists: DataFrame, pairs: list[tuple[str, str]], k: int = 5) -> DataFrame:
    """Per query the Jaccard similarity of the first k documents of each pair of sources."""
    names = sorted({s for p in pairs for s in p})
    per = lists.where((F.col("rank") <= k) & F.col("source").isin(names)).groupBy("qid", "doc_id").agg(*(F.max((F.col("source") == s).cast("int")).alias(f"_{s}") for s in names))
    both = lambda a, b: F.sum(F.col(f"_{a}") * F.col(f"_{b}")) / F.greatest(F.sum(F.greatest(f"_{a}", f"_{b}")), F.lit(1))
    return per.groupBy("qid").agg(*(both(a, b).alias(f"{a}_{b}") for a, b in pairs))


def positional_rank(rows: DataFrame, score: str, name: str, position: str = "pos") -> DataFrame:
    """Rank by score descending where ties keep the candidates' positions."""
    return ranked(rows, score, position, name=name)


def semantic_features(rows: DataFrame, families: list[str], short: int = 30) -> DataFrame:
    """rows (qid, doc_id, pos, <f>_ce and <f>_sim per family): per family score, z, gap to the top and reciprocal rank, region
    similarity, its z and reciprocal rank; over the families max, min, mean, spread of the scores, how many have the
    document in their first five, and how far their ranks are apart. Seven columns a family and six more."""
    out = rows
    for f in families:
        out = positional_rank(positional_rank(out, f"{f}_ce", f"_{f}_r"), f"{f}_sim", f"_{f}_sr")
    per = []
    for f in families:
        ce, sim = F.col(f"{f}_ce"), F.col(f"{f}_sim")
        per += [ce.alias(f"{f}_raw"), z(ce).alias(f"{f}_z"), gap_to_top(ce).alias(f"{f}_gap"), (1 / (10.0 + F.col(f"_{f}_r"))).alias(f"{f}_rr10")]
        per += [sim.alias(f"{f}_sim"), z(sim).alias(f"{f}_sim_z"), (1 / (10.0 + F.col(f"_{f}_sr"))).alias(f"{f}_sim_rr10")]
    ce = [F.col(f"{f}_ce") for f in families]
    rank = [F.col(f"_{f}_r") for f in families]
    top5 = sum((r <= 5).cast("int") for r in rank)
    return out.select("qid", "doc_id", *per, F.greatest(*ce).alias("ce_max"), F.least(*ce).alias("ce_min"), (sum(ce[1:], ce[0]) / len(ce)).alias("ce_mean"), (F.greatest(*ce) - F.least(*ce)).alias("ce_absdiff"), top5.cast("double").alias("top5_support"), ((F.greatest(*rank) - F.least(*rank)) / F.lit(float(short))).alias("rank_diff"))


def local_z(rows: DataFrame, columns: list[str], eps: float = 1e-6) -> DataFrame:
    """Each column as its z-score within the query; the others as they are."""
    return rows.select(*(z(F.col(c), eps=eps).alias(c) if c in columns else F.col(c) for c in rows.columns))


# Score, z and rank of a document that a scorer has not seen.
UNSEEN = (-20.0, -4.0, 35.0)


def arm_diagnostics(arms: DataFrame, lists: DataFrame, shortlist: DataFrame, agree: int = 4) -> DataFrame:
    """arms (arm, qid, doc_id, rank), source lists (source, qid, doc_id, rank, score), shortlist (qid, doc_id, pos, ce): 18
    columns on the first five documents of each arm and query: how many sources back them in their first 5 (mean, least,
    most), 10 and 20, mean reciprocal rank, the scorer's mean and best score, mean z and rank, distinct documents,
    overlap with the shortlist's first 5 and 10, the arm's own gaps where it is a source, and the share backed by agree."""
    back = lambda k: F.count_if(F.col("rank") <= k)
    votes = lists.where(F.col("rank") <= 50).groupBy("qid", "doc_id").agg(back(5).alias("s5"), back(10).alias("s10"), back(20).alias("s20"), F.avg(1 / (10.0 + F.col("rank"))).alias("rr"))
    seen = ranked(shortlist, "ce", "doc_id", name="ce_rank").select("qid", "doc_id", "pos", "ce", z(F.col("ce")).alias("ce_z"), "ce_rank")
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    sd = F.when(F.stddev_pop("score") < 1e-8, 1.0).otherwise(F.stddev_pop("score"))
    own = lists.groupBy(F.col("source").alias("arm"), "qid").agg(((at(1) - at(5)) / sd).alias("gap_1_5"), ((at(5) - at(6)) / sd).alias("gap_5_6"), (F.stddev_pop(F.when(F.col("rank") <= 10, F.col("score"))) / sd).alias("std_10"), ((at(1) - F.avg("score")) / sd).alias("z_1"))
    rows = arms.where(F.col("rank") <= 5).select("arm", "qid", "doc_id").join(votes, ["qid", "doc_id"], "left").join(seen, ["qid", "doc_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    head = lambda k: (F.count_distinct(F.when(F.col("pos") <= k, F.col("doc_id"))) / 5.0).alias(f"overlap{k}")
    raw, lost_z, lost_rank = UNSEEN
    x = rows.groupBy("arm", "qid").agg(F.avg(zero("s5")).alias("support5_mean"), F.min(zero("s5")).cast("double").alias("support5_min"), F.max(zero("s5")).cast("double").alias("support5_max"), F.avg(zero("s10")).alias("support10_mean"), F.avg(zero("s20")).alias("support20_mean"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mean_rr"), F.avg(F.coalesce("ce", F.lit(raw))).alias("ce_mean"), F.max(F.coalesce("ce", F.lit(raw))).alias("ce_max"), F.avg(F.coalesce("ce_z", F.lit(lost_z))).alias("ce_z_mean"), (F.avg(F.coalesce("ce_rank", F.lit(lost_rank))) / 30).alias("ce_rank_mean"), F.count_distinct("doc_id").cast("double").alias("distinct_docs"), head(5), head(10), (F.count_if(zero("s10") >= agree) / 5.0).alias("agreed"))
    x = x.join(own, ["arm", "qid"], "left")
    return x.select(*x.columns[: -4], *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gap_1_5", "gap_5_6", "std_10", "z_1")))


def arm_overlaps(arms: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(qid, a, b, jaccard<k>): for every two arms a < b of a query the Jaccard similarity of their first k. A document's arms
    are one short set, so lists never meet each other."""
    held = arms.where(F.col("rank") <= max(ks)).groupBy("qid", "doc_id").agg(F.collect_list(F.struct("arm", "rank")).alias("s"))
    names = sorted(r.arm for r in arms.select("arm").distinct().collect())  # arms are few
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]))).alias("x")
    has = lambda c, k: F.exists("s", lambda y: (y["arm"] == F.col(c)) & (y["rank"] <= k))
    x = held.select("qid", "s", pairs).select("qid", "s", "x.a", "x.b")
    return x.groupBy("qid", "a", "b").agg(*((F.count_if(has("a", k) & has("b", k)) / F.greatest(F.count_if(has("a", k) | has("b", k)), F.lit(1))).alias(f"jaccard{k}") for k in ks))


def slot5_oracle(base: DataFrame, pool: DataFrame, gold: DataFrame) -> DataFrame:
    """base and pool (qid, doc_id, rank): (qid, old, new, changed): slot 5 as it is, and with the first gold document of the
    pool that is not in the first four slots, where there is one."""
    top4 = base.where(F.col("rank") <= 4).select("qid", "doc_id")
    pick = pool.join(top4, ["qid", "doc_id"], "left_anti").join(gold.distinct(), ["qid", "doc_id"], "left_semi")
    pick = pick.groupBy("qid").agg(F.min_by("doc_id", "rank").alias("pick"))
    x = base.where(F.col("rank") == 5).select("qid", F.col("doc_id").alias("old")).join(pick, "qid", "left")
    new = F.coalesce("pick", "old")
    return x.select("qid", "old", new.alias("new"), (new != F.col("old")).alias("changed"))


def challengers(base: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(qid, nth, doc_id): the first k documents of the pool that are not in the base's first five."""
    x = pool.join(base.where(F.col("rank") <= 5).select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    return x.withColumn("nth", F.row_number().over(W.partitionBy("qid").orderBy("rank")).cast("long")).where(F.col("nth") <= k).select("qid", "nth", "doc_id")


def training_negatives(rows: DataFrame, per: int = 3, cap: int = 6) -> DataFrame:
    """rows (qid, doc_id, ra, rb, gold): (qid, doc_id, reason) of all gold documents and, cap a query, the negatives that the
    base ranks best, that the teacher ranks best and on which they disagree most, per of each; a document has the
    first reason that takes it."""
    neg = rows.where(~F.col("gold"))
    w = W.partitionBy("qid")
    nth = lambda *o: F.row_number().over(w.orderBy(*o))
    x = neg.select("qid", "doc_id", nth("ra", "doc_id").alias("base"), nth("rb", "doc_id").alias("teacher"), nth(F.desc(F.abs(F.col("ra") - F.col("rb"))), "doc_id").alias("disagreement"))
    names = ("base", "teacher", "disagreement")
    first = F.coalesce(*(F.when(F.col(c) <= per, F.lit(i)) for i, c in enumerate(names)))
    x = x.withColumn("i", first).where("i is not null")
    x = x.withColumn("n", F.element_at(F.array(*names), F.col("i") + 1)).withColumn("nth", nth("i", "n")).where(F.col("nth") <= cap)
    return rows.where("gold").select("qid", "doc_id", F.lit("gold").alias("reason")).unionByName(x.select("qid", "doc_id", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("reason")))
