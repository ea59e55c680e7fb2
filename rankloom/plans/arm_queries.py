"""Named queries over several ranked lists: diagnostics, sweeps, oracles, slices and selection, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import features, fusion, metrics, select, vector
from rankloom.plans.session import cut, spread
from rankloom.plans.vector_queries import BASE, COMPONENTS, GRID, NEAR, SC, SOURCES, SUBSETS, Z, _grid, _near, _recall, _scores, components, d_vec, full, gold, lists, parents, q_vec, r6

ARMS = [*SOURCES, "fused"]
DEPTHS = (5, 10, 15, 20, 30, 40, 50)
BETAS = [round(k / 40, 3) for k in range(-12, 13) if k]


def _fold() -> Column:
    return F.floor(F.col("qid") / 20) % 5


def fused(all_: DataFrame, top: int | None = 100) -> DataFrame:
    return fusion.rrf(all_, top=top).select("qid", "doc_id", "rank", F.col("rrf").alias("score"))


def arms(all_: DataFrame) -> DataFrame:
    """The sources' lists and their fusion."""
    return all_.select(F.col("source").alias("arm"), "qid", "doc_id", "rank").unionByName(fused(all_).select(F.lit("fused").alias("arm"), "qid", "doc_id", "rank"))


RRF = """, rp AS (SELECT qid, doc_id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM lists GROUP BY ALL), rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM rp),
ar AS (SELECT source AS arm, qid, doc_id, rank FROM lists UNION ALL SELECT 'fused', qid, doc_id, rank FROM rr WHERE rank <= 100)
"""


def _shortlist(s, d):
    return _scores(s, d).select("qid", "doc_id", "pos", F.col("b").alias("ce"))


def arm_diagnostics(s, d):
    all_ = lists(s, d)
    return r6(features.arm_diagnostics(arms(all_), all_, _shortlist(s, d), agree=3))


def arm_overlaps(s, d):
    return r6(features.arm_overlaps(arms(lists(s, d))))


DIAGNOSTICS = BASE + RRF + SC + f""", vo AS (SELECT qid, doc_id, count(*) FILTER (rank <= 5) AS s5, count(*) FILTER (rank <= 10) AS s10, count(*) FILTER (rank <= 20) AS s20, avg(1 / (10.0::DOUBLE + rank)) AS rr FROM lists WHERE rank <= 50 GROUP BY ALL),
se AS (SELECT qid, doc_id, pos, b AS ce, {Z.format(x='b')} AS cz, row_number() OVER (PARTITION BY qid ORDER BY b DESC, doc_id) AS cr FROM sc WINDOW w AS (PARTITION BY qid)),
ow AS (SELECT source AS arm, qid, CASE WHEN stddev_pop(score) < 1e-8 THEN 1 ELSE stddev_pop(score) END AS sd, max(score) FILTER (rank = 1) AS a1, max(score) FILTER (rank = 5) AS a5, max(score) FILTER (rank = 6) AS a6, stddev_pop(score) FILTER (rank <= 10) AS t10, avg(score) AS m FROM lists GROUP BY ALL)
SELECT arm, qid, round(avg(coalesce(s5, 0)), 6) AS support5_mean, min(coalesce(s5, 0))::DOUBLE AS support5_min, max(coalesce(s5, 0))::DOUBLE AS support5_max, round(avg(coalesce(s10, 0)), 6) AS support10_mean, round(avg(coalesce(s20, 0)), 6) AS support20_mean, round(avg(coalesce(rr, 0)), 6) AS mean_rr,
 round(avg(coalesce(ce, -20)), 6) AS ce_mean, round(max(coalesce(ce, -20)), 6) AS ce_max, round(avg(coalesce(cz, -4)), 6) AS ce_z_mean, round(avg(coalesce(cr, 35)) / 30, 6) AS ce_rank_mean, count(DISTINCT doc_id)::DOUBLE AS distinct_docs, count(DISTINCT doc_id) FILTER (pos <= 5) / 5.0::DOUBLE AS overlap5, count(DISTINCT doc_id) FILTER (pos <= 10) / 5.0::DOUBLE AS overlap10,
 count(*) FILTER (s10 >= 3) / 5.0::DOUBLE AS agreed, round(coalesce(any_value((a1 - a5) / sd), 0), 6) AS gap_1_5, round(coalesce(any_value((a5 - a6) / sd), 0), 6) AS gap_5_6, round(coalesce(any_value(t10 / sd), 0), 6) AS std_10, round(coalesce(any_value((a1 - m) / sd), 0), 6) AS z_1
FROM ar LEFT JOIN vo USING (qid, doc_id) LEFT JOIN se USING (qid, doc_id) LEFT JOIN ow USING (arm, qid) WHERE ar.rank <= 5 GROUP BY arm, qid"""
OVERLAPS = BASE + RRF + ", pr AS (SELECT x.arm AS a, y.arm AS b FROM (SELECT DISTINCT arm FROM ar) x JOIN (SELECT DISTINCT arm FROM ar) y ON x.arm < y.arm) SELECT qid, a, b, " + ", ".join(f"round((SELECT count(*) FROM ar x JOIN ar y USING (qid, doc_id) WHERE x.arm = a AND y.arm = b AND x.rank <= {k} AND y.rank <= {k} AND x.qid = q.qid) / (2 * {k} - (SELECT count(*) FROM ar x JOIN ar y USING (qid, doc_id) WHERE x.arm = a AND y.arm = b AND x.rank <= {k} AND y.rank <= {k} AND x.qid = q.qid))::DOUBLE, 6) AS jaccard{k}" for k in (5, 10)) + " FROM q, pr"


def _families(s, d):
    """The first 30 of the full list with two scorers and two similarities."""
    all_ = lists(s, d)
    at = lambda x: all_.where(F.col("source") == x).select("qid", "doc_id", F.col("score").alias(x))
    x = at("full").join(all_.where("source = 'full' and rank <= 30").select("qid", "doc_id", F.col("rank").alias("pos")), ["qid", "doc_id"])
    x = x.join(at("head"), ["qid", "doc_id"], "left").join(at("tail"), ["qid", "doc_id"], "left").fillna(0.0, ["head", "tail"])
    return x.select("qid", "doc_id", "pos", F.round("head", 2).alias("x_ce"), F.col("full").alias("x_sim"), F.round("tail", 2).alias("y_ce"), (F.col("full") - F.col("head")).alias("y_sim"))


FAMILIES = ", fm AS (SELECT f.qid, f.doc_id, f.rank AS pos, round(coalesce(h.score, 0), 2) AS x_ce, f.score AS x_sim, round(coalesce(t.score, 0), 2) AS y_ce, f.score - coalesce(h.score, 0) AS y_sim FROM f LEFT JOIN (SELECT * FROM lists WHERE source = 'head') h USING (qid, doc_id) LEFT JOIN (SELECT * FROM lists WHERE source = 'tail') t USING (qid, doc_id) WHERE f.rank <= 30)\n"
_GAP = "(max({x}) OVER w - {x}) / CASE WHEN stddev_pop({x}) OVER w < 1e-8 THEN 1 ELSE stddev_pop({x}) OVER w END"
SEMANTIC = BASE + FAMILIES + ", rk AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY {c} DESC, pos) AS {c}_r" for c in ("x_ce", "x_sim", "y_ce", "y_sim")) + " FROM fm) SELECT qid, doc_id, " + ", ".join(f"round({f}_ce, 6) AS {f}_raw, round({Z.format(x=f + '_ce')}, 6) AS {f}_z, round({_GAP.format(x=f + '_ce')}, 6) AS {f}_gap, round(1 / (10.0::DOUBLE + {f}_ce_r), 6) AS {f}_rr10, round({f}_sim, 6) AS {f}_sim, round({Z.format(x=f + '_sim')}, 6) AS {f}_sim_z, round(1 / (10.0::DOUBLE + {f}_sim_r), 6) AS {f}_sim_rr10" for f in "xy") + ", round(greatest(x_ce, y_ce), 6) AS ce_max, round(least(x_ce, y_ce), 6) AS ce_min, round((x_ce + y_ce) / 2, 6) AS ce_mean, round(abs(x_ce - y_ce), 6) AS ce_absdiff, ((x_ce_r <= 5)::INT + (y_ce_r <= 5)::INT)::DOUBLE AS top5_support, round(abs(x_ce_r - y_ce_r) / 30.0::DOUBLE, 6) AS rank_diff FROM rk WINDOW w AS (PARTITION BY qid)"


def shortlist_features(s, d):
    """The whole shortlist table: five columns a source, nine over all, six of the reranker, and the label."""
    x = _shortlist(s, d)
    wide = fusion.candidate_features(lists(s, d), SOURCES).join(features.rerank_features(x), ["qid", "doc_id"])
    return r6(wide.join(gold(s, d).withColumn("label", F.lit(1)), ["qid", "doc_id"], "left").fillna(0, ["label"]))


LOCAL = ["selector_rr10", "selector_rank", "ce_raw", "ce_z", "ce_gap_z", "ce_rr10"]


def local_z(s, d):
    return r6(features.local_z(features.rerank_features(_shortlist(s, d)).drop("pos"), LOCAL))


_RF = SC + f", rf AS (SELECT qid, doc_id, 1 / (10.0::DOUBLE + pos) AS selector_rr10, pos / 30.0::DOUBLE AS selector_rank, b AS ce_raw, {Z.format(x='b')} AS ce_z, {_GAP.format(x='b')} AS ce_gap_z, 1 / (10.0::DOUBLE + row_number() OVER (PARTITION BY qid ORDER BY b DESC, doc_id)) AS ce_rr10 FROM sc WINDOW w AS (PARTITION BY qid))\n"
LOCAL_Z = BASE + _RF + "SELECT qid, doc_id, " + ", ".join(f"round({Z.format(x=c).replace('1e-8', '1e-6')}, 6) AS {c}" for c in LOCAL) + " FROM rf WINDOW w AS (PARTITION BY qid)"


def coefficient_summary(s, d):
    """Mean, deviation and range over folds of each feature's fold mean among gold less that among the others."""
    x = features.rerank_features(_shortlist(s, d)).join(gold(s, d).withColumn("g", F.lit(1)), ["qid", "doc_id"], "left")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in LOCAL))).alias("x")
    y = x.select(_fold().alias("fold"), F.col("g").isNotNull().alias("g"), cells).select("fold", "g", "x.*")
    y = y.groupBy("fold", "feature").agg((F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("value"))
    return r6(metrics.summary(y))


SUMMARY = BASE + _RF + ", fv AS (SELECT (qid // 20) % 5 AS fold, feature, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS value FROM (" + " UNION ALL ".join(f"SELECT rf.qid, '{c}' AS feature, {c} AS v, gold.doc_id IS NOT NULL AS g FROM rf LEFT JOIN gold ON gold.qid = rf.qid AND gold.doc_id = rf.doc_id" for c in LOCAL) + ") GROUP BY ALL), fs AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high FROM fv GROUP BY feature) SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high, row_number() OVER (ORDER BY round(abs(mean), 9) DESC, feature) AS place FROM fs"


def residual_sweep(s, d):
    """Recall at 5, its mean over folds less 0.35 deviations, and queries won and lost against the base, for each signal, mode
    and beta."""
    x = _families(s, d).select("qid", "doc_id", "pos", fusion.z(F.col("x_sim")).alias("base"), fusion.z(F.col("x_ce")).alias("head"), fusion.z(F.col("y_ce")).alias("tail"))
    x = cut(x)
    grid = fusion.residual_grid(x, ["head", "tail"], [0.0, *BETAS])
    g = cut(gold(s, d))
    size = g.groupBy("qid").agg(F.count("*").alias("n"))
    hits = grid.join(g, ["qid", "doc_id"]).groupBy("signal", "mode", "beta", "qid").agg(F.count("*").alias("h"))
    config = grid.select("signal", "mode", "beta").distinct()
    per = config.crossJoin(F.broadcast(size) if size.count() <= 10_000 else size).join(hits, ["signal", "mode", "beta", "qid"], "left").select("signal", "mode", "beta", "qid", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("r"))
    per = cut(per)
    base = per.where("beta = 0 and mode = 'raw' and signal = 'head'").select("qid", F.col("r").alias("r0"))
    x = per.where("beta <> 0").join(base, "qid")
    by = ["signal", "mode", "beta"]
    folds = x.groupBy(*by, _fold().alias("fold")).agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.count_if(F.col("r") > F.col("r0")).alias("w"), F.count_if(F.col("r") < F.col("r0")).alias("l"))
    m = F.col("s") / F.col("n")
    return r6(folds.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("recall"), (F.avg(m) - 0.35 * F.stddev_pop(m)).alias("robust"), F.sum("w").alias("wins"), F.sum("l").alias("losses")))


RESIDUAL = BASE + FAMILIES + f""", zz AS (SELECT qid, doc_id, pos, {Z.format(x='x_sim')} AS base, {Z.format(x='x_ce')} AS head, {Z.format(x='y_ce')} AS tail FROM fm WINDOW w AS (PARTITION BY qid)),
og AS (SELECT *, head - sum(head * base) OVER w / sum(base * base) OVER w * base AS oh, tail - sum(tail * base) OVER w / sum(base * base) OVER w * base AS ot FROM zz WINDOW w AS (PARTITION BY qid)),
md AS ({' UNION ALL '.join(f"SELECT '{sig}' AS signal, '{m}' AS mode, qid, doc_id, base, {x} AS x FROM og" for sig, o in (('head', 'oh'), ('tail', 'ot')) for m, x in (('raw', sig), ('orth', o), ('boundary', f'{o} * (pos BETWEEN 4 AND 9)::INT')))}),
bt AS (SELECT unnest({[0.0, *BETAS]})::DOUBLE AS beta), gr AS (SELECT signal, mode, beta, qid, doc_id, row_number() OVER (PARTITION BY signal, mode, beta, qid ORDER BY round(base + beta * x, 9) DESC, doc_id) AS rank FROM md, bt),
hi AS (SELECT signal, mode, beta, qid, count(*) AS h FROM gr JOIN gold USING (qid, doc_id) WHERE rank <= 5 GROUP BY ALL), cf AS (SELECT DISTINCT signal, mode, beta FROM gr),
pq AS (SELECT cf.*, ng.qid, coalesce(h, 0) / n::DOUBLE AS r FROM cf CROSS JOIN ng LEFT JOIN hi ON hi.signal = cf.signal AND hi.mode = cf.mode AND hi.beta = cf.beta AND hi.qid = ng.qid),
b0 AS (SELECT qid, r AS r0 FROM pq WHERE beta = 0 AND mode = 'raw' AND signal = 'head'),
fo AS (SELECT signal, mode, beta, (qid // 20) % 5 AS fold, sum(r) AS s, count(*) AS n, count(*) FILTER (r > r0) AS w, count(*) FILTER (r < r0) AS l FROM pq JOIN b0 USING (qid) WHERE beta <> 0 GROUP BY ALL)
SELECT signal, mode, beta, round(sum(s) / sum(n), 6) AS recall, round(avg(s / n) - 0.35 * stddev_pop(s / n), 6) AS robust, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses FROM fo GROUP BY ALL"""


def shortlist_ceiling(s, d):
    return r6(metrics.curve(fused(lists(s, d)), gold(s, d), DEPTHS))


def slot5_oracle(s, d):
    all_ = lists(s, d)
    return features.slot5_oracle(all_.where("source = 'full'"), fused(all_, None), gold(s, d))


def challengers(s, d):
    all_ = lists(s, d)
    return features.challengers(all_.where("source = 'full'"), fused(all_, None), 8)


def fill_up(s, d):
    """The tail list's first 30 filled from the full list to 120 slots; what is still empty repeats the first."""
    all_ = lists(s, d)
    return fusion.fill_up(all_.where("source = 'tail' and rank <= 30"), all_.where("source = 'full'"), 120)


def _per_arm(s, d):
    all_, g = arms(lists(s, d)), gold(s, d)
    one = [metrics.per_query(all_.where(F.col("arm") == a), g).select(F.lit(a).alias("arm"), "qid", "recall") for a in ARMS]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


def arm_wins(s, d):
    return metrics.arm_wins(_per_arm(s, d), ARMS)


def dev_cert(s, d):
    """Recall of each arm on the development folds 0 to 2 and on the certification folds 3 and 4."""
    x = _per_arm(s, d).withColumn("split", F.when(_fold() <= 2, "dev").otherwise("cert"))
    return r6(x.groupBy("split", "arm").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall")))


PER_ARM = BASE + RRF + ", pa AS (SELECT arm, ng.qid, count(x.doc_id) / n::DOUBLE AS recall FROM ng CROSS JOIN (SELECT DISTINCT arm FROM ar) LEFT JOIN (SELECT ar.* FROM ar JOIN gold USING (qid, doc_id) WHERE rank <= 5) x USING (arm, qid) GROUP BY arm, ng.qid, n)\n"


def nested_alpha(s, d):
    return r6(select.nested_alpha(_grid(s, d)))


def paired_folds(s, d):
    return r6(metrics.paired_folds(_recall(s, d, "full"), _recall(s, d, "tail"), _fold()))


def training_negatives(s, d):
    x = fusion.ranked(fusion.ranked(_scores(s, d), "a", name="ra"), "b", name="rb")
    x = x.join(gold(s, d).withColumn("g", F.lit(1)), ["qid", "doc_id"], "left").select("qid", "doc_id", "ra", "rb", F.col("g").isNotNull().alias("gold"))
    return features.training_negatives(x)


def churn_slices(s, d):
    """The 200 queries with the least lead of rank 5 over 6, and the 200 whose first five change most between the full and
    the tail list."""
    all_ = lists(s, d)
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    lead = all_.where("source = 'full'").groupBy("qid").agg(F.round(at(5) - at(6), 9).alias("v"))
    top = all_.where("rank <= 5 and source <> 'head'").groupBy("qid", "doc_id").agg(F.count("*").alias("n"), F.first("source").alias("s"))
    churn = top.groupBy("qid").agg(F.count_if((F.col("n") == 1) & (F.col("s") == "tail")).cast("double").alias("v"))
    margin = lead.orderBy("v", "qid").limit(200).withColumn("slice", F.lit("margin"))
    return r6(margin.unionByName(churn.orderBy(F.desc("v"), "qid").limit(200).withColumn("slice", F.lit("churn"))).select("slice", "qid", F.col("v").alias("value")))


def cap5_oracle(s, d):
    """What five answers from the union of the sources' first 20 could reach, for each subset of sources."""
    return r6(metrics.union_oracle(lists(s, d), gold(s, d), SUBSETS, 20, cap=5).select("subset", "recall"))


def _gold_stats(s, d):
    """(qid, n, most, least): gold documents of a query, and how often the most and the least frequent of them is gold."""
    g = gold(s, d)
    freq = g.groupBy("doc_id").agg(F.count("*").alias("f"))
    return g.join(freq, "doc_id").groupBy("qid").agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("f").alias("least"))


def query_buckets(s, d):
    """Answer, frequency and density buckets of a query: gold documents, the most frequent of them, the best score."""
    x = _gold_stats(s, d).join(full(s, d, 1).select("qid", "score"), "qid")
    answer = F.when(F.col("n") == 1, "a1").when(F.col("n") == 2, "a2").otherwise("a3p")
    often = F.when(F.col("most") == 1, "f1").when(F.col("most") <= 3, "f2_3").when(F.col("most") <= 7, "f4_7").when(F.col("most") <= 15, "f8_15").otherwise("f16p")
    dense = F.when(F.col("score") < 0.6, "d_lt60").when(F.col("score") < 0.75, "d_60_75").when(F.col("score") < 0.9, "d_75_90").otherwise("d_90p")
    return x.select("qid", answer.alias("answer"), often.alias("frequency"), dense.alias("density"))


GS = ", fq AS (SELECT doc_id, count(*) AS f FROM gold GROUP BY doc_id), gt AS (SELECT qid, count(*) AS n, max(f) AS most, min(f) AS least FROM gold JOIN fq USING (doc_id) GROUP BY qid)\n"


def stress_grid(s, d):
    """Recall of the full list overall, per fold and on nine overlapping slices: gold counts, gold documents that are nearly
    empty (under 20 words) or copies, members of near-duplicate groups, dense neighbourhoods, rare and frequent gold."""
    g = cut(gold(s, d))
    t = spread(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.md5("text").alias("k"), (F.regexp_count("text", F.lit(r"\S+")) < 20).alias("short"))
    copies = t.groupBy("k").agg(F.count("*").alias("c"))
    about = g.join(t.join(copies, "k"), "doc_id", "left").groupBy("qid").agg(F.coalesce(F.bool_or("short"), F.lit(False)).alias("some_short"), F.coalesce(F.bool_and("short"), F.lit(False)).alias("all_short"), F.coalesce(F.bool_or(F.col("c") > 1), F.lit(False)).alias("copied"))
    near = _near(s, d)
    dense = near[0].select(F.explode(F.array("a", "b")).alias("qid")).distinct().withColumn("dense", F.lit(True))
    group = components(s, d, near)
    many = group.join(group.groupBy("component").agg(F.count("*").alias("c")).where("c > 1"), "component", "left_semi").select(F.col("node").alias("qid"), F.lit(True).alias("grouped"))
    x = _gold_stats(s, d).join(about, "qid", "left").join(dense, "qid", "left").join(many, "qid", "left")
    rules = {"single_gold": F.col("n") == 1, "multi_gold": F.col("n") > 1, "three_plus_gold": F.col("n") >= 3, "short_gold_but_evaluable": F.col("some_short") & ~F.col("all_short"), "copied_gold": F.col("copied"), "near_duplicate_member": F.col("grouped"), "dense_90": F.col("dense"), "rare_gold_only": F.col("most") == 1, "frequent_gold_16p": F.col("most") >= 16}
    members = x.select("qid", F.explode(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))).alias("slice")).where("slice is not null")
    return r6(metrics.slice_grid(_recall(s, d, "full").withColumn("fold", _fold()), members))


_B = BASE.replace("WITH q AS", ", q AS", 1)
STRESS = NEAR + _B + GS + """, dt AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) < 20 AS short, count(*) OVER (PARTITION BY text) AS c FROM documents), ab AS (SELECT qid, bool_or(short) AS ss, bool_and(short) AS al, bool_or(c > 1) AS cp FROM gold LEFT JOIN dt USING (doc_id) GROUP BY qid),
ed AS (SELECT a, b FROM np UNION ALL SELECT a, b FROM mem), """ + COMPONENTS.split("mem), ")[1].split(" SELECT vec_id")[0] + """, gm AS (SELECT node FROM cc WHERE component IN (SELECT component FROM cc GROUP BY 1 HAVING count(*) > 1)), sl AS (SELECT qid, unnest([CASE WHEN n = 1 THEN 'single_gold' END, CASE WHEN n > 1 THEN 'multi_gold' END, CASE WHEN n >= 3 THEN 'three_plus_gold' END, CASE WHEN ss AND NOT al THEN 'short_gold_but_evaluable' END, CASE WHEN cp THEN 'copied_gold' END,
 CASE WHEN qid IN (SELECT node FROM gm) THEN 'near_duplicate_member' END, CASE WHEN qid IN (SELECT a FROM np UNION SELECT b FROM np) THEN 'dense_90' END, CASE WHEN most = 1 THEN 'rare_gold_only' END, CASE WHEN most >= 16 THEN 'frequent_gold_16p' END, 'all', 'fold_' || ((qid // 20) % 5)]) AS slice FROM gt JOIN ab USING (qid))
SELECT slice, count(*) AS queries, round(avg(recall), 6) AS recall FROM sl JOIN per USING (qid) WHERE source = 'full' AND slice IS NOT NULL GROUP BY slice"""


def witness_texts(s, d):
    """Each query's best child of a parent with the hash of its document's text, null where it has none."""
    w = vector.witness(vector.children(q_vec(s, d), d_vec(s, d), parents(s, d)))
    t = spread(s.read.parquet(f"{d}/documents.parquet")).select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("text_key"))
    return w.join(t, "vec_id", "left").select("qid", "parent_id", "vec_id", "text_key")


def child_ranges(s, d):
    """Rows [lo, hi) of each parent, ten vectors in a row being one parent's; rows that are not contiguous raise."""
    x = s.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 10).alias("parent_id"), F.col("vec_id").alias("row"))
    return vector.child_ranges(x)


QUERIES: dict = {
    "arm_diagnostics": (arm_diagnostics, DIAGNOSTICS),
    "arm_overlaps": (arm_overlaps, OVERLAPS),
    "semantic_features": (lambda s, d: r6(features.semantic_features(_families(s, d), ["x", "y"])), SEMANTIC),
    "local_z": (local_z, LOCAL_Z),
    "coefficient_summary": (coefficient_summary, SUMMARY),
    "orth_residual_sweep": (residual_sweep, RESIDUAL),
    "shortlist_ceiling": (shortlist_ceiling, BASE + RRF + f", k AS (SELECT unnest({list(DEPTHS)})::BIGINT AS k), h AS (SELECT k, gold.qid, count(*) AS n, count(*) FILTER (rank <= k) AS h FROM gold CROSS JOIN k LEFT JOIN (SELECT * FROM rr WHERE rank <= 100) r USING (qid, doc_id) GROUP BY ALL) SELECT k, round(avg(h / n::DOUBLE), 6) AS macro_recall, round(avg((h = n)::INT), 6) AS full_coverage, round(sum(h) / sum(n)::DOUBLE, 6) AS micro_recall FROM h GROUP BY k"),
    "slot5_oracle": (slot5_oracle, BASE + RRF + ", pk AS (SELECT qid, arg_min(doc_id, rank) AS p FROM rr JOIN gold USING (qid, doc_id) WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM f WHERE rank <= 4) GROUP BY qid) SELECT qid, doc_id AS old, coalesce(p, doc_id) AS new, coalesce(p, doc_id) <> doc_id AS changed FROM f LEFT JOIN pk USING (qid) WHERE rank = 5"),
    "challengers": (challengers, BASE + RRF + " SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth, doc_id FROM rr WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM f WHERE rank <= 5)) WHERE nth <= 8"),
    "fill_up": (fill_up, BASE + ", u AS (SELECT qid, doc_id, min((p, rank)) AS o FROM (SELECT qid, doc_id, 0 AS p, rank FROM lists WHERE source = 'tail' AND rank <= 30 UNION ALL SELECT qid, doc_id, 1, rank FROM f) GROUP BY ALL), v AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS slot FROM u), g AS (SELECT q.qid, slot FROM q, (SELECT unnest(generate_series(1, 120)) AS slot)) SELECT g.qid, g.slot, coalesce(v.doc_id, one.doc_id) AS doc_id FROM g LEFT JOIN v ON v.qid = g.qid AND v.slot = g.slot JOIN v one ON one.qid = g.qid AND one.slot = 1"),
    "arm_wins": (arm_wins, PER_ARM + f"SELECT arm, count(*) AS wins FROM (SELECT arm, row_number() OVER (PARTITION BY qid ORDER BY recall DESC, list_position({ARMS}, arm)) AS k FROM pa) WHERE k = 1 GROUP BY arm"),
    "dev_cert": (dev_cert, PER_ARM + "SELECT CASE WHEN (qid // 20) % 5 <= 2 THEN 'dev' ELSE 'cert' END AS split, arm, count(*) AS queries, round(avg(recall), 6) AS recall FROM pa GROUP BY ALL"),
    "nested_alpha": (nested_alpha, BASE + GRID + ", hd AS (SELECT DISTINCT fold AS held FROM grid), tr AS (SELECT held, w, round(sum(recall * n) / sum(n), 9) AS train FROM grid JOIN hd ON fold <> held GROUP BY ALL), bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY train DESC, w) AS k FROM tr) WHERE k = 1) SELECT held, bs.w AS alpha, round(train, 6) AS train, round(recall, 6) AS recall, n FROM bs JOIN grid ON fold = held AND grid.w = bs.w"),
    "paired_folds": (paired_folds, BASE + ", x AS (SELECT a.qid, (a.qid // 20) % 5 AS fold, round(b.recall - a.recall, 12) AS v FROM per a JOIN per b USING (qid) WHERE a.source = 'full' AND b.source = 'tail'), p AS (SELECT fold, avg(v) AS delta, count(*) FILTER (v > 0) AS wins, count(*) FILTER (v < 0) AS losses FROM x GROUP BY fold), t AS (SELECT avg(v) AS delta, count(*) FILTER (v > 0) AS wins, count(*) FILTER (v < 0) AS losses FROM x) SELECT fold, round(delta, 6) AS delta, wins, losses, NULL::VARCHAR AS decision FROM p UNION ALL SELECT -1, round(delta, 6), wins, losses, CASE WHEN delta > 0 AND wins > losses AND (SELECT count(*) FILTER (delta > 0) FROM p) >= 3 THEN 'PROMOTE' ELSE 'KILL' END FROM t"),
    "training_negatives": (training_negatives, BASE + SC + ", two AS (SELECT sc.*, row_number() OVER (PARTITION BY qid ORDER BY a DESC, sc.doc_id) AS ra, row_number() OVER (PARTITION BY qid ORDER BY b DESC, sc.doc_id) AS rb, (qid, sc.doc_id) IN (SELECT (qid, doc_id) FROM gold) AS gold FROM sc), ng2 AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY ra, doc_id) AS n0, row_number() OVER (PARTITION BY qid ORDER BY rb, doc_id) AS n1, row_number() OVER (PARTITION BY qid ORDER BY abs(ra - rb) DESC, doc_id) AS n2 FROM two WHERE NOT gold), ch AS (SELECT *, CASE WHEN n0 <= 3 THEN 0 WHEN n1 <= 3 THEN 1 ELSE 2 END AS i FROM ng2 WHERE n0 <= 3 OR n1 <= 3 OR n2 <= 3), cp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i, [n0, n1, n2][i + 1]) AS k FROM ch) SELECT qid, doc_id, ['base', 'teacher', 'disagreement'][i + 1] AS reason FROM cp WHERE k <= 6 UNION ALL SELECT qid, doc_id, 'gold' FROM two WHERE gold"),
    "churn_slices": (churn_slices, BASE + ", ld AS (SELECT qid, round(max(score) FILTER (rank = 5) - max(score) FILTER (rank = 6), 9) AS v FROM f GROUP BY qid), ch AS (SELECT qid, count(*) FILTER ((qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM f WHERE rank <= 5))::DOUBLE AS v FROM lists WHERE source = 'tail' AND rank <= 5 GROUP BY qid) (SELECT 'margin' AS slice, qid, round(v, 6) AS value FROM ld ORDER BY v, qid LIMIT 200) UNION ALL (SELECT 'churn', qid, v FROM ch ORDER BY v DESC, qid LIMIT 200)"),
    "cap5_oracle": (cap5_oracle, BASE + ", sub(subset, members) AS (VALUES " + ", ".join(f"('{'+'.join(x)}', {x})" for x in SUBSETS) + "), u AS (SELECT DISTINCT subset, qid, doc_id FROM lists JOIN sub ON list_contains(members, source) JOIN gold USING (qid, doc_id) WHERE rank <= 20), c AS (SELECT subset, qid, count(*) AS h FROM u GROUP BY ALL) SELECT subset, round(avg(least(coalesce(h, 0), 5) / n::DOUBLE), 6) AS recall FROM ng CROSS JOIN sub LEFT JOIN c USING (subset, qid) GROUP BY subset"),
    "query_buckets": (query_buckets, BASE + GS + "SELECT qid, CASE WHEN n = 1 THEN 'a1' WHEN n = 2 THEN 'a2' ELSE 'a3p' END AS answer, CASE WHEN most = 1 THEN 'f1' WHEN most <= 3 THEN 'f2_3' WHEN most <= 7 THEN 'f4_7' WHEN most <= 15 THEN 'f8_15' ELSE 'f16p' END AS frequency, CASE WHEN score < 0.6 THEN 'd_lt60' WHEN score < 0.75 THEN 'd_60_75' WHEN score < 0.9 THEN 'd_75_90' ELSE 'd_90p' END AS density FROM gt JOIN f USING (qid) WHERE rank = 1"),
    "stress_grid": (stress_grid, STRESS),
    "witness_texts": (witness_texts, BASE + 'SELECT qid, parent_id, vec_id, md5(text) AS text_key FROM (SELECT qid, parent_id, doc_id AS vec_id, row_number() OVER (PARTITION BY qid, parent_id ORDER BY "full" DESC, doc_id) AS n FROM sims) w LEFT JOIN documents ON documents.doc_id = vec_id WHERE n = 1'),
    "child_ranges": (child_ranges, "SELECT vec_id // 10 AS parent_id, min(vec_id) AS lo, max(vec_id) + 1 AS hi FROM embeddings GROUP BY 1"),
    "shortlist_features": (shortlist_features, BASE + _RF + f", cx AS (SELECT source, qid, doc_id, rank, {Z.format(x='score')} AS z, {_GAP.format(x='score')} AS gap FROM lists WINDOW w AS (PARTITION BY source, qid)), cd AS (SELECT qid, doc_id, count(*)::DOUBLE AS source_count, round(max(1 / (10.0::DOUBLE + rank)), 6) AS best_rr10, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS rrf60, round(min(rank / 50.0::DOUBLE), 6) AS min_rank, round(avg(rank / 50.0::DOUBLE), 6) AS mean_rank, " + ", ".join(f"count(*) FILTER (rank <= {n})::DOUBLE AS count_top{n}" for n in (5, 10, 20)) + ", round(sum(1 / (10.0::DOUBLE + rank)) / 3, 6) AS mean_rr10, " + ", ".join(f"coalesce(max(1.0::DOUBLE) FILTER (source = '{x}'), 0) AS {x}_present, round(coalesce(max(1 / (10.0::DOUBLE + rank)) FILTER (source = '{x}'), 0), 6) AS {x}_rr10, round(coalesce(max(rank / 50.0::DOUBLE) FILTER (source = '{x}'), 1.2), 6) AS {x}_rank, round(coalesce(max(z) FILTER (source = '{x}'), -3), 6) AS {x}_z, round(coalesce(max(gap) FILTER (source = '{x}'), 4), 6) AS {x}_gap" for x in SOURCES) + " FROM cx WHERE rank <= 50 GROUP BY qid, doc_id) SELECT cd.*, pos, " + ", ".join(f"round({c}, 6) AS {c}" for c in LOCAL) + ", (gold.doc_id IS NOT NULL)::INT AS label FROM cd JOIN rf USING (qid, doc_id) JOIN sc USING (qid, doc_id) LEFT JOIN gold ON gold.qid = cd.qid AND gold.doc_id = cd.doc_id"),
}
