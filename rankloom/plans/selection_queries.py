"""Named queries over folds, screening, rule and configuration choice, and models that choose, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import features, fusion, metrics, model, select
from rankloom.plans.text_queries import docs
from rankloom.plans.vector_queries import BASE, GRID, SC, SOURCES, Z, _grid, _recall, _scores, full, gold, lists, r6, vectors

ZZ = SC + f""", zz AS (SELECT qid, doc_id, a, b, pos, {Z.format(x='a')} AS za, {Z.format(x='b')} AS zb, row_number() OVER (PARTITION BY qid ORDER BY a DESC, doc_id) AS ra, row_number() OVER (PARTITION BY qid ORDER BY b DESC, doc_id) AS rb FROM sc WINDOW w AS (PARTITION BY qid))
"""


def boundary_stats(s, d):
    """What enters and leaves the top five when the mean of both z replaces the full source."""
    x = _scores(s, d).withColumn("c", F.round((fusion.z(F.col("a")) + fusion.z(F.col("b"))) / 2, 9))
    x = fusion.ranked(fusion.ranked(x, "a", name="ra"), "c", name="rc").withColumn("place", -F.col("ra") / 30)
    return r6(features.boundary_stats(x, ["a", "b", "place"], "ra", "rc"))


def _stats() -> str:
    out = []
    for move, on in (("enter", "rc <= 5 AND ra > 5"), ("leave", "ra <= 5 AND rc > 5")):
        for v in ("a", "b", "place"):
            out += [f"round(coalesce({f}({v}) FILTER ({on}), 0), 6) AS {move}_{v}_{n}" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))]
    return ", ".join(out)


def agreement(s, d):
    return r6(features.agreement(lists(s, d), [("full", "head"), ("full", "tail"), ("head", "tail")]))


def config_tournament(s, d):
    top = fusion.tournament(_scores(s, d))
    return r6(_config_recall(s, d, top))


def _config_recall(s, d, top):
    names = ["kind", "w", "k", "hi", "at"]
    g = gold(s, d)
    size = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hit = top.join(g, ["qid", "doc_id"]).groupBy(*names, "qid").agg(F.count("*").alias("h"))
    total = size.agg(F.count("*").alias("n"))
    per = hit.join(size, "qid").groupBy(*names).agg(F.sum(F.col("h") / F.col("n_gold")).alias("s"))
    every = s.createDataFrame(fusion.config_grid(), "kind string, w double, k long, hi double, at double")
    every = every.join(per, names, "left").crossJoin(F.broadcast(total)).where("n > 0")
    return every.select(*names, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("recall"))


def _cfg() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, {c}::BIGINT, {h}::DOUBLE, {a}::DOUBLE)" for k, w, c, h, a in fusion.config_grid()) + ") AS t(kind, w, k, hi, \"at\")"


TOURNAMENT = ZZ + f""", cfg AS ({_cfg()}), st AS (SELECT qid, sum((ra <= 5 AND rb <= 5)::INT) AS shared, list_reverse_sort(list(round(0.75 * za + 0.25 * zb, 9))) AS s, list_reverse_sort(list(round(za, 9))) AS p FROM zz GROUP BY qid),
sg AS (SELECT qid, shared, round(s[5] - s[6], 9) AS gap, round(p[5] - p[8], 9) AS spread FROM st), lim AS (SELECT unnest([0.2, 0.35, 0.5])::DOUBLE AS "at", unnest(quantile_cont(gap, [0.2, 0.35, 0.5])) AS g, unnest(quantile_cont(spread, [0.2, 0.35, 0.5])) AS p FROM sg),
cw AS (SELECT cfg.*, zz.qid, doc_id, za, zb, ra, rb, CASE WHEN kind = 'agree' AND shared <= cfg."at" OR kind = 'boundary' AND gap <= round(g, 9) OR kind = 'plateau' AND spread <= round(lim.p, 9) THEN hi ELSE w END AS x FROM zz JOIN sg USING (qid) CROSS JOIN cfg LEFT JOIN lim ON lim."at" = cfg."at"),
cs AS (SELECT kind, w, k, hi, "at", qid, doc_id, round(CASE kind WHEN 'borda' THEN -(w * ra + (1 - w) * rb) WHEN 'rrf' THEN w / (k + ra) + (1 - w) / (k + rb) ELSE x * za + (1 - x) * zb END, 9) AS score FROM cw),
cr AS (SELECT *, row_number() OVER (PARTITION BY kind, w, k, hi, "at", qid ORDER BY score DESC, doc_id) AS rank FROM cs), ch AS (SELECT kind, w, k, hi, "at", cr.qid, count(gold.doc_id) / any_value(n)::DOUBLE AS r FROM cr JOIN ng USING (qid) LEFT JOIN gold ON gold.qid = cr.qid AND gold.doc_id = cr.doc_id WHERE rank <= 5 GROUP BY ALL)
SELECT kind, w, k, hi, "at", round(sum(r) / (SELECT count(*) FROM ng)::DOUBLE, 6) AS recall FROM ch GROUP BY ALL"""


def _folded(s, d):
    n = F.col("n_chars")
    length = F.when(n < 500, "short").when(n < 3000, "mid").otherwise("long")
    return docs(s, d).select("doc_id", (F.col("doc_id") % 97).alias("grp"), "lang", "source", length.alias("length"))


def seed_scan(s, d):
    return r6(select.seed_scan(_folded(s, d), "grp", {"lang": 8.0, "source": 4.0, "length": 2.0}))


SEEDS = """WITH x AS (SELECT doc_id % 97 AS grp, lang, source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'mid' ELSE 'long' END AS length FROM documents),
u AS (SELECT grp, '' AS cat, '' AS value, count(*) AS m FROM x GROUP BY ALL UNION ALL SELECT grp, 'lang', lang, count(*) FROM x GROUP BY ALL UNION ALL SELECT grp, 'source', source, count(*) FROM x GROUP BY ALL UNION ALL SELECT grp, 'length', length, count(*) FROM x GROUP BY ALL),
f AS (SELECT seed, cat, value, ('0x' || substr(md5(grp || ':' || seed), 1, 8))::BIGINT % 5 AS fold, m FROM u, range(512) AS r(seed)),
c AS (SELECT seed, cat, value, fold, sum(m) AS c FROM f GROUP BY ALL), z AS (SELECT r.seed, g.fold, coalesce(c, 0) AS nf FROM range(512) AS r(seed) CROSS JOIN range(5) AS g(fold) LEFT JOIN c ON c.seed = r.seed AND c.fold = g.fold AND cat = ''), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT cat, value, sum(m) AS tot FROM u WHERE cat <> '' GROUP BY ALL), dv AS (SELECT z.seed, v.cat, max(abs(CASE WHEN nf > 0 THEN coalesce(c.c, 0) / nf::DOUBLE ELSE 0 END - tot / n::DOUBLE)) AS dev FROM z CROSS JOIN v CROSS JOIN n LEFT JOIN c ON c.seed = z.seed AND c.fold = z.fold AND c.cat = v.cat AND c.value IS NOT DISTINCT FROM v.value GROUP BY ALL),
o AS (SELECT seed, sum(CASE cat WHEN 'lang' THEN 8 WHEN 'source' THEN 4 ELSE 2 END * dev) AS s FROM dv GROUP BY seed), sz AS (SELECT seed, max(abs(nf - n / 5.0::DOUBLE) / (n / 5.0::DOUBLE)) AS size_dev FROM z, n GROUP BY seed), r AS (SELECT seed, size_dev, round(12 * size_dev + s, 9) AS objective FROM o JOIN sz USING (seed))
SELECT seed, round(size_dev, 6) AS size_dev, round(objective, 6) AS objective, row_number() OVER (ORDER BY objective, seed) = 1 AS chosen FROM r"""


def _screened(s, d):
    base = _recall(s, d, "full").select("qid", F.col("recall").alias("base"), "n_gold")
    pool = full(s, d).where("rank <= 15").join(gold(s, d), ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("h"))
    return base.join(pool, "qid", "left").select("qid", "base", (F.least(F.lit(5), F.coalesce("h", F.lit(0))) / F.col("n_gold")).alias("oracle"))


def screening_sample(s, d):
    return select.screen(_screened(s, d), least=8, most=18)


SCREEN = BASE + """, o AS (SELECT ng.qid, p.recall AS base, least(5, (SELECT count(*) FROM f JOIN gold USING (qid, doc_id) WHERE f.qid = ng.qid AND rank <= 15)) / ng.n::DOUBLE AS oracle FROM ng JOIN per p ON p.qid = ng.qid AND source = 'full'),
x AS (SELECT qid, oracle > base + 1e-12 AS rescuable FROM o), c AS (SELECT count(*) FILTER (rescuable) AS r FROM x), k AS (SELECT qid, row_number() OVER (ORDER BY md5(qid || ':0'), qid) AS i FROM x WHERE NOT rescuable), t AS (SELECT qid, row_number() OVER (ORDER BY qid) AS j FROM k, c WHERE i <= greatest(r, 8))
SELECT qid, rescuable FROM x WHERE rescuable UNION ALL SELECT qid, false FROM t, c WHERE j <= greatest(0, 18 - r)"""


def rule_selection(s, d):
    """Whether, and by which depth and threshold, a challenger below the fifth place should take it."""
    ks, qs = [1, 2, 5], [0.5, 0.7, 0.9]
    g = gold(s, d).withColumn("g", F.lit(1))
    x = _scores(s, d).withColumn("zb", fusion.z(F.col("b"))).join(g, ["qid", "doc_id"], "left").fillna(0, ["g"])
    n = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    fifth = x.where("pos = 5").select("qid", F.col("zb").alias("z5"), F.col("g").alias("g5")).join(n, "qid")
    rest = x.where("pos between 6 and 10").join(fifth, "qid").withColumn("u", F.round(F.col("zb") - F.col("z5"), 9))
    best = rest.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("pos <= 5 + k").groupBy("k", "qid", "g5", "n_gold").agg(F.max(F.struct("u", (-F.col("doc_id")).alias("i"), "g")).alias("b"))
    best = best.select("k", "qid", F.col("b.u").alias("u"), ((F.col("b.g") - F.col("g5")) / F.col("n_gold")).alias("gain"), (F.floor(F.col("qid") / 20) % 5).alias("fold"))
    at = best.groupBy("k").agg(F.percentile("u", F.array(*map(F.lit, qs))).alias("t"))
    at = at.select("k", F.posexplode("t").alias("i", "t")).select("k", F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"), F.round("t", 9).alias("t"))
    y = best.join(F.broadcast(at), "k").withColumn("on", (F.col("u") >= F.col("t")).cast("int"))
    deltas = y.groupBy("k", "q", "fold").agg((F.sum(F.col("gain") * F.col("on")) / F.count("*")).alias("delta"), F.sum("on").alias("changed"), F.count("*").alias("n"))
    return r6(select.best_rule(deltas, ["k", "q"], most_changed=0.6).withColumn("k", F.col("k").cast("long")))


RULES = ZZ + """, x AS (SELECT zz.*, (g.doc_id IS NOT NULL)::INT AS g FROM zz LEFT JOIN gold g ON g.qid = zz.qid AND g.doc_id = zz.doc_id), v AS (SELECT x.qid, zb AS z5, g AS g5, n FROM x JOIN ng ON ng.qid = x.qid WHERE pos = 5),
c AS (SELECT k, x.qid, n, g, g5, round(zb - z5, 9) AS u, row_number() OVER (PARTITION BY k, x.qid ORDER BY round(zb - z5, 9) DESC, doc_id) AS r FROM x JOIN v ON v.qid = x.qid CROSS JOIN (SELECT unnest([1, 2, 5])::BIGINT AS k) WHERE pos BETWEEN 6 AND 5 + k), b AS (SELECT k, qid, u, (g - g5) / n::DOUBLE AS gain, (qid // 20) % 5 AS fold FROM c WHERE r = 1),
t AS (SELECT k, q, round(t, 9) AS t FROM (SELECT k, unnest([0.5, 0.7, 0.9])::DOUBLE AS q, unnest(quantile_cont(u, [0.5, 0.7, 0.9])) AS t FROM b GROUP BY k)), dl AS (SELECT b.k, q, fold, sum(CASE WHEN u >= t THEN gain ELSE 0 END) / count(*) AS delta, sum((u >= t)::INT) AS changed, count(*) AS n FROM b JOIN t ON t.k = b.k GROUP BY b.k, q, fold),
p AS (SELECT k, q, round(avg(delta), 9) AS mean_delta, round(stddev_pop(delta), 9) AS sd_delta, sum((delta > 0)::INT)::BIGINT AS positive, round(sum(changed) / sum(n)::DOUBLE, 9) AS change_rate FROM dl GROUP BY k, q), w AS (SELECT *, mean_delta > 0 AND positive >= 2 AND change_rate <= 0.6 AS valid FROM p)
SELECT k, q, round(mean_delta, 6) AS mean_delta, round(sd_delta, 6) AS sd_delta, positive, round(change_rate, 6) AS change_rate, valid, valid AND row_number() OVER (PARTITION BY valid ORDER BY round(mean_delta - 0.5 * sd_delta, 9) DESC, mean_delta DESC, change_rate, k, q) = 1 AS chosen FROM w"""


def cross_held(s, d):
    return r6(select.cross_held(_grid(s, d), "w", 0.75))


CROSS = GRID + """, cx AS (SELECT w, round(max(recall) FILTER (fold = 3), 9) AS a, round(max(recall) FILTER (fold = 4), 9) AS b, max(n) FILTER (fold = 3) AS na, max(n) FILTER (fold = 4) AS nb FROM grid GROUP BY w), cm AS (SELECT *, round((na * a + nb * b) / (na + nb)::DOUBLE, 9) AS mean FROM cx), rf AS (SELECT a AS ra, b AS rb, mean AS rm FROM cm WHERE w = 0.75),
cy AS (SELECT *, round(least(a - ra, b - rb), 9) AS worst FROM cm, rf), p1 AS (SELECT w, b FROM cy ORDER BY a DESC, b DESC, w LIMIT 1), p2 AS (SELECT w, a FROM cy ORDER BY b DESC, a DESC, w LIMIT 1), p3 AS (SELECT * FROM cy ORDER BY mean DESC, worst DESC, w LIMIT 1)
SELECT p1.w AS best_a, round(p1.b, 6) AS tested_b, p2.w AS best_b, round(p2.a, 6) AS tested_a, round((p1.b + p2.a) / 2, 6) AS cross_mean, p3.w AS best_mean, round(p3.mean, 6) AS mean, p3.mean >= rm + 0.00025 AND p3.a >= ra - 0.00072 AND p3.b >= rb - 0.00072 AND (p1.b + p2.a) / 2 >= (ra + rb) / 2 - 0.0002 AS passed FROM p1, p2, p3"""

_FEATURES = ["a", "b", "za", "zb"]


def _labelled(s, d):
    x = _scores(s, d).withColumn("za", fusion.z(F.col("a"))).withColumn("zb", fusion.z(F.col("b")))
    x = x.join(gold(s, d).withColumn("g", F.lit(1.0)), ["qid", "doc_id"], "left")
    return x.select("qid", "doc_id", (F.col("qid") * 1_000_000 + F.col("doc_id")).alias("id"), (F.floor(F.col("qid") / 20) % 3).cast("int").alias("fold"), F.coalesce("g", F.lit(0.0)).alias("label"), *_FEATURES)


def nested_priors(s, d):
    return model.nested_priors(_labelled(s, d), _FEATURES, 0)


def pairwise_logistic(s, d):
    """Winners against the losers next to them in a's order, up to three a winner."""
    x = fusion.ranked(_labelled(s, d), "a", name="ra").withColumn("f", F.array(*_FEATURES))
    won, lost = x.where("label = 1").select("qid", F.col("ra").alias("rw"), F.col("f").alias("x")), x.where("label = 0").select("qid", "ra", F.col("f").alias("y"))
    return model.pairwise_logistic(won.join(lost, "qid").where("abs(ra - rw) <= 3").select("x", "y"), _FEATURES)


def routed_arms(s, d):
    all_ = lists(s, d)
    per = metrics.per_query(all_.where("source = 'full'"), gold(s, d)).select("qid", F.col("recall").alias("full"))
    for a in SOURCES[1:]:
        per = per.join(metrics.per_query(all_.where(F.col("source") == a), gold(s, d)).select("qid", F.col("recall").alias(a)), "qid")
    x = per.join(vectors(s, d).select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")), "qid")
    return model.route_arms(x.select(F.col("qid").alias("id"), (F.floor(F.col("qid") / 20) % 3).alias("fold"), "embedding", *SOURCES), SOURCES)


def kmeans_choice(s, d):
    x = vectors(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return model.kmeans_by_silhouette(x, ks=(8, 12, 16))[0]


QUERIES: dict = {
    "boundary_stats": (boundary_stats, BASE + ZZ + ", c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round((za + zb) / 2, 9) DESC, doc_id) AS rc, -ra / 30.0::DOUBLE AS place FROM zz) SELECT qid, sum((rc <= 5 AND ra > 5 OR ra <= 5 AND rc > 5)::INT)::BIGINT AS churn, " + _stats() + " FROM c GROUP BY qid"),
    "source_agreement": (agreement, BASE + "SELECT qid, " + ", ".join(f"round(sum(({a} AND {b})::INT) / sum(({a} OR {b})::INT)::DOUBLE, 6) AS {n}" for a, b, n in (("fu", "he", "full_head"), ("fu", "ta", "full_tail"), ("he", "ta", "head_tail"))) + " FROM (SELECT qid, doc_id, bool_or(source = 'full') AS fu, bool_or(source = 'head') AS he, bool_or(source = 'tail') AS ta FROM lists WHERE rank <= 5 GROUP BY ALL) GROUP BY qid"),
    "config_tournament": (config_tournament, BASE + TOURNAMENT),
    "fold_seed_scan": (seed_scan, SEEDS),
    "screening_sample": (screening_sample, SCREEN),
    "rule_selection": (rule_selection, BASE + RULES),
    "cross_held": (cross_held, BASE + CROSS),
    "nested_priors": (nested_priors, None),
    "pairwise_logistic": (pairwise_logistic, None),
    "routed_arms": (routed_arms, None),
    "kmeans_choice": (kmeans_choice, None),
}
