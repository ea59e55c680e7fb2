"""Named queries over texts, events and the star schema, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import features, lexical, metrics, model, segment, select
from rankloom.plans.session import cut, spread
from rankloom.plans.vector_queries import r6
from rankloom.streaming import events as ev

WORD = r"[\p{L}\p{N}_]+"


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def docs(s, d):
    return spread(table(s, d, "documents"))


def questions(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _bm(s, d):
    return lexical.bm25(docs(s, d), questions(s, d), 10)


def _terms(s, d):
    """(qid, doc_id, q array, d array) of each item's ten best documents."""
    p = _bm(s, d).select("qid", "doc_id").join(questions(s, d), "qid").join(docs(s, d).select("doc_id", "text"), "doc_id")
    return p.select("qid", "doc_id", tx.tokens(F.col("question")).alias("q"), tx.tokens(F.col("text")).alias("d"))



def tok(x: str) -> str:
    return f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '{WORD}')"


BM = f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents), post AS (SELECT doc_id, len(t) AS dl, u AS term, count(*) AS tf FROM t, unnest(t) AS x(u) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, n), mean AS (SELECT avg(idf) AS m FROM raw), dl AS (SELECT avg(len(t)) AS avgdl FROM t),
q AS (SELECT item_id AS qid, u AS term, count(*) AS qf FROM benchmark, unnest({tok('text')}) AS x(u) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(CASE WHEN idf < 0 THEN 0.25::DOUBLE * m ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / avgdl)) * qf), 6) AS score FROM q JOIN post p USING (term) JOIN raw USING (term), mean, dl GROUP BY ALL),
bm AS (SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)
"""


def gold_text(s, d):
    """Documents that hold an item's whole text, of five words or more. The items are a stated query set: one automaton of
    all their texts goes over each document once; over 100,000 of them go in blocks."""
    q = questions(s, d).withColumn("w", F.size(tx.tokens(F.col("question"), False))).where("w >= 5").select("qid", "question")
    return lexical.holding(docs(s, d).select("doc_id", "text"), q)


def match_keys(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", F.md5(tx.fold(tx.compact(t))).alias("strict_key"), F.md5(tx.punctuation_key(t)).alias("punctuation_key"), F.md5(tx.accent_key(t)).alias("accent_key"))


CMP = "trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
FOLD = "replace(lower({x}), 'ß', 'ss')"
PUN = CMP.format(x="regexp_replace(" + FOLD.format(x="text") + ", '[\\p{P}\\p{S}]', ' ', 'g')")


def text_flags(s, d):
    f = tx.flags(F.col("text"))
    one = docs(s, d).agg(*(F.count_if(c).alias(k) for k, c in f.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(k).alias("n")) for k in f))).alias("x")).select("x.flag", "x.n")


def word_stats(s, d):
    x = docs(s, d).select("lang", tx.word_count(F.col("text")).cast("double").alias("n"))
    g = x.groupBy("lang").agg(F.min("n").alias("lo"), F.avg("n").alias("mean"), F.max("n").alias("hi"), F.percentile("n", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))).alias("p"))
    return r6(g.select("lang", "lo", "mean", "hi", *(F.col("p")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p95", "p99")))))


def archetypes(s, d):
    x = docs(s, d).select(tx.archetype(F.col("text")).alias("archetype")).groupBy("archetype").agg(F.count("*").alias("n"))
    return r6(x.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy())))


def exact_dup_groups(s, d):
    x = docs(s, d).groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("id_sum"))
    return x.where("n > 1")


def dup_expansion(s, d):
    """Each copy with its group's first document: links grow with the rows, not with the square of a group."""
    k = docs(s, d).select("doc_id", F.md5("text").alias("key"))
    first = k.groupBy("key").agg(F.min("doc_id").alias("twin_id"), F.count("*").alias("n")).where("n > 1")
    return k.join(first, "key").where("doc_id <> twin_id").select("doc_id", "twin_id")


def text_overlap(s, d):
    """Documents that share their first line with others, and how many have it; a frequent line makes no pairs."""
    left = docs(s, d).select("doc_id", F.lower("lang").alias("lang"), F.md5(F.split("text", "\n")[0]).alias("key"))
    right = left.groupBy("key").agg(F.count("*").alias("n_right"))
    return left.join(right, "key").where("n_right > 1").select(F.col("doc_id").alias("left_id"), "n_right")


def regions(s, d):
    return segment.line_regions(docs(s, d)).select("doc_id", "region", "start", "end", "kind", tx.word_count(F.col("line")).alias("n"))


RG = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS region FROM documents),
r AS (SELECT doc_id, region, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
rg AS (SELECT doc_id, region, start, (start + length(line))::BIGINT AS "end", CASE WHEN regexp_matches(line, '\\.$') THEN 'body' ELSE 'gap' END AS kind, len(regexp_extract_all(line, '{WORD}'))::BIGINT AS n FROM r)
"""


def region_stats(s, d):
    x = regions(s, d).groupBy("kind").agg(F.count("*").alias("regions"), F.sum("n").alias("words"), F.percentile(F.col("n").cast("double"), F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return r6(x.select("kind", "regions", "words", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95")))


def sizes(s, d):
    return docs(s, d).select("doc_id", tx.word_count(F.col("text")).alias("n"))


NW = f"WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n FROM documents)\n"


def over_budget(s, d):
    return sizes(s, d).agg(F.count("*").alias("docs"), *(F.count_if(F.col("n") > b).alias(f"over_{b}") for b in (128, 512, 1024)))


def char_pairs(s, d):
    """Lexical cosine of neighbouring benchmark items."""
    q = questions(s, d)
    w = lexical.char_tfidf(q, "qid", "question")
    pairs = q.select(F.col("qid").alias("a"), F.lead("qid").over(W.orderBy("qid")).alias("b")).where("b is not null")
    return r6(lexical.pair_cosine(w, pairs, "qid").withColumnRenamed("cosine", "lexical_cosine"))


def baskets(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


CG = """WITH i AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), n AS (SELECT count(DISTINCT basket)::DOUBLE AS n FROM i), fr AS (SELECT item, count(*) AS f FROM i GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM i x JOIN i y USING (basket) WHERE x.item < y.item GROUP BY ALL),
g AS (SELECT a, b, support, support / fa.f::DOUBLE AS cond, support / (fa.f + fb.f - support)::DOUBLE AS jaccard, ln(support * n / (fa.f * fb.f)) AS pmi FROM p JOIN fr fa ON a = fa.item JOIN fr fb ON b = fb.item, n)
"""


def colabel_score(s, d):
    g = features.colabel_graph(baskets(s, d))
    keys = baskets(s, d).distinct()
    a = keys.select(F.col("basket").alias("key"), "item", (F.row_number().over(W.partitionBy("basket").orderBy("item")) - 1).alias("i"))
    return r6(features.colabel_best(g, a))


def propensity(s, d):
    x = table(s, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_orderkey") % 5).alias("fold"), (F.col("l_returnflag") == "R").alias("positive"))
    return r6(features.propensity(x).withColumnRenamed("item", "part"))


def balance_report(s, d):
    x = docs(s, d).select("lang", (F.col("doc_id") % 5).alias("fold"))
    return r6(select.balance(x, "lang"))


def rare_strata(s, d):
    x = docs(s, d).select("lang", F.concat_ws("|", "lang", "source").alias("stratum0"))
    return select.rare_strata(x, "stratum0", "lang", 20).groupBy("stratum").agg(F.count("*").alias("n"))


def logistic_oof(s, d, trees=False):
    t = F.col("text")
    x = docs(s, d).join(table(s, d, "labels").where("quality is not null"), "doc_id")
    x = x.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("fold"), F.col("quality").alias("label"), tx.word_count(t).cast("double").alias("words"), F.char_length(t).cast("double").alias("chars"), F.regexp_count(t, F.lit("[|#*$%&]")).cast("double").alias("symbols"), F.regexp_count(t, F.lit("\n")).cast("double").alias("lines"))
    return model.logistic_oof(x, ["words", "chars", "symbols", "lines"], trees=trees).select(F.col("id").alias("doc_id"), "fold", F.round("score", 6).alias("score"))


def _date(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def event_windows(s, d):
    x = ev.tumbling(table(s, d, "events"), "1 day")
    return x.select(_date("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(s, d):
    x = ev.sessions(table(s, d, "events"), "6 hours")
    return x.select("user_id", _date("session_start").alias("session_start"), "n")


def asof_prev(s, d):
    """Each event with the value of its user's previous event of any kind: an as-of join as a window."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.lag("value").over(w).alias("prev_value"))


def manifest_tables(s, d):
    """Row count and key sum per table, the content check of a snapshot."""
    keys = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
    out = None
    for t, k in keys.items():
        x = table(s, d, t).agg(F.count("*").alias("n"), F.sum(k).alias("key_sum")).withColumn("name", F.lit(t))
        out = x if out is None else out.unionByName(x)
    return out.select("name", "n", "key_sum")


def length_buckets(s, d):
    """Documents by word count: short, mid and long, cut at the floors of the thirds of all counts."""
    x = sizes(s, d)
    cut_at = x.agg(F.percentile(F.col("n").cast("double"), F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("p"))
    x = x.crossJoin(F.broadcast(cut_at))
    b = F.when(F.col("n") <= F.floor(F.col("p")[0]), "short").when(F.col("n") <= F.floor(F.col("p")[1]), "mid").otherwise("long")
    return x.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def passage_select(s, d):
    return r6(segment.best_passages(_terms(s, d), 60, 40).select("qid", "doc_id", "start", "density"))


QUERIES: dict = {
    "bm25_topk": (_bm, BM + "SELECT * FROM bm"),
    "gold_text": (gold_text, f"SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(regexp_extract_all(b.text, '{WORD}')) >= 5"),
    "bm25_recall_curve": (lambda s, d: r6(metrics.curve(_bm(s, d), gold_text(s, d), (1, 5, 10))), BM + ", gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), k AS (SELECT unnest([1, 5, 10])::BIGINT AS k), h AS (SELECT k, gold.qid, count(*) AS n, count(*) FILTER (rank <= k) AS h FROM gold CROSS JOIN k LEFT JOIN bm USING (qid, doc_id) GROUP BY ALL) SELECT k, round(avg(h / n::DOUBLE), 6) AS macro_recall, round(avg((h = n)::INT), 6) AS full_coverage, round(sum(h) / sum(n)::DOUBLE, 6) AS micro_recall FROM h GROUP BY k"),
    "match_keys": (match_keys, "SELECT doc_id, md5(" + FOLD.format(x=CMP.format(x="text")) + ") AS strict_key, md5(" + PUN + ") AS punctuation_key, md5(trim(regexp_replace(strip_accents(replace(" + PUN + ", 'đ', 'd')), ' +', ' ', 'g'))) AS accent_key FROM documents"),
    "model_text_lengths": (lambda s, d: docs(s, d).select("doc_id", F.char_length(tx.model_text("text")).cast("long").alias("n")), "SELECT doc_id, length(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS n FROM documents"),
    "nfkc_keys": (lambda s, d: docs(s, d).select("doc_id", F.md5(tx.strict_key("text")).alias("strict_key"), F.md5(tx.nfkc_key("text")).alias("punctuation_key"), F.md5(tx.accent_key("text")).alias("accent_key")), None),
    "text_flags": (text_flags, "SELECT unnest(['replacement', 'nul', 'control', 'not_nfc', 'edge_space', 'double_space', 'html_like']) AS flag, unnest([count(*) FILTER (contains(text, chr(65533))), count(*) FILTER (contains(text, chr(0))), count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]')), count(*) FILTER (nfc_normalize(text) <> text), count(*) FILTER (regexp_matches(text, '^\\s|\\s$')), count(*) FILTER (regexp_matches(text, '\\s\\s')), count(*) FILTER (regexp_matches(text, '<[^>]{1,120}>'))]) AS n FROM documents"),
    "word_stats": (word_stats, NW.replace("doc_id, len", "lang, len") + "SELECT lang, min(n)::DOUBLE AS lo, round(avg(n), 6) AS mean, max(n)::DOUBLE AS hi, " + ", ".join(f"round(quantile_cont(n::DOUBLE, {q}), 6) AS {a}" for q, a in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))) + " FROM w GROUP BY lang"),
    "rule_classes": (archetypes, "WITH a AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in tx.ARCHETYPES) + " ELSE 'GENERAL' END AS archetype FROM documents) SELECT archetype, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS fraction FROM a GROUP BY archetype"),
    "exact_dup_groups": (exact_dup_groups, "SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "dup_expansion": (dup_expansion, "SELECT doc_id, twin_id FROM documents JOIN (SELECT text, min(doc_id) AS twin_id FROM documents GROUP BY text) USING (text) WHERE doc_id <> twin_id"),
    "text_overlap": (text_overlap, "WITH k AS (SELECT doc_id, string_split(text, chr(10))[1] AS k FROM documents) SELECT doc_id AS left_id, n_right FROM k JOIN (SELECT k, count(*) AS n_right FROM k GROUP BY k) USING (k) WHERE n_right > 1"),
    "line_regions": (lambda s, d: regions(s, d).drop("n"), RG + 'SELECT doc_id, region, start, "end", kind FROM rg'),
    "region_stats": (region_stats, RG + "SELECT kind, count(*) AS regions, sum(n)::BIGINT AS words, round(quantile_cont(n::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95 FROM rg GROUP BY kind"),
    "split_tokens": (lambda s, d: segment.atomic_split(sizes(s, d), 128).select("doc_id", "piece", "n_tokens"), NW + ", p AS (SELECT doc_id, n, unnest(generate_series(0, greatest(1, ceil(n / 128.0))::BIGINT - 1)) AS piece FROM w) SELECT doc_id, piece, least(128, n - piece * 128) AS n_tokens FROM p"),
    "greedy_pack": (lambda s, d: segment.coarse_pack(regions(s, d).where("n > 0"), 64), RG + """, z AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY region) AS k FROM rg WHERE n > 0),
st AS (WITH RECURSIVE f AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS fill, []::BIGINT[] AS out FROM (SELECT DISTINCT doc_id FROM z)
 UNION ALL SELECT f.doc_id, z.k, CASE WHEN z.n > 64 THEN 0 WHEN fill + z.n > 64 THEN z.n ELSE fill + z.n END, CASE WHEN z.n > 64 THEN (CASE WHEN fill > 0 THEN [fill] ELSE [] END) || list_transform(range(z.n // 64), lambda i: 64::BIGINT) || (CASE WHEN z.n % 64 > 0 THEN [z.n % 64] ELSE [] END) WHEN fill + z.n > 64 AND fill > 0 THEN [fill] ELSE [] END
 FROM f JOIN z ON z.doc_id = f.doc_id AND z.k = f.k + 1) SELECT * FROM f),
o AS (SELECT doc_id, k, unnest(out) AS n, unnest(generate_series(1, len(out))) AS j FROM st UNION ALL SELECT doc_id, k + 1, fill, 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM st) WHERE r = 1 AND fill > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pack, n AS n_tokens FROM o"""),
    "truncate_coverage": (lambda s, d: r6(segment.packing_plan(sizes(s, d), [64, 128, 512])), NW + "SELECT budget::BIGINT AS budget, count(*) AS vectors, round(sum(least(n, budget)) / sum(n)::DOUBLE, 6) AS coverage FROM w, unnest([64, 128, 512]) AS x(budget) GROUP BY budget"),
    "token_windows": (lambda s, d: segment.token_windows(sizes(s, d), 220, 150).select("doc_id", "start", "size"), NW + ", p AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - 220) / 150.0))::BIGINT)) * 150 AS start FROM w WHERE n > 0) SELECT doc_id, start, least(220, n - start) AS size FROM p"),
    "over_budget_audit": (over_budget, NW + "SELECT count(*) AS docs, " + ", ".join(f"count(*) FILTER (n > {b}) AS over_{b}" for b in (128, 512, 1024)) + " FROM w"),
    "length_buckets": (length_buckets, NW + ", c AS (SELECT floor(quantile_cont(n::DOUBLE, 1 / 3.0::DOUBLE)) AS a, floor(quantile_cont(n::DOUBLE, 2 / 3.0::DOUBLE)) AS b FROM w) SELECT CASE WHEN n <= a THEN 'short' WHEN n <= b THEN 'mid' ELSE 'long' END AS bucket, count(*) AS n FROM w, c GROUP BY 1"),
    "passage_select": (passage_select, BM + f", pt AS (SELECT qid, doc_id, {tok('b.text')} AS q, {tok('d.text')} AS d FROM bm JOIN benchmark b ON qid = item_id JOIN documents d USING (doc_id)), pw AS (SELECT qid, doc_id, q, d, unnest(generate_series(0, greatest(0, ceil((len(d) - 60) / 40.0))::BIGINT)) * 40 AS start FROM pt), pd AS (SELECT qid, doc_id, start, len(list_intersect(list_distinct(d[start + 1:start + 60]), list_distinct(q))) / sqrt(len(d[start + 1:start + 60])) AS density FROM pw) SELECT qid, doc_id, start, round(density, 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY density DESC, start) AS k FROM pd) WHERE k <= 2"),
    "char_tfidf_pairs": (char_pairs, f"""WITH w AS (SELECT item_id AS id, ' ' || u || ' ' AS w FROM benchmark, unnest(string_split_regex({FOLD.format(x='text')}, '\\s+')) AS x(u) WHERE u <> ''),
g AS (SELECT id, substr(w, i, n) AS gram FROM (SELECT id, w, n, unnest(generate_series(1, length(w) - n + 1)) AS i FROM w, (VALUES (3), (4), (5)) AS v(n) WHERE n <= length(w))), tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM benchmark),
v AS (SELECT id, gram, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM tf JOIN df USING (gram), n), u AS (SELECT id, gram, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM v), p AS (SELECT item_id AS a, lead(item_id) OVER (ORDER BY item_id) AS b FROM benchmark)
SELECT a, b, round(coalesce(sum(x.v * y.v), 0), 6) AS lexical_cosine FROM p LEFT JOIN u x ON x.id = a LEFT JOIN u y ON y.id = b AND y.gram = x.gram WHERE b IS NOT NULL GROUP BY a, b"""),
    "colabel_graph": (lambda s, d: r6(features.colabel_graph(baskets(s, d))), CG + "SELECT a, b, support, round(cond, 6) AS cond, round(jaccard, 6) AS jaccard, round(pmi, 6) AS pmi FROM g"),
    "colabel_score": (colabel_score, CG + ", k AS (SELECT basket AS key, item, row_number() OVER (PARTITION BY basket ORDER BY item) - 1 AS i FROM i), ed AS (SELECT a AS item, b AS other, support, jaccard, pmi, cond FROM g WHERE support >= 2 UNION ALL SELECT b, a, support, jaccard, pmi, cond FROM g WHERE support >= 2), s AS (SELECT key, other, max(round(sqrt(cond * jaccard) * ln(1 + support) * (1 + greatest(pmi, 0) / 10) / (1 + 0.25::DOUBLE * i), 9)) AS score FROM k JOIN ed USING (item) WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.key = k.key AND o.item = ed.other) GROUP BY ALL) SELECT key, other AS best, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, other) AS r FROM s) WHERE r = 1"),
    "propensity": (propensity, "WITH p AS (SELECT l_partkey AS part, l_orderkey % 5 AS fold, count(*) AS e, count(*) FILTER (l_returnflag = 'R') AS g FROM lineitem GROUP BY ALL), t AS (SELECT part, fold, sum(e) OVER w - e AS e, sum(g) OVER w - g AS g FROM p WINDOW w AS (PARTITION BY part)) SELECT part, fold, round(ln(1 + g), 6) AS log_freq, round(ln((g + 0.5::DOUBLE) / (e + 10)), 6) AS log_rate FROM t"),
    "balance_report": (balance_report, "WITH c AS (SELECT doc_id % 5 AS fold, lang, count(*) AS c FROM documents GROUP BY ALL), f AS (SELECT fold, sum(c) AS nf FROM c GROUP BY fold), a AS (SELECT lang, sum(c) AS ca, sum(sum(c)) OVER () AS n FROM c GROUP BY lang) SELECT fold, round(max(abs(coalesce(c, 0) / nf::DOUBLE - ca / n::DOUBLE)), 6) AS max_dev FROM f CROSS JOIN a LEFT JOIN c USING (fold, lang) GROUP BY fold"),
    "rare_strata": (rare_strata, "WITH x AS (SELECT lang, lang || '|' || source AS s, count(*) OVER (PARTITION BY lang, source) AS n FROM documents), y AS (SELECT lang, CASE WHEN n < 20 THEN lang || '|rare' ELSE s END AS s FROM x), m AS (SELECT min(c) AS low FROM (SELECT count(*) AS c FROM y GROUP BY s)) SELECT CASE WHEN low < 20 THEN lang ELSE s END AS stratum, count(*) AS n FROM y, m GROUP BY 1"),
    "logistic_oof": (logistic_oof, None),
    "boosted_oof": (lambda s, d: logistic_oof(s, d, True), None),
    "kmeans_profile": (lambda s, d: model.kmeans_profile(table(s, d, "embeddings")), None),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "event_sessions": (event_sessions, "WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k"),
    "event_previous": (asof_prev, "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events"),
    "snapshot_counts": (manifest_tables, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, sum({k})::BIGINT AS key_sum FROM {t}" for t, k in (("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"), ("benchmark", "item_id")))),
    "stable_hashes": (lambda s, d: table(s, d, "region").select("r_regionkey", tx.stable_hash("r_name", "r_regionkey").alias("h")), "SELECT r_regionkey, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS h FROM region"),
}
