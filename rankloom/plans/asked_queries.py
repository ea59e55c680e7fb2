"""Named queries over questions, titles and passages: classes, features, audits and ranges, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import legal
from rankloom.functions import text as tx
from rankloom.operators import features, select, segment
from rankloom.plans.evidence_queries import KEY, _plain
from rankloom.plans.session import cut
from rankloom.plans.text_queries import BM, CG, CMP, FOLD, PUN, RG, WORD, _bm, _date, _terms, baskets, docs, gold_text, questions, regions, sizes, table, tok
from rankloom.plans.vector_queries import r6
from rankloom.sources import io
from rankloom.streaming import events as ev

# The tables hold no questions in the language of the rules: a phrase is put before each text by its id.
_ASKED = [
    "Theo Điều 5 khoản 2 luật đất đai năm 2013, nội dung là gì? ", "mức phạt tiền bao nhiêu khi vi phạm? ", "thủ tục đăng ký và hồ sơ cấp phép? ", "điều kiện nào để được phép? ",
    "khái niệm này được hiểu là gì? ", "thời hạn tối đa là bao lâu? ", "ai được hưởng và ai phải nộp thay? ", "căn cứ nghị định 10/2020/NĐ-CP và thông tư ", "nếu không có thì làm sao ", "bộ luật dân sự ", "Điểm a Khoản 3 ", "theo quy định tại điều 7 ", "",
]


def _put(df: DataFrame, key: str, column: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col(key) % len(_ASKED) + 1).cast("int"))
    return df.withColumn(column, F.concat(head, column))


def asked(s, d) -> DataFrame:
    return _put(docs(s, d).select("doc_id", "text"), "doc_id", "text")


def _list(key: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in _ASKED) + f"][1 + {key} % {len(_ASKED)}]"


ASKED = f"WITH c AS (SELECT doc_id, {_list('doc_id')} || text AS text FROM documents)"


def _any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def _is(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{_plain(p)}')"


def archetypes(s, d):
    """Questions by class: how many, their share and mean words and characters."""
    x = asked(s, d).select(legal.archetype(F.col("text")).alias("archetype"), tx.word_count(F.col("text")).alias("w"), F.char_length("text").alias("c"))
    x = x.groupBy("archetype").agg(F.count("*").alias("n"), F.avg("w").alias("mean_words"), F.avg("c").alias("mean_chars"))
    return r6(x.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy())))  # one row a class


_LOCATED = "(" + " OR ".join(_is("text", p) for p in legal.LOCATORS.values()) + ")"
ARCHETYPES = ASKED + ", a AS (SELECT text, CASE WHEN " + _LOCATED + f" AND ({_is('text', legal.DIRECT_CUE)} OR len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) <= {legal.DIRECT_WORDS}) THEN 'DIRECT_REF' " + " ".join(f"WHEN {_is('text', p)} THEN '{k}'" for k, p in legal.ARCHETYPES) + f" WHEN {_is('text', legal.CUES['has_cross_reference'])} AND (" + " OR ".join(_is("text", legal.instrument_pattern(k)) for k in legal.INSTRUMENTS) + f") THEN 'CROSS_REFERENCE' ELSE 'GENERAL_SEMANTIC' END AS archetype FROM c) SELECT archetype, count(*) AS n, round(avg(len(regexp_extract_all(text, '{WORD}'))), 6) AS mean_words, round(avg(length(text)), 6) AS mean_chars, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS fraction FROM a GROUP BY archetype"


def scored_archetypes(s, d):
    """Each question's class among the scored population and its seven cues."""
    x = asked(s, d).select("doc_id", F.lower(tx.compact(F.col("text"))).alias("t"))
    return x.select("doc_id", legal.scored_archetype(F.col("t")).alias("archetype"), *(c.alias(k.lower()) for k, c in legal.scored_cues(F.col("t")).items()))


_L = {k: _is("t", p) for k, p in legal.SCORED_LOCATORS.items()}
_ANY_L = "(" + " OR ".join(_L.values()) + ")"
_P = {k: _any("t", v) for k, v in legal.SCORED_PHRASES.items()}
SCORED = ASKED + f", n AS (SELECT doc_id, lower({CMP.format(x='text')}) AS t FROM c) SELECT doc_id, CASE " + " ".join(f"WHEN {_P[k]} THEN '{k}'" for k in ("SANCTION", "DEFINITION", "PROCEDURE", "CONDITION")) + f" WHEN {_P['CROSSREF']} AND {_ANY_L} THEN 'CROSS_REFERENCE' WHEN {_ANY_L} OR {_P['INSTRUMENT']} THEN 'DIRECT_REF' ELSE 'GENERAL_SEMANTIC' END AS archetype, " + ", ".join(f"{x} AS {k.lower()}" for k, x in (_L | {k: _P[k] for k in ("INSTRUMENT", "CROSSREF", "NEGATION", "HYPOTHETICAL")}).items()) + " FROM n"


def query_features(s, d):
    x = asked(s, d).select("doc_id", legal.title_key(F.col("text")).alias("t"))
    return r6(x.select("doc_id", *(c.alias(k) for k, c in legal.query_features(F.col("t")).items())))


_QF = {k.lower(): x for k, x in _L.items()} | {"year": _is("t", legal.YEAR), "negation": _P["NEGATION"], "hypothetical": _P["HYPOTHETICAL"]} | {k: _any("t", p) for k, p in legal.QUERY_CUES.items()}
QUERY_FEATURES = ASKED + f", n AS (SELECT doc_id, {KEY} AS t FROM c) SELECT doc_id, round(least(len(regexp_extract_all(t, '{WORD}')), 60) / 60.0::DOUBLE, 6) AS words, round(least(length(t), 300) / 300.0::DOUBLE, 6) AS chars, " + ", ".join(f"({x})::INT::DOUBLE AS {k}" for k, x in _QF.items()) + " FROM n"


def _titled(df: DataFrame, *keep) -> DataFrame:
    """keep, the tokens in order and the sets of numbers, years and instruments of the column k."""
    k = F.col("k")
    every = lambda p: F.array_distinct(F.regexp_extract_all(k, F.lit(p), 0))
    return df.select(*keep, F.regexp_extract_all(k, F.lit(WORD), 0).alias("t"), every(r"\d+").alias("nums"), every(r"(?<![\p{L}\p{N}_])(?:19|20)\d{2}(?![\p{L}\p{N}_])").alias("years"), legal.instrument_types(k).alias("kinds"))


def title_features(s, d):
    """Titles are the documents' first lines with a phrase before them, questions the items with one."""
    titles = _put(docs(s, d).select("doc_id", F.split("text", "\n")[0].alias("k")), "doc_id", "k").withColumn("k", legal.title_key(F.col("k")))
    ask = _put(questions(s, d), "qid", "question").select("qid", legal.title_key(F.col("question")).alias("k"))
    pairs = _bm(s, d).select("qid", "doc_id", F.col("rank").alias("pos")).join(ask, "qid")
    return r6(features.title_features(_titled(pairs, "qid", "doc_id", "pos"), _titled(titles, "doc_id")))


_T = "regexp_extract_all(k, '{w}') AS t, list_distinct(regexp_extract_all(k, '\\d+')) AS nums, list_distinct(list_filter(regexp_extract_all(k, '{w}'), lambda x: regexp_full_match(x, '(19|20)\\d\\d'))) AS years, list_filter([{kinds}], lambda x: x IS NOT NULL) AS kinds".format(w=WORD, kinds=", ".join(f"CASE WHEN contains(k, '{a}') OR contains(k, '{b}') THEN '{n}' END" for n, (a, b) in legal.INSTRUMENTS.items()))
_BI = "list_distinct(list_transform(range(1, len({t})::BIGINT), lambda i: {t}[i] || ' ' || {t}[i + 1]))"
TITLES = BM + f""", tk AS (SELECT doc_id, {KEY.replace('text', 'x')} AS k FROM (SELECT doc_id, {_list('doc_id')} || string_split(text, chr(10))[1] AS x FROM documents)), tt AS (SELECT doc_id, {_T} FROM tk),
qk AS (SELECT qid, {KEY.replace('text', 'x')} AS k FROM (SELECT item_id AS qid, {_list('item_id')} || text AS x FROM benchmark)), qq AS (SELECT qid, {_T} FROM qk),
tn AS (SELECT count(*) AS c FROM tt), ti AS (SELECT u AS term, ln((c + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct(t)) AS u FROM tt), tn GROUP BY u, c),
iq AS (SELECT qid, sum(coalesce(idf, 1)) AS s FROM (SELECT qid, unnest(list_distinct(t)) AS u FROM qq) LEFT JOIN ti ON term = u GROUP BY qid),
pr AS (SELECT bm.qid, doc_id, rank AS pos, list_distinct(qq.t) AS q, list_distinct(tt.t) AS w, list_intersect(list_distinct(qq.t), list_distinct(tt.t)) AS x, len(list_intersect(qq.nums, tt.nums)) AS numbers, len(list_intersect(qq.years, tt.years)) AS years, len(list_intersect(qq.kinds, tt.kinds)) > 0 AS instrument,
  len(list_intersect({_BI.format(t='qq.t')}, {_BI.format(t='tt.t')})) / greatest(1, len({_BI.format(t='qq.t')}))::DOUBLE AS bigram_coverage FROM bm JOIN qq USING (qid) JOIN tt USING (doc_id)),
io AS (SELECT qid, doc_id, sum(idf) AS s FROM (SELECT qid, doc_id, unnest(x) AS u FROM pr) JOIN ti ON term = u GROUP BY ALL), al AS (SELECT pr.*, coalesce(io.s, 0) AS o, coalesce(io.s, 0) / coalesce(iq.s, 1) AS ra FROM pr LEFT JOIN io USING (qid, doc_id) LEFT JOIN iq USING (qid))
SELECT qid, doc_id, len(x) AS overlap, round(o, 6) AS idf_overlap, round(ra, 6) AS idf_ratio, round(len(x) / greatest(1, len(q))::DOUBLE, 6) AS query_coverage, round(len(x) / greatest(1, len(w))::DOUBLE, 6) AS title_coverage, round(len(x) / greatest(1, len(q) + len(w) - len(x))::DOUBLE, 6) AS jaccard, numbers, years, instrument, round(bigram_coverage, 6) AS bigram_coverage,
 round((ra - avg(ra) OVER v) / CASE WHEN stddev_pop(ra) OVER v < 1e-8 THEN 1 ELSE stddev_pop(ra) OVER v END, 6) AS idf_z, round(row_number() OVER (PARTITION BY qid ORDER BY round(ra, 9) DESC, pos) / 30.0::DOUBLE, 6) AS title_rank FROM al WINDOW v AS (PARTITION BY qid)"""


def top_passages(s, d):
    p = _bm(s, d).select("qid", "doc_id").join(questions(s, d), "qid").join(docs(s, d).select("doc_id", "text"), "doc_id")
    x = segment.top_passages(p, legal.STOPWORDS, width=60, overlap=20, header=15)
    return x.select("qid", "doc_id", "nth", F.md5("passage").alias("passage"))


_STOP = "[" + ", ".join(f"'{w}'" for w in legal.STOPWORDS) + "]"
PASSAGES = BM + f""", pt AS (SELECT qid, doc_id, regexp_extract_all(lower(b.text), '{WORD}') AS t, list_filter(string_split_regex(d.text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM bm JOIN benchmark b ON qid = item_id JOIN documents d USING (doc_id)),
ps AS (SELECT qid, doc_id, w, list_filter(list_distinct(t), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)) AS c, list_filter(list_distinct(t), lambda x: regexp_matches(x, '\\d')) AS m, {_BI.format(t='t')} AS two FROM pt),
pw AS (SELECT *, unnest(generate_series(0, greatest(0, ceil((len(w) - 60) / 40.0))::BIGINT)) * 40 AS start FROM ps WHERE len(w) > 140),
pk AS (SELECT *, regexp_extract_all(lower(array_to_string(w[start + 1:start + 60], ' ')), '{WORD}') AS k FROM pw),
pd AS (SELECT qid, doc_id, w, start, len(k) AS n, coalesce(list_sum(list_transform(list_filter(c, lambda y: list_contains(k, y)), lambda y: 1 + 0.2::DOUBLE * least(len(list_filter(k, lambda v: v = y)), 3))), 0) + 3 * len(list_filter(m, lambda y: list_contains(k, y))) + 1.8::DOUBLE * len(list_filter(two, lambda y: contains(array_to_string(k, ' '), y))) AS raw FROM pk),
po AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(-raw / sqrt(greatest(1, n)), 9), round(-raw, 9), start) AS r, CASE WHEN start < 15 THEN '' ELSE array_to_string(w[1:15], ' ') || chr(10) || '[ĐOẠN PHÙ HỢP]' || chr(10) END || array_to_string(w[start + 1:start + 60], ' ') AS passage FROM pd),
pu AS (SELECT qid, doc_id, passage, min(r) AS r FROM po GROUP BY ALL)
SELECT qid, doc_id, nth, md5(passage) AS passage FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY r) AS nth FROM pu) WHERE nth <= 2 UNION ALL SELECT qid, doc_id, 1, md5(array_to_string(w, ' ')) FROM ps WHERE len(w) <= 140"""


def window_dedup(s, d):
    """Windows of 60 tokens at strides 40 and 20 over each pair's document: how many in all, and each once in order."""
    cut_ = lambda n: F.transform(segment.window_starts(F.size("d"), 60, n), lambda i: F.array_join(F.slice("d", (i + 1).cast("int"), 60), " "))
    x = _terms(s, d).where(F.size("d") > 0)
    one = segment.distinct_windows([cut_(40), cut_(20)])
    return x.select("qid", "doc_id", (F.size(cut_(40)) + F.size(cut_(20))).cast("long").alias("windows"), F.size(one).cast("long").alias("distinct_windows"), F.md5(F.array_join(one, "|")).alias("order_key"))


_WD = "SELECT qid, doc_id, {k} AS fam, start, array_to_string(d[start + 1:start + 60], ' ') AS x FROM (SELECT qid, doc_id, d, unnest(generate_series(0, greatest(0, ceil((len(d) - 60) / {st}.0))::BIGINT)) * {st} AS start FROM pt WHERE len(d) > 0)"
DEDUP = BM + f", pt AS (SELECT qid, doc_id, {tok('d.text')} AS d FROM bm JOIN documents d USING (doc_id)), wd AS ({_WD.format(k=0, st=40)} UNION ALL {_WD.format(k=1, st=20)}), on1 AS (SELECT qid, doc_id, x, min((fam, start)) AS o FROM wd GROUP BY ALL) SELECT qid, doc_id, (SELECT count(*) FROM wd WHERE wd.qid = o.qid AND wd.doc_id = o.doc_id) AS windows, count(*) AS distinct_windows, md5(string_agg(x, '|' ORDER BY o)) AS order_key FROM on1 o GROUP BY qid, doc_id"


def over_budget_gold(s, d):
    """For each budget: gold documents of the items and their occurrences over it, and items with any and with all gold over."""
    g = cut(gold_text(s, d).join(sizes(s, d), "doc_id"))
    over = lambda b: F.count_if(F.col("n") > b)
    budgets = (128, 512, 1024)
    per = g.groupBy("qid").agg(F.count("*").alias("m"), *(over(b).alias(f"o{b}") for b in budgets))
    a = per.agg(*(F.sum(f"o{b}").alias(f"o{b}") for b in budgets), *(F.count_if(F.col(f"o{b}") > 0).alias(f"any{b}") for b in budgets), *(F.count_if(F.col(f"o{b}") == F.col("m")).alias(f"all{b}") for b in budgets))
    u = g.select("doc_id", "n").distinct().agg(F.count("*").alias("gold_docs"), *(over(b).alias(f"u{b}") for b in budgets))
    rows = F.explode(F.array(*(F.struct(F.lit(b).cast("long").alias("budget"), F.col(f"u{b}").alias("gold_over"), F.col(f"o{b}").alias("occurrences_over"), F.col(f"any{b}").alias("any_q"), F.col(f"all{b}").alias("all_q")) for b in budgets))).alias("x")
    return a.crossJoin(u).select("gold_docs", rows).select("gold_docs", "x.*")  # one row each


GOLD = f", gd AS (SELECT item_id AS qid, doc_id, len(regexp_extract_all(d.text, '{WORD}')) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(regexp_extract_all(b.text, '{WORD}')) >= 5)"
OVER = "WITH bu AS (SELECT unnest([128, 512, 1024])::BIGINT AS b)" + GOLD + ", pq AS (SELECT b, qid, count(*) AS m, count(*) FILTER (n > b) AS o FROM gd, bu GROUP BY ALL), un AS (SELECT DISTINCT doc_id, n FROM gd) SELECT (SELECT count(*) FROM un) AS gold_docs, b AS budget, (SELECT count(*) FROM un WHERE n > b) AS gold_over, sum(o)::BIGINT AS occurrences_over, count(*) FILTER (o > 0) AS any_q, count(*) FILTER (o = m) AS all_q FROM pq GROUP BY b"


def token_counts(s, d):
    """Tokens of each document under a public vocabulary, and which budgets they exceed."""
    import public_tokenizers

    x = segment.token_counts(docs(s, d), public_tokenizers.path("word_bpe_49k.json"))
    return x.select("doc_id", "n_tokens", *((F.col("n_tokens") > b).alias(f"over_{b}") for b in (512, 1024, 2048, 4096)))


def region_top30(s, d):
    """The 30 documents of most regions, with their characters."""
    x = regions(s, d).groupBy("doc_id").agg(F.count("*").alias("regions"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum("n").alias("words"))
    return x.orderBy(F.desc("regions"), "doc_id").limit(30)


def region_spread(s, d):
    """Quantiles of regions per document and of characters per region."""
    x = cut(regions(s, d).select("doc_id", (F.col("end") - F.col("start")).cast("double").alias("chars")))
    per = x.groupBy("doc_id").agg(F.count("*").cast("double").alias("v"))
    q = F.array(*map(F.lit, (0.5, 0.95, 0.99)))
    one = lambda y, name: y.agg(F.lit(name).alias("what"), F.min("v").alias("low"), F.avg("v").alias("mean"), F.max("v").alias("high"), F.percentile("v", q).alias("p")).select("what", "low", "mean", "high", *(F.col("p")[i].alias(k) for i, k in enumerate(("p50", "p95", "p99"))))
    return r6(one(per, "regions").unionByName(one(x.select(F.col("chars").alias("v")), "chars")))


_SP = "SELECT '{k}' AS what, min(v)::DOUBLE AS low, round(avg(v), 6) AS mean, max(v)::DOUBLE AS high, " + ", ".join(f"round(quantile_cont(v::DOUBLE, {q}), 6) AS {k}" for q, k in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
SPREAD = RG + _SP.format(k="regions") + " FROM (SELECT count(*) AS v FROM rg GROUP BY doc_id) UNION ALL " + _SP.format(k="chars") + ' FROM (SELECT "end" - start AS v FROM rg)'


def offset_regions(s, d):
    """The region that holds each document's middle character."""
    t = docs(s, d).select("doc_id", F.floor(F.char_length("text") / 2).alias("x"))
    return segment.locate(t, regions(s, d).select("doc_id", "region", "start", "end"))


# The largest deviations of a good split.
LIMITS, SIZE_LIMIT = {"lang": 0.006, "source": 0.012, "length": 0.015}, 0.012


def fold_gates(s, d):
    """Whether folds by id are balanced in size, language, source and length and keep equal texts together."""
    n = tx.word_count(F.col("text"))
    x = docs(s, d).select((F.col("doc_id") % 5).alias("fold"), "lang", "source", F.when(n < 100, "short").when(n < 400, "mid").otherwise("long").alias("length"), F.md5("text").alias("k"))
    return r6(select.balance_gates(cut(x), LIMITS, SIZE_LIMIT, "k"))


_GATE = "SELECT '{c}' AS gate, max(abs(coalesce(c.n, 0) / f.n::DOUBLE - a.n / (SELECT count(*) FROM x)::DOUBLE)) AS deviation, {b}::DOUBLE AS bound FROM (SELECT fold, count(*) AS n FROM x GROUP BY fold) f CROSS JOIN (SELECT {c} AS v, count(*) AS n FROM x GROUP BY 1) a LEFT JOIN (SELECT fold, {c} AS v, count(*) AS n FROM x GROUP BY ALL) c ON c.fold = f.fold AND c.v = a.v"
GATES = f"WITH t AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) AS w FROM documents), x AS (SELECT doc_id % 5 AS fold, lang, source, CASE WHEN w < 100 THEN 'short' WHEN w < 400 THEN 'mid' ELSE 'long' END AS length, md5(text) AS k FROM t), g AS (SELECT 'size' AS gate, max(abs(n - m) / m) AS deviation, {SIZE_LIMIT}::DOUBLE AS bound FROM (SELECT fold, count(*) AS n, (SELECT count(*) / 5.0::DOUBLE FROM x) AS m FROM x GROUP BY fold) UNION ALL " + " UNION ALL ".join(_GATE.format(c=c, b=b) for c, b in LIMITS.items()) + " UNION ALL SELECT 'isolation', count(*)::DOUBLE, 0::DOUBLE FROM (SELECT k FROM x GROUP BY k HAVING count(DISTINCT fold) > 1)) SELECT gate, round(deviation, 6) AS deviation, bound, round(deviation, 9) <= bound AS passed FROM g"


REFERENCES = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id")]


def referential_check(s, d):
    """Rows of each child table whose key is not in its parent."""
    one = [select.dangling(table(s, d, c).select(F.col(k).alias("k")), table(s, d, p).select(F.col(q).alias("k")), "k").select(F.lit(f"{c}.{k}").alias("child"), "rows", "dangling") for c, k, p, q in REFERENCES]
    return reduce(DataFrame.unionByName, one)


def dataset_audit(s, d):
    """Issues of the documents as questions, null and other answers (the labels' quality), and repeats by three keys."""
    t = F.col("text")
    x = docs(s, d).select("doc_id", "text").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = tx.word_count(t)
    issues = {"empty": F.trim(t) == "", "le_2_words": n <= 2, "ge_80_words": n >= 80} | tx.flags(t)
    one = x.agg(F.count("*").alias("rows"), F.count_if(F.col("quality").isNull()).alias("null_answers"), F.count("quality").alias("answers"), *(F.count_if(c).alias(f"issue_{k}") for k, c in issues.items()))
    keys = {"strict": F.md5(tx.fold(tx.compact(t))), "punctuation": F.md5(tx.punctuation_key(t)), "accent": F.md5(tx.accent_key(t))}
    k = cut(x.select(*(c.alias(a) for a, c in keys.items())))
    groups = [k.groupBy(a).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias(f"repeats_{a}")) for a in keys]
    for g in groups:
        one = one.crossJoin(g)  # one row each
    return one


_ACC = "trim(regexp_replace(strip_accents(replace(" + PUN + ", 'đ', 'd')), ' +', ' ', 'g'))"
_ISSUES = {"empty": "trim(text) = ''", "le_2_words": "n <= 2", "ge_80_words": "n >= 80", "replacement": "contains(text, chr(65533))", "nul": "contains(text, chr(0))", "control": r"regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')", "not_nfc": "nfc_normalize(text) <> text", "edge_space": r"regexp_matches(text, '^\s|\s$')", "double_space": r"regexp_matches(text, '\s\s')", "html_like": "regexp_matches(text, '<[^>]{1,120}>')"}
AUDIT = f"WITH x AS (SELECT text, len(regexp_extract_all(text, '{WORD}')) AS n, quality FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT {FOLD.format(x=CMP.format(x='text'))} AS a, {PUN} AS b, {_ACC} AS c FROM x) SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS null_answers, count(quality) AS answers, " + ", ".join(f"count(*) FILTER ({c}) AS issue_{k}" for k, c in _ISSUES.items()) + ", " + ", ".join(f"(SELECT count(*) FROM (SELECT {c} FROM k GROUP BY {c} HAVING count(*) > 1)) AS repeats_{n}" for c, n in (("a", "strict"), ("b", "punctuation"), ("c", "accent"))) + " FROM x"


def colabel_modes(s, d):
    """Each basket's best co-labelled item by conditional share and by Jaccard."""
    a = baskets(s, d).distinct().select(F.col("basket").alias("key"), "item", (F.row_number().over(W.partitionBy("basket").orderBy("item")) - 1).alias("i"))
    return r6(features.colabel_bests(features.colabel_graph(baskets(s, d)), a, 1, ("cond", "jaccard")))


MODES = CG + ", k AS (SELECT basket AS key, item, row_number() OVER (PARTITION BY basket ORDER BY item) - 1 AS i FROM i), ed AS (SELECT a AS item, b AS other, cond, jaccard FROM g UNION ALL SELECT b, a, cond, jaccard FROM g), vs AS (SELECT key, other, max(round(cond / (1 + 0.25::DOUBLE * i), 9)) AS cond, max(round(jaccard / (1 + 0.25::DOUBLE * i), 9)) AS jaccard FROM k JOIN ed USING (item) WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.key = k.key AND o.item = ed.other) GROUP BY ALL) " + " UNION ALL ".join(f"SELECT key, best, round(score, 6) AS score, '{m}' AS mode FROM (SELECT key, other AS best, {m} AS score, row_number() OVER (PARTITION BY key ORDER BY {m} DESC, other) AS r FROM vs) WHERE r = 1" for m in ("cond", "jaccard"))


def event_sliding(s, d):
    x = ev.sliding(table(s, d, "events"), "12 hours", "6 hours")
    return x.select(_date("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


SQL_VIEWS = """WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderkey IN (SELECT l_orderkey FROM big) GROUP BY ROLLUP (r_name, n_name)"""


def sql_views(s, d):
    """The tables as temporary views, and a query over them in SQL: a common table expression, a subquery and a rollup."""
    io.register_views(s, d)
    return s.sql(SQL_VIEWS)


QUERIES: dict = {
    "archetypes": (archetypes, ARCHETYPES),
    "scored_archetypes": (scored_archetypes, SCORED),
    "query_features": (query_features, QUERY_FEATURES),
    "title_features": (title_features, TITLES),
    "top_passages": (top_passages, PASSAGES),
    "window_dedup": (window_dedup, DEDUP),
    "over_budget_gold": (over_budget_gold, OVER),
    "token_counts": (token_counts, None),
    "region_top30": (region_top30, RG + 'SELECT doc_id, count(*) AS regions, sum("end" - start)::BIGINT AS chars, sum(n)::BIGINT AS words FROM rg GROUP BY doc_id ORDER BY regions DESC, doc_id LIMIT 30'),
    "region_spread": (region_spread, SPREAD),
    "offset_regions": (offset_regions, RG + 'SELECT t.doc_id, x, region FROM (SELECT doc_id, length(text) // 2 AS x FROM documents) t LEFT JOIN rg ON rg.doc_id = t.doc_id AND x >= start AND x < "end"'),
    "referential_check": (referential_check, " UNION ALL ".join(f"SELECT '{c}.{k}' AS child, count(*) AS rows, count(*) FILTER ({k} IS NOT NULL AND {k} NOT IN (SELECT {q} FROM {p})) AS dangling FROM {c}" for c, k, p, q in REFERENCES)),
    "dataset_audit": (dataset_audit, AUDIT),
    "fold_gates": (fold_gates, GATES),
    "colabel_modes": (colabel_modes, MODES),
    "event_sliding": (event_sliding, "WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS b, value FROM events) SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY b"),
    "sql_views": (sql_views, SQL_VIEWS),
}
