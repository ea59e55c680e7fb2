"""Named queries over legal keys and regions, evidence packaging, and stand-in encoders and scorers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import legal
from rankloom.functions import text as tx
from rankloom.operators import model, segment, select
from rankloom.plans.session import cut
from rankloom.plans.text_queries import BM, CMP, RG, WORD, _terms, docs, questions, regions, table, tok
from rankloom.plans.vector_queries import r6
from rankloom.sources import io

# The tables hold no legal texts: references are put before each document's text, and headings before its lines.
_CITED = ["Căn cứ Điều {k}, khoản {k} Luật số {k}/2019/QH-AB: ", "điểm a khoản {k} nghị định {k}/2020/NĐ-CP sửa đổi ", "Chương {k} mục {k} bo luat và thông tư của công ty ", "Pháp_lệnh-cũ {k} ", ""]
_HEADED = ["Điều {k}. ", "Chương {k} ", "Mục {k} ", "PHỤ LỤC {k}\n", "Phụ lục {k}\n", "Điều\n{k}. "]


def cited(s, d) -> DataFrame:
    k = (F.col("doc_id") % 1000).cast("string")
    head = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("{k}"), k) for x in _CITED)), (F.col("doc_id") % len(_CITED) + 1).cast("int"))
    return docs(s, d).select("doc_id", F.concat(head, "text").alias("text"))


CITED = "WITH c AS (SELECT doc_id, replace([" + ", ".join(f"'{x}'" for x in _CITED) + f"][1 + doc_id % {len(_CITED)}], '{{k}}', (doc_id % 1000)::VARCHAR) || text AS text FROM documents), "


def headed(s, d) -> DataFrame:
    heads = F.array(*map(F.lit, _HEADED), F.lit(""), F.lit(""))
    line = lambda x, i: F.concat(F.replace(F.element_at(heads, ((F.col("doc_id") + i) % (len(_HEADED) + 2) + 1).cast("int")), F.lit("{k}"), i.cast("string")), x)
    return docs(s, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


HEADED = "WITH c AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: replace([" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _HEADED) + f", '', ''][(1 + (doc_id + i - 1) % {len(_HEADED) + 2})::INT], '{{k}}', (i - 1)::VARCHAR) || x), chr(10)) AS text FROM documents), "


def legal_locators(s, d):
    x = cited(s, d)
    return x.select("doc_id", *(c.alias(k) for k, c in legal.locator_counts(F.col("text")).items()))


def _plain(p: str) -> str:
    p = p.replace(r"\s", "[ \\t\\n\\f\\r]")
    p = r"(^|[^\p{L}\p{N}_])" + p.removeprefix(r"\b").removeprefix(r"(?<!\w)")
    return "(?i)" + (p[:-2] + r"($|[^\p{L}\p{N}_])" if p.endswith(r"\b") else p)


def legal_flags(s, d):
    t = F.col("text")
    return cited(s, d).select("doc_id", *(c.alias(k) for k, c in legal.reference_flags(t).items()), F.concat_ws(",", legal.instrument_types(t)).alias("instruments"))


KEY = "lower(" + CMP.format(x="translate(text, '-_', '  ')") + ")"


def title_keys(s, d):
    x = cited(s, d)
    return x.select("doc_id", F.md5(legal.clean_title(F.col("text"))).alias("clean"), F.size(legal.title_tokens(F.col("text"))).cast("long").alias("tokens"))


def legal_region_rows(s, d):
    return legal.legal_regions(legal.headings(headed(s, d)))


HEADS = HEADED + r"""l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM c),
o AS (SELECT doc_id, line, i, length(text) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^[ \t]*(PHỤ[ \t]+LỤC|DANH[ \t]+MỤC|MẪU)') AND line = upper(line) THEN 'annex' WHEN regexp_matches(line, '(?i)^[ \t]*Chương[ \t]+([IVXLCDM]+|\d+)\b') THEN 'chapter'
  WHEN regexp_matches(line, '(?i)^[ \t]*Mục[ \t]+\d') THEN 'section' WHEN regexp_matches(line, '(?i)^[ \t]*Điều[ \t]+\d+[a-zđ]?([ \t]*[.:])?([ \t]|$)') THEN 'article' WHEN regexp_matches(line, '(?i)^[ \t]*Điều[ \t]*$') AND regexp_matches(next, '(?i)^[ \t]*\d+[a-zđ]?([ \t]*[.:])?([ \t]|$)') THEN 'broken' END AS kind FROM o),
m AS (SELECT doc_id, n, start, CASE kind WHEN 'broken' THEN 'article' ELSE kind END AS kind, kind = 'broken' AS broken, trim(regexp_replace(CASE WHEN kind = 'broken' THEN line || ' ' || next ELSE line END, '\s+', ' ', 'g')) AS heading,
  sum((kind = 'annex')::INT) OVER w AS a, sum((kind IN ('annex', 'chapter'))::INT) OVER w AS c FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
st AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'chapter' THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id, a ORDER BY start), '') AS chapter, coalesce(last_value(CASE WHEN kind = 'section' THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id, c ORDER BY start), '') AS section FROM m),
mj AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS "end" FROM st WHERE kind IN ('article', 'annex')),
gp AS (SELECT doc_id, length(text) AS n, text, (SELECT min(start) FROM mj WHERE mj.doc_id = c.doc_id) AS first FROM c)
SELECT doc_id, start, "end", kind, md5(heading) AS heading, md5(chapter) AS chapter, md5(section) AS section, broken FROM mj
UNION ALL SELECT doc_id, 0, coalesce(first, n), 'gap', md5(''), md5(''), md5(''), false FROM gp WHERE regexp_matches(substr(text, 1, coalesce(first, n)), '\S')"""


def legal_region_keys(s, d):
    x = legal_region_rows(s, d)
    return x.select("doc_id", "start", "end", "kind", *(F.md5(c).alias(c) for c in ("heading", "chapter", "section")), "broken")


def joined_pack(s, d):
    """Packs and tokens of greedy packing by sums alone and with two tokens between regions."""
    r = regions(s, d).where("n > 0")
    one = lambda joint: segment.coarse_pack(r, 64, joint=joint).agg(F.lit(joint).cast("long").alias("joint"), F.count("*").alias("packs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("most"))
    return one(0).unionByName(one(2))


def _packed(joint: int) -> str:
    to = f"CASE WHEN fill > 0 THEN fill + {joint} + z.n ELSE z.n END"
    return f"""SELECT {joint} AS joint, count(*) AS packs, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS most FROM (WITH RECURSIVE f AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS fill, []::BIGINT[] AS out FROM (SELECT DISTINCT doc_id FROM z)
 UNION ALL SELECT f.doc_id, z.k, CASE WHEN z.n > 64 THEN 0 WHEN {to} > 64 THEN z.n ELSE {to} END, CASE WHEN z.n > 64 THEN (CASE WHEN fill > 0 THEN [fill] ELSE [] END) || list_transform(range(z.n // 64), lambda i: 64::BIGINT) || (CASE WHEN z.n % 64 > 0 THEN [z.n % 64] ELSE [] END) WHEN {to} > 64 THEN [fill] ELSE [] END
 FROM f JOIN z ON z.doc_id = f.doc_id AND z.k = f.k + 1) SELECT unnest(out) AS n FROM f UNION ALL SELECT fill FROM (SELECT fill, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM f) WHERE r = 1 AND fill > 0)"""


MODES = ["head", "full", "overlap50", "three_quarters", "lexical"]


def _pairs(s, d):
    return _terms(s, d).withColumn("n_title", F.lit(5))


def evidence_modes(s, d):
    """Windows, tokens and the last start of each packaging mode, per pair of 160 tokens."""
    p = cut(_pairs(s, d))
    per = lambda m: segment.evidence_windows(p, m, most=160).groupBy("qid", "doc_id").agg(F.count("*").alias("windows"), F.sum("size").alias("tokens"), F.max("start").alias("last")).withColumn("mode", F.lit(m))
    out = per(MODES[0])
    for m in MODES[1:]:
        out = out.unionByName(per(m))
    return out


PT = BM + f", pt AS (SELECT qid, doc_id, {tok('b.text')} AS q, {tok('d.text')} AS d, b.text AS bt, d.text AS dt FROM bm JOIN benchmark b ON qid = item_id JOIN documents d USING (doc_id))"
_ROW = "SELECT '{m}' AS mode, qid, doc_id, count(*) AS windows, sum(least({w}, n - start))::BIGINT AS tokens, max(start) AS last FROM (SELECT qid, doc_id, n, b, w3, unnest(generate_series(0, greatest(0, ceil((n - {w}) / {st}::DOUBLE))::BIGINT)) * {st} AS start FROM bu WHERE n > 0) {where} GROUP BY qid, doc_id"
EVIDENCE = PT + ", bu0 AS (SELECT qid, doc_id, len(d) AS n, greatest(64, 160 - len(q) - 4 - 5 - 2) AS b FROM pt), bu AS (SELECT *, greatest(64, round_even(0.75 * b, 0)::BIGINT) AS w3 FROM bu0), " + """lx AS (SELECT qid, doc_id, n, start FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY density DESC, start) AS r FROM (SELECT qid, doc_id, n, start, len(list_intersect(list_distinct(q), list_distinct(d[start + 1:start + 220]))) / sqrt(len(d[start + 1:start + 220])) AS density FROM (SELECT qid, doc_id, q, d, len(d) AS n, unnest(generate_series(0, greatest(0, ceil((len(d) - 220) / 150.0))::BIGINT)) * 150 AS start FROM pt WHERE len(d) > 0))) WHERE r = 1)
""" + " UNION ALL ".join(_ROW.format(m=m, w=w, st=st, where=wh) for m, w, st, wh in (("head", "b", "b", "WHERE start = 0"), ("full", "b", "b", ""), ("overlap50", "b", "(b // 2)", ""), ("three_quarters", "w3", "(w3 // 2)", ""))) + " UNION ALL SELECT 'lexical', qid, doc_id, 1, least(220, n - start), start FROM lx"


def evidence_bundles(s, d):
    """The two densest windows of each pair under its title, and a balanced bundle of head and tail."""
    x = cut(_pairs(s, d))
    best = segment.best_passages(x, 60, 40)
    at = best.groupBy("qid", "doc_id").agg(F.min(F.when(F.col("nth") == 1, F.col("start"))).alias("s1"), F.min(F.when(F.col("nth") == 2, F.col("start"))).alias("s2"))
    part = lambda c: F.array_join(F.slice("d", (F.col(c) + 1).cast("int"), 60), " ")
    x = x.join(at, ["qid", "doc_id"])
    full = segment.evidence_bundle(F.lit("t"), part("s1"), part("s2"))
    fair = segment.balanced_bundle(F.col("d"), F.reverse("d"), F.size("q") + 9, 160)
    return x.select("qid", "doc_id", F.md5(full).alias("bundle"), F.md5(fair).alias("balanced"))


BUNDLE = PT + """, bw AS (SELECT qid, doc_id, q, d, unnest(generate_series(0, greatest(0, ceil((len(d) - 60) / 40.0))::BIGINT)) * 40 AS start FROM pt WHERE len(d) > 0), bd AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY len(list_intersect(list_distinct(q), list_distinct(d[start + 1:start + 60]))) / sqrt(len(d[start + 1:start + 60])) DESC, start) AS r FROM bw),
ab AS (SELECT qid, doc_id, any_value(q) AS q, any_value(d) AS d, any_value(array_to_string(d[start + 1:start + 60], ' ')) FILTER (r = 1) AS a, any_value(array_to_string(d[start + 1:start + 60], ' ')) FILTER (r = 2) AS b FROM bd WHERE r <= 2 GROUP BY qid, doc_id),
bg AS (SELECT *, greatest(96, 160 - len(q) - 9) AS g FROM ab), bh AS (SELECT *, greatest(48, g // 2) AS x FROM bg)
SELECT qid, doc_id, md5('[TITLE]' || chr(10) || 't' || chr(10) || chr(10) || '[EVIDENCE A]' || chr(10) || a || CASE WHEN b IS NOT NULL AND b <> a THEN chr(10) || chr(10) || '[EVIDENCE B]' || chr(10) || b ELSE '' END) AS bundle,
md5(array_to_string(d[1:x], ' ') || chr(10) || array_to_string(list_reverse(d)[1:greatest(48, g - x)], ' ')) AS balanced FROM bh"""


def hashed_encoding(s, d):
    q = questions(s, d).select("qid", tx.tokens(F.concat(F.lit("query: "), F.col("question"))).alias("t"))
    out = [q.select("qid", F.lit(p).alias("pool"), F.posexplode(model.hashed_encoding(F.col("t"), 16, 64, p)).alias("dim", "value")) for p in ("mean", "last")]
    return r6(out[0].unionByName(out[1]).withColumn("dim", F.col("dim").cast("long")))


ENCODE = f"WITH t AS (SELECT item_id AS qid, ({tok(chr(39) + 'query: ' + chr(39) + ' || text')})[1:64] AS t FROM benchmark), p AS (SELECT qid, 'mean' AS pool, t FROM t UNION ALL SELECT qid, 'last', t[-1:] FROM t), u AS (SELECT qid, pool, unnest(t) AS u, len(t) AS n FROM p) SELECT qid, pool, j - 1 AS dim, round(sum(('0x' || substr(md5(u), j::INT, 1))::INT / 7.5::DOUBLE - 1) / any_value(n), 6) AS value FROM u, generate_series(1, 16) AS g(j) GROUP BY qid, pool, j"


def passage_scores(s, d):
    return r6(model.best_passage_score(_terms(s, d), 80, 40))


def yes_no_scores(s, d):
    x = table(s, d, "embeddings").select("vec_id", model.yes_no(F.col("embedding").cast("array<double>"), 3, 7).alias("score"))
    return r6(x)


def two_level_overlap(s, d):
    """Every twentieth document against all others: how many have its text, or its first line only."""
    x = docs(s, d).select("doc_id", F.md5("text").alias("strict"), F.md5(tx.punctuation_key(F.split("text", "\n")[0])).alias("loose"))
    found = select.two_level_overlap(x.where("doc_id % 20 = 0"), x, "doc_id", "strict", "loose", itself=False)
    return found.drop("same_key")


LOOSE = "md5(" + CMP.format(x="regexp_replace(replace(lower(string_split(text, chr(10))[1]), 'ß', 'ss'), '[\\p{P}\\p{S}]', ' ', 'g')") + ")"


def list_digests(s, d):
    return select.ordered_digest(_terms(s, d).select("qid", "doc_id"), ["qid"], "doc_id", "doc_id")


TRACED = {"region": ["r_name", "r_regionkey"], "nation": ["n_name", "n_nationkey", "n_regionkey"], "documents": ["doc_id", "lang", "source"]}


def table_digests(s, d):
    out = [select.table_digest(table(s, d, t).select(c)).withColumn("name", F.lit(t)) for t, c in TRACED.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def snapshot_fingerprint(s, d):
    """One row over all files of the tables."""
    return io.snapshot_fingerprint(io.manifest(s, d))


QUERIES: dict = {
    "legal_locators": (legal_locators, CITED + "x AS (SELECT 1) SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_plain(p)}'))::BIGINT AS {k}" for k, p in legal.LOCATORS.items()) + " FROM c"),
    "legal_flags": (legal_flags, CITED + f"x AS (SELECT *, {KEY} AS key FROM c) SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{_plain(p)}') AS {k}" for k, p in legal.CUES.items()) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(key, '{a}') OR contains(key, '{b}') THEN '{k}' END" for k, (a, b) in legal.INSTRUMENTS.items()) + "], lambda x: x IS NOT NULL), ',') AS instruments FROM x"),
    "title_keys": (title_keys, CITED + f"x AS (SELECT *, {KEY} AS key FROM c) SELECT doc_id, md5({CMP.format(x='translate(text, ' + chr(39) + '-_' + chr(39) + ', ' + chr(39) + '  ' + chr(39) + ')')}) AS clean, len(regexp_extract_all(key, '{WORD}'))::BIGINT AS tokens FROM x"),
    "legal_regions": (legal_region_keys, HEADS),
    "joined_pack": (joined_pack, RG + ", z AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY region) AS k FROM rg WHERE n > 0)\n" + _packed(0) + " UNION ALL " + _packed(2)),
    "evidence_modes": (evidence_modes, EVIDENCE),
    "evidence_bundles": (evidence_bundles, BUNDLE),
    "hashed_encoding": (hashed_encoding, ENCODE),
    "passage_scores": (passage_scores, PT + ", w AS (SELECT qid, doc_id, q, d, unnest(generate_series(0, greatest(0, ceil((len(d) - 80) / 40.0))::BIGINT)) * 40 AS start FROM pt WHERE len(d) > 0) SELECT qid, doc_id, round(max(len(list_intersect(list_distinct(q), list_distinct(d[start + 1:start + 80]))) / greatest(1, len(list_distinct(q)))::DOUBLE), 6) AS score FROM w GROUP BY qid, doc_id"),
    "yes_no_scores": (yes_no_scores, "SELECT vec_id, round(embedding[4]::DOUBLE - embedding[8]::DOUBLE, 6) AS score FROM embeddings"),
    "two_level_overlap": (two_level_overlap, f"WITH x AS (SELECT doc_id, md5(text) AS s, {LOOSE} AS l FROM documents), q AS (SELECT a.doc_id, (SELECT count(*) FROM x r WHERE r.s = a.s AND r.doc_id <> a.doc_id) AS n_strict, (SELECT count(*) FROM x r WHERE r.l = a.l AND r.s <> a.s) AS n_loose_only FROM x a WHERE doc_id % 20 = 0) SELECT doc_id, n_strict, n_loose_only, n_strict > 0 AS excluded FROM q"),
    "list_digests": (list_digests, BM + "SELECT qid, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM bm GROUP BY qid"),
    "table_digests": (table_digests, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {', '.join(f'coalesce({x}::VARCHAR, ' + chr(39) + 'null' + chr(39) + ')' for x in c)})), 1, 8))::BIGINT)::BIGINT AS digest FROM {t}" for t, c in TRACED.items())),
    "snapshot_fingerprint": (snapshot_fingerprint, None),
}
