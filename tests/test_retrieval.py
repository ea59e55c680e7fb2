import hashlib
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import legal
from rankloom.functions import text as tx
from rankloom.operators import features, fusion, lexical, metrics, model, segment, select, vector


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 12)).round(1)  # coarse, so that scores tie
    x[600:] = x[:100]
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id long, embedding array<double>").repartition(5)


def test_topk_against_numpy_with_ties_and_blocks(spark, made):
    x, docs = made
    q = docs.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "qid")
    want = []
    for i in range(0, 700, 7):
        s = np.round(x @ x[i], 9)
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:9]
        want += [(i, int(j), r, float(s[j])) for r, j in enumerate(order, 1)]
    for block in (4096, 20):
        assert rows(vector.topk(q, docs, 9, block=block)) == sorted(want)
    first = {i: int(np.lexsort((np.arange(700), -np.round(x @ x[i], 9)))[0]) for i in range(0, 700, 7)}
    assert {r.qid: r.doc_id for r in vector.topk(q, docs, 1, itself=True).collect()} == first
    assert vector.topk(q.where("false"), docs, 3).count() == 0


def test_children_against_numpy(spark, made):
    x, docs = made
    parents = docs.select("doc_id", (F.col("doc_id") % 11).alias("parent_id"))
    q = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid")
    found = vector.children(q, docs, parents, close=0.5, block=5).cache()
    best = {(r.qid, r.parent_id): (r.vec_id, r.score) for r in vector.witness(found).collect()}
    sup = {(r.qid, r.parent_id): r for r in vector.support(found, 0.5).collect()}
    for i in range(0, 700, 50):
        for p in range(11):
            js = [j for j in range(p, 700, 11) if j != i]
            s = np.round(x[js] @ x[i], 9)
            k = int(np.lexsort((js, -s))[0])
            assert best[i, p] == (js[k], s[k])
            t = -np.sort(-s)
            r = sup[i, p]
            assert (r.best, r.second, r.third) == (t[0], t[1], t[2])
            assert r.log_n == pytest.approx(math.log1p(len(js))) and r.log_close == pytest.approx(math.log1p((t >= t[0] - 0.5).sum()))


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 10))
    x = np.vstack([x, x[:300] + 0.1 * rng.standard_normal((300, 10)), np.repeat(x[:1], 40, 0), x[5] + 0.01 * rng.standard_normal((90, 10))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(5000, None), (5001, [0.0] * 10), (5002, [float("nan")] * 10)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    p, q = np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.9, 1))
    copy = set(range(1800, 1840))
    want = sorted((int(a), int(b)) for a, b in zip(p, q, strict=True) if a not in copy and b not in copy)
    for bucket in (4096, 32):
        pairs, member = vector.near_pairs(df, 0.9, bucket=bucket)
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and sorted(got) == want
        rep = dict(rows(member))
        assert len(rep) == 1933 and all(rep[i] == 0 for i in copy) and rep[5000] == 5000


def test_unit_norm_is_asked_for(spark):
    x = spark.createDataFrame([(1, [3.0, 4.0])], "id long, embedding array<double>")
    assert vector.normalised(x).first().embedding == [0.6, 0.8]
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="zero or not finite"):
            vector.normalised(spark.createDataFrame([(1, bad)], "id long, embedding array<double>")).collect()


def test_holding_finds_whole_texts_only(spark):
    docs = spark.createDataFrame([(1, "xx one two three yy"), (2, "one two"), (3, None), (4, "one two three one two three")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "one two three"), (8, "one two three"), (9, "three yy"), (10, "none")], "qid long, question string")
    assert rows(lexical.holding(docs, q)) == rows(lexical.holding(docs, q, block=1)) == [(7, 1), (7, 4), (8, 1), (8, 4), (9, 1)]


def test_character_grams_follow_word_bounds(spark):
    x = spark.createDataFrame([(1, "ab abcd"), (2, "AB x")], "id long, text string")
    got = lexical.char_tfidf(x, "id", "text", min_df=1)
    grams = {}
    for r in got.collect():
        grams.setdefault(r.id, set()).add(r.gram)
    assert grams[2] == {" ab", "ab ", " ab ", " x "}
    assert {" abc", "abcd ", "bcd "} <= grams[1] and "b a" not in grams[1]
    assert sum(r.weight**2 for r in got.where("id = 1").collect()) == pytest.approx(1)
    assert len({r.gram for r in lexical.char_tfidf(x, "id", "text", min_df=1, most=3).collect()}) == 3


def test_accents_of_every_letter_go(spark):
    texts = ["Đường ĐỀ ạ ữ ệ Ở ỹ – Straße!", "éạ ḗ", "ậ ặ", None, "漢字 Ω"]

    def marks(t):
        t = unicodedata.normalize("NFKC", " ".join(unicodedata.normalize("NFC", t).split())).casefold()
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in t).split())

    def plain(t):
        t = unicodedata.normalize("NFD", marks(t).replace("đ", "d"))
        return " ".join("".join(c for c in t if unicodedata.category(c) != "Mn").split())

    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.a, r.n) for r in x.select("i", tx.accent_key("t").alias("a"), tx.nfkc_key("t").alias("n")).collect()}
    assert [got[i][0] for i in range(5)] == [None if t is None else plain(t) for t in texts]
    assert [got[i][1] for i in range(5)] == [None if t is None else marks(t) for t in texts]
    assert got[0][0] == "duong de a u e o y strasse"
    assert [r[0] for r in x.select(tx.strict_key("t")).collect()][:2] == ["đường đề ạ ữ ệ ở ỹ – strasse!", "éạ ḗ"]
    flags = x.select(*(c.alias(k) for k, c in tx.flags(F.col("t")).items())).collect()
    assert [r.not_nfc for r in flags] == [False, True, False, None, False]


def test_question_classes(spark):
    want = {
        "Điều 5 luật đất đai": ("DIRECT_REF", "DIRECT_REF"),
        "Mức phạt tiền là bao nhiêu": ("SANCTION", "SANCTION"),
        "THỦ TỤC thế nào": ("PROCEDURE", "PROCEDURE"),
        "điều kiện gì": ("CONDITION", "CONDITION"),
        "tài sản là gì": ("DEFINITION", "DEFINITION"),
        "tối đa mấy năm": ("NUMERICAL_THRESHOLD", "GENERAL_SEMANTIC"),
        "ai được giảm": ("ELIGIBILITY", "GENERAL_SEMANTIC"),
        "căn cứ thông tư này": ("CROSS_REFERENCE", "DIRECT_REF"),
        "theo quy định tại khoản 2": ("DIRECT_REF", "CROSS_REFERENCE"),
        "một câu khác": ("GENERAL_SEMANTIC", "GENERAL_SEMANTIC"),
        "mức" + " x" * 40 + " khoản 2": ("NUMERICAL_THRESHOLD", "DIRECT_REF"),
    }
    x = spark.createDataFrame([(t,) for t in want], "t string")
    got = x.select("t", legal.archetype(F.col("t")), legal.scored_archetype(F.lower("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want
    f = x.where("t like 'Điều%'").select(*(c.alias(k) for k, c in legal.query_features(legal.title_key(F.col("t"))).items())).first()
    assert len(f) == 16 and f.article == 1 and f.words == 5 / 60 and f.year == 0


def test_top_passages(spark):
    far = " ".join(f"w{i}" for i in range(200)) + " lease price 42 lease " + " ".join(f"v{i}" for i in range(120))
    p = spark.createDataFrame([(1, 1, "the lease price 42", far), (1, 2, "the lease", "short  text\nhere"), (1, 3, "q", "")], "qid long, doc_id long, question string, text string")
    got = {(r.doc_id, r.nth): r.passage for r in segment.top_passages(p, ("the",), 50, 10, 8, 2).collect()}
    assert got[2, 1] == "short text here" and got[3, 1] == "" and (2, 2) not in got
    assert got[1, 1].startswith("w0 w1 w2 w3 w4 w5 w6 w7" + segment.JOINT) and "lease price 42" in got[1, 1]
    assert len({got[1, 1], got[1, 2]}) == 2


def test_tokens_are_those_of_the_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "some plain words, 12", "漢字 é"]
    t = Tokenizer.from_file(path)
    got = rows(segment.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    assert got == [(i, len(t.encode(x or "", add_special_tokens=False).ids) + 2) for i, x in enumerate(texts)]


def test_points_fall_into_regions(spark):
    r = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 9), (2, 0, 3, 4)], "doc_id long, region long, start long, end long")
    p = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 8), (1, 9), (2, 0), (2, 3), (3, 1)], "doc_id long, x long")
    assert rows(segment.locate(p, r).fillna(-1, ["region"])) == [(1, 0, 0), (1, 4, 0), (1, 5, -1), (1, 8, 1), (1, 9, -1), (2, 0, -1), (2, 3, 0), (3, 1, -1)]


def test_lines_of_long_and_null_texts(spark):
    texts = [None, "", "a\n\nbc.\n", "é漢.\nx", "\n".join(f"line {i}." for i in range(20_000))]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in segment.line_regions(x).collect():
        got.setdefault(r.doc_id, []).append((r.region, r.start, r.end, r.kind))
    for i, t in enumerate(texts):
        at, want = 0, []
        for k, line in enumerate((t or "").split("\n")):
            want.append((k, at, at + len(line), "body" if line.endswith(".") else "gap"))
            at += len(line) + 1
        assert sorted(got[i]) == want


def test_fill_up_slots(spark):
    s = "qid long, doc_id long, rank int"
    a, b = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], s), spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 9, 1)], s)
    assert rows(fusion.fill_up(a, b, 4)) == [(1, 1, 5), (1, 2, 6), (1, 3, 7), (1, 4, 5), (2, 1, 9), (2, 2, 9), (2, 3, 9), (2, 4, 9)]


def test_slot_five_takes_the_first_gold_of_the_pool(spark):
    s = "qid long, doc_id long, rank int"
    base = spark.createDataFrame([(q, 10 * q + i, i) for q in (1, 2) for i in range(1, 6)], s)
    pool = spark.createDataFrame([(1, 11, 1), (1, 30, 2), (1, 31, 3), (1, 15, 4), (2, 40, 1)], s)
    gold = spark.createDataFrame([(1, 11), (1, 31), (1, 15), (2, 99)], "qid long, doc_id long")
    assert rows(features.slot5_oracle(base, pool, gold)) == [(1, 15, 31, True), (2, 25, 25, False)]
    assert rows(features.challengers(base, pool, 1)) == [(1, 1, 30), (2, 1, 40)]


def test_first_arm_wins_ties_and_smaller_alpha_too(spark):
    per = spark.createDataFrame([("b", 1, 0.5), ("a", 1, 0.5), ("b", 2, 0.7), ("a", 2, 0.1)], "arm string, qid long, recall double")
    assert rows(metrics.arm_wins(per, ["b", "a"])) == [("b", 2)] and rows(metrics.arm_wins(per, ["a", "b"])) == [("a", 1), ("b", 1)]
    grid = spark.createDataFrame([(w, f, 0.5 if w else 0.5, 3) for w in (0.25, 0.0) for f in (0, 1)], "w double, fold long, recall double, n long")
    assert [r.alpha for r in select.nested_alpha(grid).collect()] == [0.0, 0.0]


def test_rows_of_a_parent_must_be_contiguous(spark):
    assert rows(vector.child_ranges(spark.createDataFrame([(1, 3), (1, 4), (2, 5)], "parent_id long, row long"))) == [(1, 3, 5), (2, 5, 6)]
    for bad in ([(1, 3), (1, 5)], [(1, 3), (1, 3)]):
        with pytest.raises(Exception, match="not contiguous"):
            vector.child_ranges(spark.createDataFrame(bad, "parent_id long, row long")).collect()


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 3))
    y = (x @ [1.5, -1.0, 0.3] + rng.standard_normal(400) > 0.3).astype(int)
    return x, y, spark.createDataFrame([(i, i % 4, int(y[i]), *map(float, x[i])) for i in range(400)], "id long, fold long, label int, a double, b double, c double")


def _logistic(x, y, c):
    """Balanced logistic regression by Newton steps, the penalty 1/(c n) on standardised features, none on the bias."""
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    z, b = np.c_[x, np.ones(n)], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.full(x.shape[1], 1 / (c * n)), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        h = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(ridge)
        b -= np.linalg.solve(h, z.T @ (w * (p - y)) / w.sum() + ridge * b)
    return b


def test_logistic_scores_against_numpy(spark, judged):
    x, y, df = judged
    got = {r.id: r.score for r in model.logistic_oof(df, ["a", "b", "c"]).collect()}
    for held in range(4):
        tr = np.arange(400) % 4 != held
        m, s = x[tr].mean(0), x[tr].std(0, ddof=1)
        b = _logistic((x[tr] - m) / s, y[tr], 0.15)
        want = 1 / (1 + np.exp(-(np.c_[(x[~tr] - m) / s, np.ones((~tr).sum())] @ b)))
        assert np.allclose([got[i] for i in np.flatnonzero(~tr)], want, atol=2e-3)
    both = model.nested_priors(df, ["a", "b", "c"], 2)
    outer = {r.id: r.score for r in both.where("role = 'outer'").collect()}
    assert set(outer) == set(range(2, 400, 4)) and all(abs(outer[i] - got[i]) < 1e-9 for i in outer)
    assert both.where("role = 'inner' and fold = 2").count() == 0 and both.where("role = 'inner'").count() == 300


def _auc(s, y):
    r = np.argsort(np.argsort(s)) + 1
    return (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_boosted_trees_rank_held_out_rows(judged):
    x, y, df = judged
    got = {r.id: r.score for r in model.logistic_oof(df, ["a", "b", "c"], trees=True).collect()}
    assert _auc(np.array([got[i] for i in range(400)]), y) > 0.8


def test_pairwise_weights_against_numpy(spark):
    rng = np.random.default_rng(9)
    d = rng.standard_normal((300, 2)) + [0.8, -0.3]
    df = spark.createDataFrame([(v, [0.0, 0.0]) for v in d.tolist()], "x array<double>, y array<double>")
    got = {r.feature: r.weight for r in model.pairwise_logistic(df, ["f", "g"]).collect()}
    z, t, w = np.vstack([d, -d]), np.r_[np.ones(300), np.zeros(300)], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / 600 + np.eye(2) / 60, z.T @ (p - t) / 600 + w / 60)
    assert np.allclose([got["f"], got["g"]], w, atol=2e-3)


def test_clusters_found_and_chosen(spark):
    rng = np.random.default_rng(10)
    centre = np.eye(8)[:4] * 5
    x = np.vstack([c + 0.1 * rng.standard_normal((50, 8)) for c in centre])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>")
    assert sorted(r.size for r in model.kmeans_profile(df.drop("id"), k=4).collect()) == [50] * 4
    scores, near = model.kmeans_by_silhouette(df, ks=(2, 4, 6))
    assert [r.k for r in scores.where("chosen").collect()] == [4]
    for k in range(4):
        ids = [r.id for r in near.where(F.col("cluster") == k).orderBy("nth").collect()]
        own = {i // 50 for i in ids}
        assert len(ids) == 5 and len(own) == 1
        part = x[50 * min(own) : 50 * min(own) + 50]
        u = part / np.linalg.norm(part, axis=1)[:, None]
        m = u.mean(0) / np.linalg.norm(u.mean(0))
        assert ids == (50 * min(own) + np.argsort(-(u @ m), kind="stable")[:5]).tolist()


def test_arms_are_routed_by_what_their_folds_did_not_see(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((240, 4))
    rows_ = [(i, i % 3, v, float(v[0] > 0), float(v[0] <= 0)) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows_, "id long, fold long, embedding array<double>, p double, q double")
    got = model.route_arms(df, ["p", "q"], components=4).collect()
    assert len(got) == 240 and np.mean([(r.arm == "p") == (x[r.id, 0] > 0) for r in got]) > 0.85


def test_fingerprint_of_a_snapshot(spark, tmp_path):
    from rankloom.sources import io

    for name, text in (("b", "2"), ("a", "1")):
        (tmp_path / name).write_text(text)
    r = io.snapshot_fingerprint(io.manifest(spark, str(tmp_path))).first()
    lines = "\n".join(f"{n} {hashlib.sha256(t.encode()).hexdigest()}" for n, t in (("a", "1"), ("b", "2")))
    assert (r.n_files, r.size_bytes, r.fingerprint) == (2, 2, hashlib.sha256(lines.encode()).hexdigest())
