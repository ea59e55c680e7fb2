"""Steps whose tasks, shuffles and messages must not grow faster than their input."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import features, fusion, lexical, model, segment, vector


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_colabels_against_plain_code(spark):
    r = random.Random(7)
    held = [(b, r.choice((1, 2, r.randrange(40)))) for b in range(300) for _ in range(r.randrange(1, 7))]
    items = spark.createDataFrame([*held, *held[:50], (None, 3), (5, None)], "basket long, item long")
    sets = defaultdict(set)
    for b, i in held:
        sets[b].add(i)
    f = Counter(i for s in sets.values() for i in s)
    pair = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    for n in (50, 400_000):
        graph = features.colabel_graph(items, rows=n)
        assert {(x.a, x.b): (x.support, x.cond, x.jaccard) for x in graph.collect()} == {(a, b): (c, c / f[a], c / (f[a] + f[b] - c)) for (a, b), c in pair.items()}
    anchors = [(b, i, n) for b, s in sets.items() for n, i in enumerate(sorted(s))]
    got = rows(features.colabel_bests(graph, spark.createDataFrame(anchors, "key long, item long, i int"), 1, ("cond", "jaccard")))
    want = []
    for mode in ("cond", "jaccard"):
        for b, s in sets.items():
            best = {}
            for n, i in enumerate(sorted(s)):
                for (x, y), c in pair.items():
                    to = y if x == i else x if y == i else None
                    if to is not None and to not in s:
                        v = round((c / f[x] if mode == "cond" else c / (f[x] + f[y] - c)) / (1 + 0.25 * n), 9)
                        best[to] = max(best.get(to, 0), v)
            if best:
                to = min(best, key=lambda k: (-best[k], k))
                want.append((b, to, best[to], mode))
    assert got == sorted(want)


def test_an_anchor_meets_few_of_its_neighbours(spark):
    """A key of two items needs at most two neighbours of each: rows must not grow with the graph."""
    graph = spark.range(3000).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"), F.lit(1).cast("long").alias("support"), (1 / (F.col("id") + 2)).alias("cond"), F.lit(0.5).alias("jaccard"), F.lit(0.0).alias("pmi"))
    anchors = spark.range(400).select(F.col("id").alias("key"), F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("item"), F.lit(0).alias("i")), F.struct(F.lit(0).cast("long").alias("item"), F.lit(1).alias("i")))).alias("x")).select("key", "x.*")
    got = features.colabel_bests(graph, anchors, 1, ("cond", "jaccard"))
    assert {(x.best, x.mode) for x in got.collect()} == {(1, "cond"), (1, "jaccard")}
    plan = got._jdf.queryExecution().executedPlan()
    made = []

    def walk(p):
        while p.nodeName() == "AdaptiveSparkPlan" or p.nodeName().endswith("QueryStage"):
            p = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan()
        m = p.metrics()
        if m.contains("numOutputRows"):
            made.append(m.apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    assert made and max(made) < 20_000, max(made)  # all neighbours of all anchors are 1,200,000


def test_a_wide_basket_raises_and_repeats_do_not(spark):
    many = spark.range(30).select(F.lit(1).cast("long").alias("basket"), (F.col("id") % 5).alias("item"))
    assert features.colabel_graph(many, most=5).count() == 10
    with pytest.raises(ValueError, match="5 items, over 4"):
        features.colabel_graph(many, most=4)


def test_pair_lexical_against_tfidf_in_chunks(spark):
    r = random.Random(2)
    words = ["luật", "đất", "strasse", "a", "bbbb", "condition", "no", "xyz123"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(12))) if i % 9 else None, i % 3, 1 << i % 4) for i in range(60)]
    x = spark.createDataFrame(texts, "id long, words string, key int, g long").withColumn("k", F.array(*[F.unhex(F.md5(F.col("key").cast("string")))] * 3)).drop("key")
    pairs = spark.createDataFrame([(a, b, 0.5) for a, b in combinations(range(62), 2) if (a + b) % 5], "a long, b long, cosine double")
    old = lexical.pair_cosine(lexical.char_tfidf(x.where("words is not null"), "id", "words"), pairs.select("a", "b"), "id")
    want = {(p.a, p.b): p.cosine for p in old.collect()}
    for chars in (8_000_000, 300):
        got = {(p.a, p.b): p for p in lexical.pair_lexical(pairs, x, chars=chars).collect()}
        assert set(got) == set(want)
        assert all(p.lexical_cosine == pytest.approx(want[k], abs=1e-9) for k, p in got.items() if max(k) < 60 and all(texts[i][1] is not None for i in k))
        assert all((p.same1, p.both, p.either) == (((a % 3 == b % 3), int(a % 4 == b % 4), len({a % 4, b % 4})) if b < 60 else (False, 0, int(a < 60))) for (a, b), p in got.items())


def test_near_pairs_in_many_buckets_and_chunks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 6))
    x = np.vstack([x, x[:200] + 0.02 * rng.standard_normal((200, 6)), x[0] + 0.01 * rng.standard_normal((60, 6))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for least, bucket in ((0.9, 64), (0.9, 1000), (0.995, 2)):  # chunks of one bucket, one chunk, sign buckets
        want = sorted(zip(*(v.tolist() for v in np.nonzero(np.triu(np.round(u @ u.T, 9) >= least, 1))), strict=True))
        assert [(p[0], p[1]) for p in rows(vector.near_pairs(df, least, bucket=bucket)[0])] == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_search_in_small_blocks_is_one_pass(spark):
    """With a branch a block, every task reported on all branches: messages grew with the square of the blocks."""
    x = spark.range(300).select(F.col("id").alias("doc_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    q = x.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "qid")
    got = vector.topk(q, x, 5, block=7)
    assert plan(got).count("MapInPandas") == 1
    assert rows(got) == rows(vector.topk(q, x, 5))
    parts = vector.topk_parts(q, x, 5, {"all": (0, None), "two": (0, 2)}, block=7)
    assert plan(parts).count("MapInPandas") == 2
    assert rows(parts.where("part = 'two'").drop("part")) == rows(vector.topk(q, x, 5, 0, 2))


def test_best_keeps_ties_by_id_over_batches():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 6, (9, 500)).astype(float)
    s[rng.random(s.shape) < 0.5] = -np.inf
    s[4] = -np.inf
    kept, ids = vector.Best(np.arange(9), 7), rng.permutation(500)
    for at in range(0, 500, 90):
        for lo in (0, 4):
            kept.add(s[lo : lo + (4 if not lo else 5), at : at + 90], ids[at : at + 90], lo)
    got = [tuple(r) for x in kept.rows() for r in x.itertuples(index=False)]
    want = [(i, int(ids[j]), s[i, j]) for i in range(9) for j in np.lexsort((ids, -s[i]))[:7] if s[i, j] > -np.inf]
    assert got == want


def test_lines_are_taken_apart_in_parts(spark):
    long = "\n".join(f"đường {i}." if i % 3 else "" for i in range(60_000))
    texts = ["a\n\nb.", None, "", long, "x\n", long + "\n", "漢字\n𝒳y."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = segment.line_regions(df)
    assert "MapInArrow" in plan(got)  # no text becomes Python's
    want = []
    for i, t in enumerate(texts):
        at = 0
        for j, line in enumerate((t or "").split("\n")):
            want.append((i, j, at, at + len(line), "body" if line.endswith(".") else "gap", line))
            at += len(line) + 1
    assert rows(got) == sorted(want)


def test_the_grid_of_a_tournament_is_not_shuffled(spark):
    x = spark.createDataFrame([(q, d, float(d * q % 7), float(d % 5)) for q in range(4) for d in range(12)], "qid long, doc_id long, a double, b double")
    top = fusion.tournament(x)
    assert "Window" not in plan(top).split("posexplode")[0] and top.count() == 110 * 4 * 5


def test_models_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for x in it:
            seen.add(len(x))
            yield x

    n = 40
    x = spark.createDataFrame([(i, i % 4, float(i % 2), float(i % 5)) for i in range(n)], "id long, fold int, label double, v double").mapInPandas(count, "id long, fold int, label double, v double")
    assert model.logistic_oof(x, ["v"]).count() == n and seen.value == n
    seen.value = 0
    pairs = x.select(F.array("v").alias("x"), F.array("label").alias("y"))
    assert model.pairwise_logistic(pairs, ["v"]).count() == 1 and seen.value <= 2 * n
    seen.value = 0
    arms = x.select("id", "fold", F.array("v", "label", F.col("v") * 2).alias("embedding"), F.col("v").alias("p"), F.col("label").alias("q"))
    assert model.route_arms(arms, ["p", "q"], components=2, trees=2).count() == n and seen.value == n
