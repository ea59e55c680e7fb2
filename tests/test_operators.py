import os
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import fusion, graph, metrics, segment, select
from rankloom.sources import io


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (None, 3), (500, 499), (500, 499)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(100, 161)} == {100}
    assert {got[k] for k in range(1, 40)} == {1}
    assert got[500] == got[499] == 499
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_against_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    top = list(range(200))
    for _ in range(200):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[a] == top[a] and got[b] == top[b] for a, b in edges if a != b)


def test_metric_basics(spark):
    ranks = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (1, 14, 5), (2, 20, 1), (2, 20, 2)], "qid long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 10), (1, 99), (2, 20), (3, 5)], "qid long, doc_id long")
    got = {r.qid: (r.recall, r.precision) for r in metrics.per_query(ranks, gold).collect()}
    assert got == {1: (0.5, 0.2), 2: (1.0, 0.5), 3: (0.0, 0.0)}


def test_rrf_tie_goes_to_the_smaller_id_and_source_order_is_immaterial(spark):
    x = [("A", 1, 1, 1), ("A", 1, 2, 2), ("B", 1, 2, 1), ("B", 1, 1, 2)]
    s = "source string, qid long, doc_id long, rank int"
    a, b = (rows(fusion.rrf(spark.createDataFrame(y, s)).select("qid", "doc_id", "rank")) for y in (x, x[::-1]))
    assert a == b == [(1, 1, 1), (1, 2, 2)]


def test_constant_rows_have_z_zero_and_deviation_is_population(spark):
    x = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 1.0), (2, 2.0), (2, 4.0), (2, 9.0)], "qid long, s double")
    got = rows(x.select("qid", "s", F.round(fusion.z(F.col("s")), 4), F.round(F.stddev_pop("s").over(fusion.by_query()), 4)))
    assert got[0] == (1, 3.0, 0.0, 0.0)
    assert got[-1] == (2, 9.0, round(5 / 3.0822, 4), 3.0822)


def test_missing_source_constants(spark):
    x = spark.createDataFrame([("A", 1, 5, 1, 0.9), ("A", 1, 6, 2, 0.1), ("B", 1, 6, 1, 0.3)], "source string, qid long, doc_id long, rank int, score double")
    r = fusion.candidate_features(x, ["A", "B"]).where("doc_id = 5").first()
    assert (r.B_present, r.B_rr10, r.B_rank, r.B_z, r.B_gap) == fusion.MISSING


def test_packing_splits_oversized_regions_and_keeps_documents_apart(spark):
    x = spark.createDataFrame([(1, i, n) for i, n in enumerate((4, 5, 3, 12, 10, 1))] + [(2, 0, 4)], "doc_id long, region long, n long")
    got = rows(segment.coarse_pack(x, 10))
    assert [n for d, _, n in got if d == 1] == [9, 3, 10, 2, 10, 1]
    assert [n for d, _, n in got if d == 2] == [4]


def test_windows_stop_at_the_first_that_reaches_the_end(spark):
    x = spark.createDataFrame([(1, 25), (2, 0), (3, 5)], "doc_id long, n long")
    assert rows(segment.token_windows(x, 10, 5).select("doc_id", "start")) == [(1, 0), (1, 5), (1, 10), (1, 15), (3, 0)]


def test_split(spark):
    x = spark.createDataFrame([(1, 21), (2, 0)], "doc_id long, n long")
    assert rows(segment.atomic_split(x, 10).select("doc_id", "piece", "n_tokens")) == [(1, 0, 10), (1, 1, 10), (1, 2, 1), (2, 0, 0)]


def test_word_class_and_folding(spark):
    x = spark.createDataFrame([("Straße é Điều 12_a ² 漢字",)], "t string")
    assert x.select(tx.tokens(F.col("t"))).first()[0] == ["strasse", "é", "điều", "12_a", "²", "漢字"]
    assert x.select(tx.word_count(F.lit(None).cast("string"))).first()[0] == 0


def test_auc_by_rank_sums(spark):
    x = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 0), (1, 0.5, 1), (1, 0.1, 0), (2, 1.0, 1)], "qid long, score double, label int")
    assert rows(metrics.query_auc(x)) == [(1, 0.875)]


def test_nested_weight_never_sees_its_fold(spark):
    x = [(w, f, float(w == 0.5 or f == 0), 1) for w in (0.0, 0.5) for f in (0, 1, 2)]
    got = rows(select.leave_one_fold_out(spark.createDataFrame(x, "w double, fold long, recall double, n long")).select("held", "w"))
    assert got == [(0, 0.5), (1, 0.5), (2, 0.5)]


def test_query_map_keeps_file_order(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"b": {"question": "x?", "answer": ["1", "2"]}, "a": "y?"}')
    got = io.read_query_map(spark, str(tmp_path / "q.json")).orderBy("pos").collect()
    assert [(r.qid, r.question, r.answer) for r in got] == [("b", "x?", ["1", "2"]), ("a", "y?", None)]


def test_records_by_alias_and_csv_with_a_mark(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"query_id": 5, "text": "t"}, {"text": "u"}]')
    got = rows(io.read_records(spark, str(tmp_path / "r.json")))
    assert got == [("5", "t"), ("__row_000001", "u")]
    x = spark.createDataFrame([(1, "a,b")], "k int, v string")
    io.write_csv(x.coalesce(1), str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c")).collect()[0].asDict() == {"k": "1", "v": "a,b"}


def test_submission_bytes_repeat(spark, tmp_path):
    x = io.top5(spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "qid long, doc_id long, rank int"))
    for n in "ab":
        io.write_submission(x, str(tmp_path / n))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()


def test_manifest_and_cache(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_text("1")
    then = spark.createDataFrame(io.manifest(spark, str(tmp_path / "d")).collect())
    (tmp_path / "d/x").write_text("2")
    assert io.manifest_diff(io.manifest(spark, str(tmp_path / "d")), then).count() == 1
    made = []
    for _ in range(2):
        got = io.cached(spark, str(tmp_path / "k"), {"a": 1}, lambda: made.append(1) or spark.range(3))
    assert got.count() == 3 and len(made) == 1


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    from rankloom.streaming import events as ev

    batch = rows(ev.tumbling(spark.read.parquet(f"{sf}/events.parquet"), "1 day").select("window_start", "event_type", "n"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = ev.tumbling(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("w").select("window_start", "event_type", "n")) == batch


def test_queries_match_their_sql(spark, sf):
    import duckdb

    from rankloom.plans import catalog

    c = duckdb.connect()
    for t in "region lineitem events documents embeddings pages benchmark labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = catalog.oracle_sql()
    for k in ("bm25_topk", "candidate_features", "z_blend_grid", "greedy_pack", "components", "colabel_score", "query_auc"):
        df = catalog.queries()[k](spark, sf)
        r = c.execute(sql[k])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns), k
        fix = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
        a = sorted(str([fix(x[n]) for n in sorted(names)]) for x in df.collect())
        b = sorted(str([fix(x[names.index(n)]) for n in sorted(names)]) for x in r.fetchall())
        assert a == b, k


def test_no_query_set_is_missing_its_twin():
    from rankloom.plans import catalog

    rest = set(catalog.queries()) - set(catalog.oracle_sql())
    fitted = {"logistic_oof", "boosted_oof", "kmeans_profile", "kmeans_choice", "nested_priors", "pairwise_logistic", "routed_arms"}
    assert rest == fitted | {"nfkc_keys", "snapshot_fingerprint", "token_counts"}  # SQL has no NFKC, files or vocabularies
    with pytest.raises(KeyError):
        catalog.queries()["none"]


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) < set(q) and len(q) > 150; print('fine')"
    got = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]
