import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.sources import io
from rankloom.streaming import events as ev


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_repeated_keys_and_missing_questions_raise(spark, tmp_path):
    for text, what in (('{"a": "x", "a": "y"}', "repeated qid"), ('{"a": {"answer": []}}', "no question")):
        (tmp_path / "q.json").write_text(text)
        with pytest.raises(Exception, match=what):
            io.read_query_map(spark, str(tmp_path / "q.json")).collect()


def test_records_in_every_form(spark, tmp_path):
    forms = {
        "list": '[{"query_id": 5, "text": "t"}, {"content": "u"}]',
        "data": '{"version": 1, "data": [{"id": "5", "question": "t"}, {"text": "u"}]}',
        "items": '{"items": [{"question_id": 5, "query": "t"}, {"question": "u"}]}',
        "lines": '{"qid": 5, "question": "t"}\n{"question": "u"}\n',
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        assert rows(io.read_records(spark, str(tmp_path / name))) == [("5", "t"), ("__row_000001", "u")], name
    (tmp_path / "map").write_text('{"a": "t", "b": {"text": "u"}, "c": {"qid": "own", "question": "v"}}')
    assert rows(io.read_records(spark, str(tmp_path / "map"))) == [("a", "t"), ("b", "u"), ("own", "v")]
    (tmp_path / "bad").write_text('{"data": 3}')
    with pytest.raises(Exception, match="no list of records"):
        io.read_records(spark, str(tmp_path / "bad")).collect()


def test_corpus_of_lines_and_of_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "name": "n", "passage": "p"}\n\n{"id": "2"}\n')
    got = rows(io.read_corpus(spark, str(tmp_path / "c.jsonl")).select("id", "name", "passage"))
    assert got == [("1", "n", "p"), ("2", "", "")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/context_7.json").write_text('{"name": "n", "passage": "p"}')
    (tmp_path / "d/context_8.json").write_text('{"id": "x",\n "passage": "q"}')
    assert rows(io.read_corpus_dir(spark, str(tmp_path / "d")).select("id", "passage")) == [("context_7", "p"), ("x", "q")]
    (tmp_path / "d/context_9.json").write_text('{"id": "x"}')
    with pytest.raises(ValueError, match="repeated"):
        io.read_corpus_dir(spark, str(tmp_path / "d"))


def test_matrix_is_read_by_rows_and_checked(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((1000, 7)).astype(np.float32)
    np.save(tmp_path / "m.npy", x)
    got = io.read_matrix(spark, str(tmp_path / "m.npy"), 7, chunk=64).orderBy("row").collect()
    assert [r.row for r in got] == list(range(1000))
    assert np.array_equal(np.array([r.v for r in got], np.float32), x)
    with pytest.raises(ValueError, match="not float32"):
        io.read_matrix(spark, str(tmp_path / "m.npy"), 8)
    np.save(tmp_path / "i.npy", x.astype(np.int32))
    assert io.read_matrix(spark, str(tmp_path / "i.npy"), 7, "int32").count() == 1000


def test_ranking_is_decoded(spark):
    x = spark.createDataFrame([(1, [2, 0, -1], [0.5, 0.25, 0.0])], "qid long, v array<int>, s array<double>")
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row long, doc_id string")
    assert rows(io.decode_ranking(x, ids, "s")) == [(1, "a", 2, 0.25), (1, "c", 1, 0.5)]
    assert rows(io.decode_ranking(x, ids)) == [(1, "a", 2), (1, "c", 1)]
    with pytest.raises(Exception, match="no document of number 2"):
        io.decode_ranking(x, ids.where("row < 2")).collect()


def test_corpus_and_report_are_written(spark, tmp_path):
    x = spark.createDataFrame([("b", "ö\n1"), ("a", None)], "name string, id string")
    io.write_corpus(x.coalesce(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text == '{"id":"ö\\n1","name":"b"}\n{"name":"a"}\n'
    io.write_report(spark.createDataFrame([(5, 0.5)], "k int, recall double"), str(tmp_path / "r"), "Recall")
    body = "".join(p.read_text() for p in (tmp_path / "r.json").glob("part-*"))
    assert json.loads(body) == {"title": "Recall", "rows": [{"k": 5, "recall": 0.5}]} and body.endswith("}\n")
    assert "| 5 | 0.5 |" in "".join(p.read_text() for p in (tmp_path / "r.md").glob("part-*"))


def test_late_events_are_dropped_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    at = lambda *xs: spark.createDataFrame([(i, f"2024-01-01 {t}", 1, "k", 1.0, "") for i, t in enumerate(xs)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    at("00:10:00", "00:20:00").write.parquet(f"{src}/events_0.parquet")
    q = None
    for k, more in enumerate((("05:00:00",), ("00:30:00", "05:10:00"))):
        q = ev.tumbling(spark.readStream.schema(ev.EVENTS).option("recursiveFileLookup", True).parquet(src), "1 hour", late="1 hour").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        at(*more).write.parquet(f"{src}/events_{k + 1}.parquet")
    q = ev.tumbling(spark.readStream.schema(ev.EVENTS).option("recursiveFileLookup", True).parquet(src), "1 hour", late="1 hour").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(str(r.window_start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("2024-01-01 00:00:00", 2)]  # 00:30 came after the watermark had passed its window


def test_scoring_resumes_and_repeats_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    once = lambda: ev.score_once(spark.readStream.schema("id long").parquet(src), lambda df: df.select("id", (F.col("id") * 2).alias("s")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    spark.range(5).write.parquet(src)
    once()
    once()
    spark.range(5, 8).write.mode("append").parquet(src)
    once()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("id", "s")) == [(i, 2 * i) for i in range(8)]


def test_sliding_windows_overlap(spark):
    x = spark.createDataFrame([(0, "2024-01-01 01:30:00", 1.0), (1, "2024-01-01 02:30:00", 2.0)], "event_id long, t string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    got = {str(r.window_start)[11:16]: (r.n, r.total) for r in ev.sliding(x).collect()}
    assert got == {"00:00": (1, 1.0), "01:00": (2, 3.0), "02:00": (1, 2.0)}


def test_views_are_registered(spark, sf):
    io.register_views(spark, sf)
    assert spark.sql("SELECT count(*) FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)").first()[0] == 25


def test_half_written_tables_are_made_anew(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    io.cached(spark, str(tmp_path), {"a": 1}, make)
    (folder,) = [p for p in tmp_path.iterdir() if not p.name.endswith("-contract")]
    assert json.loads("".join(p.read_text() for p in (tmp_path / f"{folder.name}-contract").glob("part-*"))) == {"a": 1}
    assert io.cached(spark, str(tmp_path), {"a": 1}, make).count() == 3 and len(made) == 1
    (folder / "_SUCCESS").unlink()
    assert io.cached(spark, str(tmp_path), {"a": 1}, make).count() == 3 and len(made) == 2


def test_manifest_hashes_by_chunks_and_tells_unsafe_paths(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    data = np.random.default_rng(2).bytes(100_000)
    (tmp_path / "in/x").write_bytes(data)
    got = io.manifest(spark, str(tmp_path / "in"), chunk=4096).collect()
    assert [(r.size_bytes, r.sha256) for r in got] == [(100_000, hashlib.sha256(data).hexdigest())]
    x = spark.createDataFrame([("file:/a/b/c",), ("file:///a/b/../c",), ("/a/other",), ("/a/b/d",)], "path string")
    assert sorted(r.path for r in io.unsafe_paths(x, "/a/b").collect()) == ["/a/other", "file:///a/b/../c"]


def test_faulty_submissions_raise(spark, tmp_path):
    docs = spark.createDataFrame([(i,) for i in range(9)], "doc_id long")
    x = spark.createDataFrame([(1, ["0", "1", "2", "3", "4"]), (2, ["0", "1"]), (3, ["0", "0", "1", "2", "3"]), (4, ["0", "1", "2", "3", "77"])], "qid long, answer array<string>")
    assert rows(io.submission_faults(x, docs)) == [(2, "not as many answers"), (3, "an answer twice"), (4, "an unknown document")]
    io.write_submission(x.where("qid = 1"), str(tmp_path / "z"), docs)
    with pytest.raises(ValueError, match="2: not as many"):
        io.write_submission(x, str(tmp_path / "z"), docs)
