"""Readers and writers: query maps, flexible records, corpora, CSV with a byte-order mark, manifests and submissions."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Names that a record's id and text go by.
ID_NAMES = ("qid", "query_id", "id", "question_id")
TEXT_NAMES = ("question", "query", "text", "content")


def read_query_map(spark: SparkSession, path: str) -> DataFrame:
    """{qid: {question, answer}} or {qid: question}, one file: (qid, pos, question, answer) in file order. A value
    that has no question is an error, and so is a repeated qid: the pairs are read in order, repeats included."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            for text in x["value"]:
                pairs = json.loads(text, object_pairs_hook=lambda p: p)
                seen: set[str] = set()
                rows = []
                for pos, (qid, v) in enumerate(pairs):
                    if qid in seen:
                        raise ValueError(f"repeated qid: {qid}")
                    seen.add(qid)
                    v = dict(v) if isinstance(v, list) else {"question": v}
                    if not isinstance(v.get("question"), str):
                        raise ValueError(f"no question: {qid}")
                    answer = v.get("answer")
                    rows.append((qid, pos, v["question"], None if answer is None else [str(a) for a in answer]))
                yield pd.DataFrame(rows, columns=["qid", "pos", "question", "answer"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "qid string, pos long, question string, answer array<string>")


# The keys a list of records stands under.
WRAPPERS = ("data", "queries", "questions", "items")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question) of a JSON file: a list of records, one under a wrapper key, an object from id to record or text, or JSON
    lines; by the first alias that is there. A record without an id is named __row_ and its number in the file."""

    def records(text: str) -> list[dict]:
        try:
            got = json.loads(text)
        except ValueError:
            got = [json.loads(line) for line in text.splitlines() if line.strip()]
        if isinstance(got, dict):
            under = next((got[k] for k in WRAPPERS if isinstance(got.get(k), list)), None)
            if under is not None:
                got = under
            elif any(isinstance(got.get(k), str) for k in TEXT_NAMES):
                got = [got]
            elif all(isinstance(v, (str, dict)) for v in got.values()):
                got = [{"question": v, "qid": k} if isinstance(v, str) else {"qid": k} | v for k, v in got.items()]
        if not isinstance(got, list) or not all(isinstance(r, dict) for r in got):
            raise ValueError("no list of records")
        return got

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = lambda r, names: next((str(r[n]) for n in names if r.get(n) is not None), None)
        for x in it:
            for text in x["value"]:
                rows = [(first(r, ID_NAMES) or f"__row_{i:06d}", first(r, TEXT_NAMES)) for i, r in enumerate(records(text))]
                yield pd.DataFrame(rows, columns=["qid", "question"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "qid string, question string")


def read_matrix(spark: SparkSession, path: str, width: int, kind: str = "float32", chunk: int = 65_536) -> DataFrame:
    """(row, v array) of a dense matrix file: a one-line header of its shape as the array format writes it, then its numbers in
    row order. The header is checked against width and the file's length; every task reads its own rows."""
    import numpy as np

    if not path.endswith(".npy"):
        raise ValueError("a matrix file ends in .npy")
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        offset = f.tell()
    if fortran or len(shape) != 2 or shape[1] != width or dtype != np.dtype(kind) or fs.get_file_info(at).size != offset + shape[0] * width * dtype.itemsize:
        raise ValueError(f"the matrix is {dtype} {shape}, not {kind} (n, {width})")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for x in it:
            for lo in x["id"]:
                n = min(chunk, shape[0] - lo)
                with own.open_input_file(name) as f:
                    f.seek(offset + lo * width * dtype.itemsize)
                    v = np.frombuffer(f.read(n * width * dtype.itemsize), dtype).reshape(n, width)
                yield pd.DataFrame({"row": np.arange(lo, lo + n), "v": list(v)})

    parts = max(1, -(-shape[0] // chunk))
    element = {"float32": "float", "float64": "double", "int32": "int", "int64": "long"}[kind]
    return spark.range(0, shape[0], chunk, numPartitions=parts).mapInPandas(run, f"row long, v array<{element}>")


def decode_ranking(index: DataFrame, ids: DataFrame, score: str | None = None) -> DataFrame:
    """(qid, doc_id, rank[, score]) of index (qid, v array of document numbers, in rank order) and ids (row, doc_id); numbers below
    zero are empty places, one that is not in ids raises."""
    cells = F.posexplode("v") if score is None else F.posexplode(F.arrays_zip("v", score))
    x = index.select("qid", cells.alias("pos", "c"))
    x = x.select("qid", (F.col("pos") + 1).cast("long").alias("rank"), (F.col("c") if score is None else F.col("c.v")).cast("long").alias("row"), *([] if score is None else [F.col(f"c.{score}").alias("score")]))
    x = x.where("row >= 0").join(ids, "row", "left")
    bad = F.assert_true(F.col("doc_id").isNotNull(), F.concat(F.lit("no document of number "), F.col("row").cast("string")))
    return x.select("qid", F.coalesce(bad.cast(dict(ids.dtypes)["doc_id"]), F.col("doc_id")).alias("doc_id"), "rank", *([] if score is None else ["score"]))


def write_corpus(docs: DataFrame, path: str) -> None:
    """JSON lines with keys in order; text as it is, null fields left out. Each task writes its own file."""
    docs.select(F.to_json(F.struct(*sorted(docs.columns))).alias("value")).write.mode("errorifexists").text(path, lineSep="\n")


def report(rows: DataFrame, title: str) -> tuple[str, str]:
    """A report of a few rows, such as a metric table: its JSON (indent 2, a last newline) and its Markdown companion. More than
    10,000 rows are no report and raise."""
    got = rows.limit(10_001).collect()
    if len(got) > 10_000:
        raise ValueError("a report holds 10,000 rows at most")
    names = rows.columns
    body = json.dumps({"title": title, "rows": [dict(zip(names, r, strict=True)) for r in got]}, ensure_ascii=False, indent=2, default=str) + "\n"
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)]
    return body, "\n".join(lines) + "\n"


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """report()'s two texts as path.json and path.md, one file each in a folder any session can write."""
    for text, end in zip(report(rows, title), ("json", "md"), strict=True):
        one = rows.sparkSession.createDataFrame([(text.removesuffix("\n"),)], "value string")
        one.coalesce(1).write.mode("errorifexists").text(f"{path}.{end}", lineSep="\n")


def register_views(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """The tables of a folder as temporary views."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)


def read_corpus(spark: SparkSession, path: str, schema: str = "id string, name string, link string, passage string, source_file string") -> DataFrame:
    """JSON lines with a fixed schema; nulls become empty strings, blank lines are skipped."""
    return spark.read.schema(schema).json(path).fillna("")


def read_corpus_dir(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per document; the id falls back to the file's stem. Repeated ids raise."""
    rows = spark.read.option("multiLine", True).schema("id string, name string, link string, passage string").json(f"{path}/context_*.json")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = rows.select(F.coalesce("id", stem).alias("id"), "name", "link", "passage", stem.alias("source_file")).fillna("")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("repeated document id")
    return rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and perhaps a byte-order mark."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the first name carries a byte-order mark."""
    df.toDF(*(("﻿" if i == 0 else "") + c for i, c in enumerate(df.columns))).write.mode("errorifexists").csv(path, header=True)


def manifest(spark: SparkSession, path: str, chunk: int = 16 << 20) -> DataFrame:
    """(path, size_bytes, sha256) of every file below path, hashed where it is read, a chunk at a time, so that files of any
    size can be. Where only the engine can open the store, files go through it whole."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if path.partition("://")[0] not in (path, "file", "hdfs", "s3", "gs", "abfs"):
        return rows.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            out = []
            for name, size in zip(x["path"], x["length"], strict=True):
                fs, at = pafs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                h = hashlib.sha256()
                with fs.open_input_stream(at) as f:
                    while part := f.read(chunk):
                        h.update(part)
                out.append((name, size, h.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "size_bytes", "sha256"])

    return rows.select("path", "length").mapInPandas(run, "path string, size_bytes long, sha256 string")


def unsafe_paths(files: DataFrame, root: str) -> DataFrame:
    """Files of a manifest that lie outside root or reach out of it by a dot-dot part: what a bundle must not unpack."""
    inside = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").startswith(root.partition("://")[2] or root)
    return files.where(~inside | F.col("path").rlike(r"(^|/)\.\.(/|$)"))


def manifest_diff(now: DataFrame, then: DataFrame) -> DataFrame:
    """Files of then that are missing or changed in now."""
    return then.join(now, ["path", "size_bytes", "sha256"], "left_anti")


def snapshot_fingerprint(files: DataFrame) -> DataFrame:
    """One row (n_files, size_bytes, fingerprint) of a manifest: SHA-256 over its files' names and hashes in name order.
    A snapshot's manifest is a short list, whatever its files hold."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    line = F.array_sort(F.collect_list(F.concat_ws(" ", name, F.col("sha256"))))
    return files.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.sha2(F.array_join(line, "\n"), 256).alias("fingerprint"))


def export_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Tables as Parquet below a new folder, with a manifest table beside them; returns the manifest. Each executor
    writes and hashes its own files; an existing folder is an error."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    files = manifest(spark, path).where(F.col("path").endswith(".parquet"))
    files.write.mode("errorifexists").parquet(f"{path}-manifest")
    return spark.read.parquet(f"{path}-manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, root: str, contract: dict, make) -> DataFrame:
    """The table of make(), kept under the hash of its contract with the contract beside it. A finished one is read and never
    written again; a folder without the mark of a finished write is made anew."""
    text = json.dumps(contract, sort_keys=True)
    at = f"{root}/{hashlib.sha256(text.encode()).hexdigest()}"
    if not _exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}-contract")
    return spark.read.parquet(at)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def top5(ranks: DataFrame, k: int = 5) -> DataFrame:
    """(qid, answer): the first k distinct documents in order."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d"))))
    return ranks.where(F.col("rank") <= k).groupBy("qid").agg(F.array_distinct(F.transform(pairs, lambda x: x["d"])).alias("answer"))


def submission_faults(answers: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(qid, fault) of answers (qid, answer) that are not k different ids of docs (doc_id)."""
    ids = answers.select("qid", F.explode_outer("answer").alias("d"))
    known = docs.select(F.col("doc_id").cast("string").alias("d")).distinct().withColumn("_k", F.lit(1))
    per = ids.join(known, "d", "left").groupBy("qid").agg(F.count("d").alias("n"), F.count_distinct("d").alias("u"), F.count_if(F.col("d").isNotNull() & F.col("_k").isNull()).alias("bad"))
    fault = F.when(F.col("n") != k, "not as many answers").when(F.col("u") != F.col("n"), "an answer twice").when(F.col("bad") > 0, "an unknown document")
    return per.select("qid", fault.alias("fault")).where("fault is not null")


def write_submission(answers: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """Where docs (doc_id) is given, faulty answers raise. A zip with {qid: {"answer": [...]}}, the same bytes for the same answers; read back and compared. Answers are
    one short row per query of a stated query set."""
    if docs is not None and (bad := submission_faults(answers, docs).orderBy("qid").first()):
        raise ValueError(f"{bad.qid}: {bad.fault}")
    got = {r.qid: {"answer": list(r.answer)} for r in answers.selectExpr("cast(qid as string) qid", "answer").orderBy("qid").toLocalIterator()}
    body = json.dumps(got, ensure_ascii=False, sort_keys=True, indent=2) + "\n"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr(zipfile.ZipInfo("submission.json", (2020, 1, 1, 0, 0, 0)), body)
    with zipfile.ZipFile(path) as f:
        if json.loads(f.read("submission.json")) != got:
            raise ValueError("submission differs after reading back")
