"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import documents, packed, word_count
from rankloom.plans.session import cut

WEIGHTS, LIMIT, BLOCK = (5, 2, 1), 3, 4096


def _unit(c: Column) -> Column:
    """A hashed number in [0, 1) with 32 bits, the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes (source, source_size, ...) with target: all sizes shared by weights that repeat over the sources in
    code-point order, null last; none above limit times its size, the excess reshared by weight.

    Water-filling in closed form: sorted by limit*size/weight, the capped sources are a prefix; with the first k
    capped, the rest get level(k) = (total - capped) / weight left, and a source is capped while its own ratio is
    below the level that counts it as open. One row per source, so the unpartitioned windows are small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ratio = W.orderBy((limit * F.col("source_size") / F.col("_w")), F.col("source").asc_nulls_last())
    before, every = ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_open"))
    s = s.withColumn("_stops", limit * F.col("source_size") / F.col("_w") <= F.col("_level"))
    s = s.withColumn("_rank", F.row_number().over(ratio))
    s = s.withColumn("_at", F.min(F.when(~F.col("_stops"), F.struct("_rank", "_level"))).over(every)["_level"])
    target = F.when(F.col("_stops"), (limit * F.col("source_size")).cast("double")).otherwise(F.col("_at") * F.col("_w"))
    return s.withColumn("target", target).drop("_w", "_open", "_left", "_level", "_stops", "_rank", "_at")


def _numbered(docs: DataFrame, weights: tuple, limit: int, block: int) -> tuple[DataFrame, int]:
    """One row per distinct (source, doc_id, size, th), th a hash of the text: how many rows it stands for (m), the
    expected copies' place before it (nth), the source's rate and offset u, and its sizes. Also the largest m."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.withColumn("source_key", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    rows = rows.withColumn("class", F.floor(4 * F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int"))
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), "th"))
    rows = rows.withColumn("h", F.conv(F.substring(h, 1, 8), 16, 10).cast("long"))
    rows = cut(rows.groupBy("source_key", "class", "h", "doc_id", "size", "th").agg(F.count("*").alias("m")))

    most = rows.agg(F.max("m")).first()[0] or 0
    classes = rows.groupBy("source_key", "class").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("size")).alias("words"))
    sums = classes.groupBy("source_key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(~F.col("source_key.n"), F.col("source_key.s")))
    goal = targets(sums, weights, limit).drop("source")
    w = W.partitionBy("source_key").orderBy("class")
    classes = classes.withColumn("class_before", F.sum("n").over(w) - F.col("n")).withColumn("k", F.ceil(F.col("n") / block)).drop("n", "words")
    classes = classes.join(goal, "source_key")

    rows = rows.join(F.broadcast(classes) if classes.count() <= 20_000 else classes, ["source_key", "class"])
    rows = rows.withColumn("b", F.floor(F.col("h") * F.col("k") / F.lit(4294967296.0)))
    blocks = rows.groupBy("source_key", "class", "b").agg(F.sum("m").alias("n"))
    w = W.partitionBy("source_key", "class").orderBy("b")
    blocks = blocks.withColumn("block_before", F.sum("n").over(w) - F.col("n")).drop("n")
    rows = rows.join(blocks, ["source_key", "class", "b"])
    w = W.partitionBy("source_key", "class", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "th")
    nth = F.col("class_before") + F.col("block_before") + F.sum("m").over(w) - F.col("m")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    source = F.when(~F.col("source_key.n"), F.col("source_key.s")).alias("source")
    rows = rows.select("doc_id", source, "size", "th", "source_size", "target", "m", nth.alias("nth"), rate.alias("rate"))
    return rows.withColumn("u", _unit(F.coalesce("source", F.lit("<null>")))), most


def _crossed(before: Column, n: Column | int) -> Column:
    """Integer boundaries that n rows from the place before cross."""
    return (F.floor(F.col("rate") * (before + n) + F.col("u")) - F.floor(F.col("rate") * before + F.col("u"))).cast("long")


def _repeated(rows: DataFrame, n: str, number: str, most: int, chunk: int = BLOCK) -> DataFrame:
    """Each row n times, at most most, numbered from 0. Where that may be over chunk, a row's chunks are dealt out first,
    so that no task makes more than chunk rows of one."""
    first = F.lit(0).cast("long")
    if most > chunk:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col(n) - 1) / chunk)))).repartition(tasks)
        first = F.col("_chunk") * chunk
    return rows.withColumn(number, F.explode(F.sequence(first, F.least(first + chunk, F.col(n)) - 1))).drop("_chunk")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """docs' doc_id and source with size, source_size, target, copies and taken (= copies * size).

    Every document of a source expects target/source_size copies. In the order (size class, hash of doc_id, size and
    text, doc_id, size, text's hash) the expected copies are prefix-summed within the source, one hashed offset is
    added, and a document is emitted once for every integer boundary its interval crosses. Size classes of a fourth
    of a doubling are each sampled in proportion, so the words taken come near the target. The prefix sum runs over
    blocks of about block documents (class and range of the hash) and then within the block: a source with a third
    of all rows is many blocks, and no window holds more than one of them, one class's block totals or one source's
    classes. Rows that agree in doc_id, source and text are counted before anything is shuffled and take neighbouring
    places, so a repeated row is one row of its block; rows that share a doc_id alone are told apart by their texts,
    and reruns agree whatever the partitions. Null and empty texts have size 0, expect copies like the others and
    take nothing. A null source is a source of its own, and null ids are alike. An empty table gives an empty result.
    """
    rows, most = _numbered(docs, weights, limit, block)
    rows = _repeated(rows, "m", "i", most)
    copies = _crossed(F.col("nth") + F.col("i"), 1)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, columns unchanged, extra ones too.

    Rows that are alike in all columns are counted before they are shuffled; rows that share doc_id, source and text
    and differ elsewhere take the key's places in the order of a hash of the whole row.
    """
    takes, most = _numbered(docs, weights, limit, block)
    takes = takes.where(_crossed(F.col("nth"), F.col("m")) > 0).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("th").alias("_th"), "m", "nth", "rate", "u")
    rows = packed(docs, id=F.col("doc_id"), source=F.col("source"), th=F.md5(F.coalesce("text", F.lit(""))))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("th") == F.col("_th"))
    if most > 1:
        rows = rows.groupBy("row", "id", "source", "th").agg(F.count("*").alias("c")).join(takes, same)
        w = W.partitionBy("id", "source", "th").orderBy(F.xxhash64("row"))
        before = F.col("nth") + F.sum("c").over(w) - F.col("c")
    else:
        rows = rows.withColumn("c", F.lit(1).cast("long")).join(takes, same)
        before = F.col("nth")
    out = rows.select("row", _crossed(before, F.col("c")).alias("own")).where("own > 0")
    return _repeated(out, "own", "i", limit * most + 1).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS th FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
r AS (SELECT *, row_number() OVER o AS k,
  sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
  sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w WINDOW o AS (ORDER BY 3 * source_size::DOUBLE / w, source NULLS LAST)),
v AS (SELECT *, rest::DOUBLE / open::DOUBLE AS level, 3 * source_size::DOUBLE / w <= rest::DOUBLE / open::DOUBLE AS stops FROM r),
t AS (SELECT source, source_size, CASE WHEN stops THEN 3.0::DOUBLE * source_size
  ELSE (SELECT arg_min(level, k) FROM v WHERE NOT stops) * w END AS target FROM v),
n AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
  ('0x' || substr(md5(coalesce(d.source, '<null>')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY floor(4 * log2(greatest(size, 1)::DOUBLE))::INT,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, th)), 1, 8))::BIGINT, doc_id NULLS FIRST, size, th) AS nth
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate * nth + u) - floor(rate * (nth - 1) + u)))::BIGINT AS taken FROM n
"""
