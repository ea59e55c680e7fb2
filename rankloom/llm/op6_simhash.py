"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents, group_ids, packed, spanning, whole_groups, words
from rankloom.operators.graph import connected_components
from rankloom.plans.session import cut

RADIUS, SHINGLE, CHUNK = 3, 3, 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text, signed; 0 without words. Long texts go through in slices."""
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(_xx, grams), np.uint64, max(1, len(w) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little")
        ones += part.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _xx(b: bytes) -> int:
    return xxhash.xxh64_intdigest(b, 42)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1)-1 masks, signed. Bit i carries a nonzero vector m(i) of radius+1 bits; mask v keeps the bits
    with odd <m(i), v>. Vectors of any radius differing bits leave some nonzero v orthogonal to them all, so
    some mask drops every differing bit: a pair within the radius always collides in some table."""
    top = 1 << (radius + 1)
    m = [1 + i % (top - 1) for i in range(bits)]
    out = [sum(1 << i for i in range(bits) if (m[i] & v).bit_count() & 1) for v in range(1, top)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def compare(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Verify buckets that arrive sorted; emits a spanning forest of each bucket's links, not its pairs."""
    keys = ["t", "key", "i", "j"]
    for x in whole_groups(batches, keys):
        g = group_ids(x, keys)
        size = np.bincount(g)
        left = size[g] - (np.arange(len(x)) - np.searchsorted(g, g)) - 1  # rows of the group after this one
        fp = x["fp"].to_numpy().view(np.uint64)
        ps, qs = [], []
        for d in range(1, int(size.max())):
            p = np.flatnonzero(left >= d)
            near = p[np.bitwise_count(fp[p] ^ fp[p + d]) <= radius]
            ps.append(near)
            qs.append(near + d)
            if sum(map(len, ps)) > 4_000_000:
                label = spanning(len(x), np.concatenate(ps), np.concatenate(qs))
                ps, qs = [np.flatnonzero(label != np.arange(len(x)))], [label[label != np.arange(len(x))]]
        if ps:
            label = spanning(len(x), np.concatenate(ps), np.concatenate(qs))
            own = np.flatnonzero(label != np.arange(len(x)))
            yield pd.DataFrame({"a": fp[label[own]].view(np.int64), "b": fp[own].view(np.int64)}).drop_duplicates()


def link(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(node, component) of the distinct longs in fps.fp that have another within radius differing bits.

    Each fingerprint enters one bucket of every mask. Buckets over chunk rows are dealt into chunk pairs, so that
    no task holds more than two chunks of one bucket however large it is. Exact: no cap, every pair is met.
    """
    table = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius)))))
    rows = fps.select("fp", table.alias("m")).select("fp", "m.t", "m.key")
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(full, ["t", "key"]).withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    rows = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return connected_components(rows.mapInPandas(lambda it: compare(it, radius), "a long, b long"))


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs' doc_id with fp (long) and component_id, one row per row of docs.

    Null and empty texts have fingerprint 0 and link like any other; texts of any length are read whole; a bit set in
    exactly half of the hashes is 0; an empty table gives an empty result; other columns are not read. Rows with a null doc_id keep their row; a
    component of them alone has a null id. Exact copies share a fingerprint and are compared once.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "fp": np.fromiter(map(fingerprint, x["text"]), np.int64, len(x))})

    rows = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long"))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = link(classes.select("fp"), radius).withColumnRenamed("node", "fp")
    classes = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    groups = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(groups, "component").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: its smallest doc_id; of the rows that repeat that id the first by
    text hash and the other columns, chosen where they are read, so that an id of a third of all rows is one row of
    each task. Rows without a doc_id that no group with one takes in count as one group. Columns are unchanged."""
    found = simhash_groups(docs)
    first = found.groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    rows = packed(docs, id=F.col("doc_id").cast("long"), h=F.xxhash64("text"))
    stay = rows.join(first.select(F.col("doc_id").alias("keep")), F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    rest = [F.col("row")[c.name] for c in docs.schema if c.name not in ("doc_id", "text") and "map<" not in c.dataType.simpleString()]
    return stay.groupBy("id").agg(F.min_by("row", F.struct("h", *rest)).alias("row")).select("row.*")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
