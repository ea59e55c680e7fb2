"""Variable-capacity best-fit packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents
from rankloom.llm.op4_records import encoder
from rankloom.plans.session import cut

#: Permitted sequence lengths, what opening a bin costs besides its length, and pieces packed together.
CAPACITIES, OVERHEAD, GROUP = (512, 1024, 2048, 4096), 16, 4096
_BATCH_CHARS = 3 << 20


def cheapest(size: int, left: np.ndarray, capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity of least cost per packed token for a new bin that starts with size, filled up greedily with the
    lengths still left (a histogram), the longest that fits first."""
    best, at = None, capacities[-1]
    for c in capacities:
        if c < size:
            continue
        room, fill, longest = c - size, size, c
        while n := _longest(left, min(room, longest)):
            k = min(int(left[n]), room // n)
            fill, room, longest = fill + k * n, room - k * n, n - 1
        cost = (c + overhead) / fill
        if best is None or cost < best:
            best, at = cost, c
    return at


def _longest(left: np.ndarray, room: int) -> int:
    """The longest length up to room of which some are left, 0 if none."""
    some = np.flatnonzero(left[1 : room + 1])
    return int(some[-1]) + 1 if len(some) else 0


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each size, capacity of each bin). Longest first; each goes into the open bin with the least room that
    holds it, else into a new bin of the cheapest capacity; at the end each bin is cut down to the least permitted
    capacity that holds its contents. Sizes lie between 1 and the largest capacity."""
    capacities = tuple(sorted(capacities))
    left = np.bincount(sizes, minlength=capacities[-1] + 1)
    bins, fill, room = np.zeros(len(sizes), np.int64), [], []
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        left[n] -= 1
        k = bisect_left(room, (n, -1))
        if k < len(room):
            r, b = room.pop(k)
        else:
            b, r = len(fill), cheapest(n, left, capacities, overhead)
            fill.append(0)
        bins[i] = b
        fill[b] += n
        if r > n:
            insort(room, (r - n, b))
    caps = np.array(capacities)
    return bins, caps[np.searchsorted(caps, fill)] if fill else np.zeros(0, np.int64)


def _encoded(docs: DataFrame, path: str, top: int) -> DataFrame:
    """doc_id, th (hash of the text), piece, start, n_tokens and ids of every piece of docs' whole texts; ids in as few
    bytes each as the vocabulary needs."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for x in it:
            for _, y in x.groupby(x["text"].str.len().cumsum() // _BATCH_CHARS, sort=False):
                rows = []
                for i, th, blob in zip(y["doc_id"], y["th"], encode(y["text"].tolist()), strict=True):
                    ids = np.frombuffer(blob, encode.dtype)
                    rows += [(i, th, k, k * top, len(p), p.tobytes()) for k, p in enumerate(np.split(ids, range(top, len(ids), top)))]
                out = pd.DataFrame(rows, columns=["doc_id", "th", "piece", "start", "n_tokens", "ids"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return rows.mapInPandas(run, "doc_id long, th long, piece int, start long, n_tokens long, ids binary")


def best_fit(docs: DataFrame, path: str | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, capacity, fill, at and ids: one row per piece of every row of docs.

    A document's tokens are those of its whole text under a public vocabulary and an end mark, so null and empty texts
    are one token. Documents over the largest capacity are cut into pieces of it and a rest; nothing is dropped. at is
    a piece's place in its bin and ids its tokens, so a bin's pieces by at are the sequence (see sequences). Pieces
    are hashed into groups of about group, counted in pieces, and each is packed by itself: memory is bounded by the
    group, and the waste from closing a group's last bins is below one in some thousands. Within a group the order
    is by length, id, piece and text, so ties are settled and reruns agree. Where rows repeat, they are pieces of their
    own and dealt over the groups by the part of the encoded table they are in; the others' bins don't depend on
    parts. An empty table gives an empty result; other columns of docs are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = cut(_encoded(docs, path, max(capacities)).withColumn("part", F.spark_partition_id()))
    groups = max(1, -(-rows.count() // group))
    twice = rows.where("piece = 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    twice = cut(twice.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    if not twice.isEmpty():
        rows = rows.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
        rows = rows.withColumn("part", F.when(F.col("_th").isNotNull(), F.col("part"))).drop("_id", "_th")
    else:
        rows = rows.withColumn("part", F.lit(None).cast("int"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "th", "piece", "part"), F.lit(groups))).drop("part")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["n_tokens", "doc_id", "piece", "th"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        n = x["n_tokens"].to_numpy()
        bins, caps = pack(n, capacities, overhead)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        at = np.empty(len(n), np.int64)
        at[order] = before - np.maximum.accumulate(np.where(np.r_[True, np.diff(bins[order]) != 0], before, 0))
        x = x.assign(bin_id=(int(x["g"].iloc[0]) << 24) + bins, capacity=caps[bins], fill=np.bincount(bins, n).astype(np.int64)[bins], at=at)
        x["ids"] = [np.frombuffer(b, f"<u{len(b) // k}").astype(np.int32) for b, k in zip(x["ids"], n, strict=True)]
        return x[["doc_id", "piece", "start", "n_tokens", "bin_id", "capacity", "fill", "at", "ids"]]

    return rows.groupBy("g").applyInPandas(run, "doc_id long, piece int, start long, n_tokens long, bin_id long, capacity long, fill long, at long, ids array<int>")


def sequences(packed: DataFrame, pad: int = 0) -> DataFrame:
    """bin_id, capacity, doc_ids and ids of every bin of best_fit's result: the pieces' tokens one after the other,
    filled up with pad to the capacity. A bin holds no more than its capacity, so no group is large."""
    rows = packed.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "ids"))).alias("x"))
    ids = F.flatten(F.transform("x", lambda p: p["ids"]))
    ids = F.concat(ids, F.array_repeat(F.lit(pad), (F.col("capacity") - F.size(ids)).cast("int")))
    return rows.select("bin_id", "capacity", F.transform("x", lambda p: p["doc_id"]).alias("doc_ids"), ids.alias("ids"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir)).drop("ids")
