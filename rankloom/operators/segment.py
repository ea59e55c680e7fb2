"""Segmentation into regions, pieces, packs and windows. Everything but the packing fold is a projection or a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text taken apart at a time; a longer text goes by itself.
PART = 2**20


def line_regions(docs: DataFrame, marker: str = r"\.$", key: str = "doc_id") -> DataFrame:
    """Lines as regions with offsets: (doc_id, region, start, end, kind, line). A line that matches marker is a body line,
    else a gap; offsets are code points, end exclusive. A text's lines are found and summed up in one pass and
    without a shuffle, about PART bytes at a time on Arrow's own buffers; a null text is one empty line."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            texts = x.column(1).fill_null("")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(texts):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + PART, "right")))
                lines = pc.split_pattern(texts.slice(lo, hi - lo), "\n")
                n, flat = pc.list_value_length(lines).to_numpy(zero_copy_only=False), lines.flatten()
                first = np.cumsum(n) - n
                size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(size + 1) - size - 1
                keys = x.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(len(flat)) - np.repeat(first, n)), pa.array(total - np.repeat(total[first], n)), flat], ["k", "region", "start", "line"])
                lo = hi

    rows = docs.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, region long, start long, line string").withColumnRenamed("k", key)
    return rows.select(key, "region", "start", (F.col("start") + F.char_length("line")).alias("end"), F.when(F.col("line").rlike(marker), "body").otherwise("gap").alias("kind"), "line")


def pieces(n: Column, budget: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / budget)).cast("long")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", special: int = 2) -> DataFrame:
    """(key, n_tokens) under a vocabulary file of the tokenizers library, with special tokens on top; null counts as empty."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        for x in it:
            for lo in range(0, len(x), 256):
                y = x.iloc[lo : lo + 256]
                got = t.encode_batch_fast([v or "" for v in y["text"]], add_special_tokens=False)
                yield pd.DataFrame({"k": y["k"], "n_tokens": [len(e.ids) + special for e in got]})

    rows = docs.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, n_tokens long").withColumnRenamed("k", key)


def atomic_split(regions: DataFrame, budget: int, n: str = "n") -> DataFrame:
    """Each region in ceil(n/budget) pieces without overlap, one at least: adds piece and n_tokens."""
    rows = regions.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces(F.col(n), budget) - 1)))
    return rows.withColumn("n_tokens", F.least(F.lit(budget).cast("long"), F.col(n) - F.col("piece") * budget))


def coarse_pack(regions: DataFrame, budget: int, key: str = "doc_id", order: str = "region", n: str = "n", joint: int = 0) -> DataFrame:
    """(key, pack, n_tokens): consecutive regions of a parent packed greedily; an oversized region closes the open
    pack and is split by itself. A fold over the parent's region sizes, bounded by one document. joint: tokens of the
    separator between regions of a pack; 0 simulates by sums alone, over 0 counts what joined text comes to."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct(order, n))), lambda x: x[n].cast("long"))
    grouped = regions.groupBy(key).agg(sizes.alias("sizes"))
    b = F.lit(budget).cast("long")
    none = F.array().cast("array<bigint>")

    def step(s: Column, x: Column) -> Column:
        flushed = F.when(s["fill"] > 0, F.concat(s["out"], F.array(s["fill"]))).otherwise(s["out"])
        full = F.floor(x / b).cast("int")
        split = F.concat(flushed, F.array_repeat(b, full), F.when(x % b > 0, F.array(x % b)).otherwise(none))
        to = F.when(s["fill"] > 0, s["fill"] + joint + x).otherwise(x)
        out = F.when(x > b, split).when(to > b, flushed).otherwise(s["out"])
        fill = F.when(x > b, F.lit(0).cast("long")).when(to > b, x).otherwise(to)
        return F.struct(out.alias("out"), fill.alias("fill"))

    start = F.struct(none.alias("out"), F.lit(0).cast("long").alias("fill"))
    done = F.aggregate("sizes", start, step, lambda s: F.when(s["fill"] > 0, F.concat(s["out"], F.array(s["fill"]))).otherwise(s["out"]))
    return grouped.select(key, F.posexplode(done).alias("pack", "n_tokens")).withColumn("pack", F.col("pack").cast("long"))


def window_starts(n: Column, width: int | Column, stride: int | Column) -> Column:
    """Starts of windows of width over n tokens; the last is the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - width) / stride)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * stride)


def token_windows(rows: DataFrame, width: int | Column, stride: int | Column, n: str = "n") -> DataFrame:
    rows = rows.where(F.col(n) > 0).withColumn("start", F.explode(window_starts(F.col(n), width, stride)))
    return rows.withColumn("size", F.least(F.lit(width).cast("long"), F.col(n) - F.col("start")))


def packing_plan(regions: DataFrame, budgets: list[int], n: str = "n") -> DataFrame:
    """Vectors and token coverage of truncation at each budget."""
    x = regions.crossJoin(F.broadcast(regions.sparkSession.createDataFrame([(b,) for b in budgets], "budget long")))
    return x.groupBy("budget").agg(F.count("*").alias("vectors"), (F.sum(F.least(n, "budget")) / F.sum(n)).alias("coverage"))


def best_windows(d: Column, width: int, stride: int, top: int, score: Callable[[Column], Column]) -> Column:
    """The top windows of an array as structs (score, start), best first, then the earlier; score maps a window to a number. All
    windows are made and scored within the row, so a text is never copied for each of them."""
    at = lambda i: F.struct((-score(F.slice(d, (i + 1).cast("int"), width))).alias("low"), i.alias("start"))
    best = F.slice(F.array_sort(F.transform(window_starts(F.size(d), width, stride), at)), 1, top)
    return F.transform(best, lambda x: F.struct((-x["low"]).alias("score"), x["start"].alias("start")))


def best_passages(pairs: DataFrame, width: int, stride: int, top: int = 2) -> DataFrame:
    """pairs (qid, doc_id, q array, d array): windows of d scored by coverage of q's terms over the square root of
    their length; (qid, doc_id, nth, start, density) of the top windows by density, then earlier start."""
    q = F.array_distinct("q")
    density = lambda w: F.size(F.array_intersect(w, q)) / F.sqrt(F.size(w))
    rows = pairs.select("qid", "doc_id", F.posexplode(best_windows(F.col("d"), width, stride, top, density)).alias("nth", "x"))
    return rows.select("qid", "doc_id", "x.start", F.col("x.score").alias("density"), (F.col("nth") + 1).alias("nth"))


# What stands between a text's head and a passage from further on.
JOINT = "\n[ĐOẠN PHÙ HỢP]\n"


def top_passages(pairs: DataFrame, stopwords: tuple[str, ...] = (), width: int = 220, overlap: int = 70, header: int = 70, top: int = 2) -> DataFrame:
    """pairs (qid, doc_id, question, text): (qid, doc_id, nth, passage). A text of no more than width + 80 words is one passage. In
    others, windows of width words score coverage of the question's content terms (three letters at least, no stop
    word; 1 and 0.2 for each of up to three occurrences), 3 for each term with a digit and 1.8 for each word pair
    found, over the square root of the window's tokens; of equals the higher score, then the earlier window. A
    passage that starts behind the head of header words has it put before it. The first top different ones count."""
    flat = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    t = F.regexp_extract_all(F.lower(F.col("question")), F.lit(_TOKEN), 0)
    q = F.array_distinct(t)
    content = F.filter(q, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(F.array(*map(F.lit, stopwords or ("",))), w))
    two = F.array_distinct(F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    x = pairs.select("qid", "doc_id", flat(F.col("text")).alias("w"), content.alias("c"), F.filter(q, lambda w: w.rlike(r"\d")).alias("m"), two.alias("two"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, y: a + y)

    def scored(start: Column) -> Column:
        words = F.slice("w", (start + 1).cast("int"), width)

        def of(k: Column) -> Column:
            """k: the window's tokens, a lambda's variable, so that they are found once."""
            many = lambda y: F.size(F.filter(k, lambda v: v == y))
            cover = total(F.transform(F.filter("c", lambda y: F.array_contains(k, y)), lambda y: 1 + 0.2 * F.least(many(y), F.lit(3))))
            joined = F.array_join(k, " ")
            raw = cover + 3.0 * F.size(F.filter("m", lambda y: F.array_contains(k, y))) + 1.8 * F.size(F.filter("two", lambda y: F.contains(joined, y)))
            return F.struct(F.round(-raw / F.sqrt(F.greatest(F.size(k), F.lit(1))), 9).alias("density"), F.round(-raw, 9).alias("raw"), start.alias("start"))

        return F.transform(F.array(F.regexp_extract_all(F.lower(F.array_join(words, " ")), F.lit(_TOKEN), 0)), of)[0]

    part = lambda start: F.array_join(F.slice("w", (start + 1).cast("int"), width), " ")
    head = F.array_join(F.slice("w", 1, header), " ")
    put = lambda y: F.when(y["start"] < header, part(y["start"])).otherwise(F.concat(head, F.lit(JOINT), part(y["start"])))
    best = F.array_sort(F.transform(window_starts(F.size("w"), width, width - overlap), scored))
    found = F.when(F.size("w") <= width + 80, F.array(F.array_join("w", " "))).otherwise(F.slice(F.array_distinct(F.transform(best, put)), 1, top))
    return x.select("qid", "doc_id", F.posexplode(found).alias("nth", "passage")).select("qid", "doc_id", (F.col("nth") + 1).cast("long").alias("nth"), "passage")


_TOKEN = r"[\p{L}\p{N}_]+"


def distinct_windows(families: list[Column]) -> Column:
    """The windows of all families in order, each once."""
    return F.array_distinct(F.concat(*families))


def locate(points: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """points (key, x) with the region [start, end) of their parent that holds them: points with region, null where none does.
    Regions of a parent don't overlap, so points and starts are sorted together and a point takes the last start, instead of a
    join by range that meets every region of its parent."""
    both = points.select("*", F.col("x").alias("_at"), F.lit(1).alias("_o"), F.lit(None).cast("long").alias("_e"), F.lit(None).cast("long").alias("_g"))
    marks = regions.select(key, F.col("start").alias("_at"), F.lit(0).alias("_o"), F.col("end").alias("_e"), F.col("region").alias("_g"))
    w = W.partitionBy(key).orderBy("_at", "_o")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    x = both.unionByName(marks, allowMissingColumns=True).withColumns({"_le": last("_e"), "_lg": last("_g")}).where("_o = 1")
    return x.select(*points.columns, F.when(F.col("x") < F.col("_le"), F.col("_lg")).alias("region"))


# The least evidence budget, what a pair's format takes besides, and the lexical window.
LEAST_BUDGET, FORMAT, LEXICAL = 64, 2, (220, 150)


def pair_budget(n_query: Column, n_title: Column, most: int, special: int) -> Column:
    """Tokens that a pair leaves for evidence."""
    return F.greatest(F.lit(LEAST_BUDGET), most - n_query - special - n_title - FORMAT).cast("long")


def evidence_windows(pairs: DataFrame, mode: str, most: int = 512, special: int = 4) -> DataFrame:
    """(qid, doc_id, start, size) of the windows that a packaging mode makes of pairs (qid, doc_id, q, d, n_title):
    head, full, overlap50, three_quarters, or lexical (the densest window). Empty evidence gives no window."""
    if mode == "lexical":
        best = best_passages(pairs.where(F.size("d") > 0), *LEXICAL, top=1).join(pairs.select("qid", "doc_id", F.size("d").alias("n")), ["qid", "doc_id"])
        return best.select("qid", "doc_id", "start", F.least(F.lit(LEXICAL[0]).cast("long"), F.col("n") - F.col("start")).alias("size"))
    rows = pairs.select("qid", "doc_id", F.size("d").cast("long").alias("n"), pair_budget(F.size("q"), F.col("n_title"), most, special).alias("b"))
    wide = F.greatest(F.lit(LEAST_BUDGET), F.bround(0.75 * F.col("b"))).cast("long")
    width = wide if mode == "three_quarters" else F.col("b")
    stride = {"head": width, "full": width, "overlap50": F.floor(F.col("b") / 2), "three_quarters": F.floor(wide / 2)}[mode]
    rows = token_windows(rows.withColumn("w", width).withColumn("st", stride), F.col("w"), F.col("st"))
    return rows.where("start = 0" if mode == "head" else "true").select("qid", "doc_id", "start", "size")


def evidence_bundle(title: Column, a: Column, b: Column, labels: tuple[str, str, str] = ("TITLE", "EVIDENCE A", "EVIDENCE B")) -> Column:
    """Title and up to two different passages under their labels; a blank passage or a repeated one is left out."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    part = lambda name, c: F.concat(F.lit(f"[{name}]\n"), F.trim(c))
    more = [F.when(flat(a) != "", part(labels[1], a)), F.when((flat(b) != "") & (flat(a) != flat(b)), part(labels[2], b))]
    return F.concat_ws("\n\n", part(labels[0], F.coalesce(title, F.lit(""))), *more)


def balanced_bundle(a: Column, b: Column, fixed: Column, most: int = 512, least: int = 96) -> Column:
    """Both token arrays cut to half of what fixed tokens leave of most, each to 48 at least, and joined."""
    budget = F.greatest(F.lit(least), most - fixed)
    half = F.greatest(F.lit(least // 2), F.floor(budget / 2)).cast("int")
    rest = F.greatest(F.lit(least // 2), budget - half).cast("int")
    return F.concat_ws("\n", F.array_join(F.slice(a, F.lit(1), half), " "), F.array_join(F.slice(b, F.lit(1), rest), " "))
