"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents, packed
from rankloom.plans.session import cut

# The kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words on either side that tell contexts apart, least distinct contexts, and the share of an entity's information that a term
#: may give away before it is generalised or removed.
REACH, SUPPORT, ALPHA, REMOVE = 8, 3, 1.2, 1.05
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Terms are looked for in parts of the distinct texts, by hash, all of them in the end: a term that the parts up to one
#: of these bounds show to be common is not looked for in the next.
_PARTS = (0, 2, 12, 64)


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each @ outwards, so that a long run without @ costs nothing."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and t[lo - 1] in EMAIL_LOCAL:
            lo -= 1
        m = EMAIL_DOMAIN.match(t, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append((lo, end))
        at = t.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns in a whole text, sorted; code points, end exclusive."""
    t = text or ""
    out = [(a, 0, b) for a, b in emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def outside(t: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words of t that touch none of the sorted spans; one sweep over both."""
    k, end = 0, 0
    for m in _TERM.finditer(t):
        while k < len(spans) and spans[k][0] < m.end():
            end, k = max(end, spans[k][2]), k + 1
        if m.start() >= end:
            yield m


def entities(t: str, spans: list[tuple[int, int, int]], near: list[re.Match]) -> list[tuple[str, int]]:
    """(entity, context hash) of each span, by the REACH words before and after it; near: the words in no span."""
    out, low = set(), [m[0].lower() for m in near]
    starts, ends = [m.start() for m in near], [m.end() for m in near]
    for a, k, b in spans:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        own = zlib.crc32(" ".join(low[max(0, i - REACH) : i] + low[j : j + REACH]).encode("utf-8", "surrogatepass"))
        out.add((hashlib.blake2b(f"{k}:{t[a:b].lower()}".encode(), digest_size=8).hexdigest(), own))
    return sorted(out)


_ROW = "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, ents array<struct<ent:string,own:long>>, words array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: base counts and spans, its entities, and where it has any its distinct words."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            rows = []
            for t in x["text"]:
                t = t or ""
                spans = base_spans(t)
                n = Counter(k for _, k, _ in spans)
                text = joined(spans)
                near = list(outside(t, spans)) if spans else []
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(text.encode()).hexdigest(), text, [{"ent": e, "own": o} for e, o in entities(t, spans, near)], sorted({m[0].lower() for m in near})))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "ents", "words"])
            yield out.assign(doc_id=x["doc_id"].astype("Int64"), th=x["th"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("th")).mapInPandas(run, _ROW)


def _marked(terms: DataFrame) -> bytes:
    """A byte for each hash bucket, on where it holds one of the terms. Buckets are 256 a term or more (up to 16 million),
    so the share of other words that fall in one does not grow with the terms; they come to the driver as bitmaps."""
    size = 1 << min(24, max(18, (256 * terms.count()).bit_length()))
    b = F.crc32(F.col("term").cast("binary")) % size
    rows = terms.select(b.alias("b")).groupBy((F.col("b") / 32_768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("b") % 32_768).alias("m"))
    on = np.zeros(size, np.uint8)
    for r in rows.collect():  # size / 32,768 rows
        on[r.k * 32_768 : (r.k + 1) * 32_768] = np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little")
    return on.tobytes()


def places(docs: DataFrame, terms: DataFrame, lo: int, hi: int) -> DataFrame:
    """(th, term, at) of the terms in every distinct text of the parts lo to hi - 1 of _PARTS[-1]; at: the places in no base
    span, over the whole text."""
    known = docs.sparkSession.sparkContext.broadcast(_marked(terms))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = known.value
        for x in it:
            rows = []
            for t, th in zip(x["text"], x["th"], strict=True):
                t = t or ""
                at: dict[str, list] = {w: [] for w in {w.lower() for w in set(_TERM.findall(t))} if on[zlib.crc32(w.encode("utf-8", "surrogatepass")) % len(on)]}
                for m in outside(t, base_spans(t)) if at else ():
                    if m[0].lower() in at:
                        at[m[0].lower()].append({"s": m.start(), "e": m.end()})
                rows += [(th, w, v) for w, v in at.items()]
            yield pd.DataFrame(rows, columns=["th", "term", "at"])

    text = F.col("text").cast("string")
    part = F.pmod("th", F.lit(_PARTS[-1]))
    got = docs.select(text, F.xxhash64(text).alias("th")).where((part >= lo) & (part < hi))
    got = got.mapInPandas(run, "th long, term string, at array<struct<s:int,e:int>>")
    return got.join(terms.select("term").distinct(), "term", "left_semi").dropDuplicates(["th", "term"])


def revealing(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame | None:
    """(th, term, at, removed) of the terms that give away an entity, in every distinct text; None if there are none.

    With N distinct texts in the corpus, w(e) that hold entity e, c(t) that hold term t and c(e,t) that hold both,
    anywhere in them: the term discloses PMI = log2(c(e,t) N / (w(e) c(t))) of the entity's information
    IC = log2(N / w(e)). It is generalised from PMI >= IC/alpha on and removed from IC/1.05 on, if the entity has at
    least support distinct contexts in the texts that hold both. All counts are of distinct texts, so copies change
    no verdict.
    """
    texts = rows.where(F.size("ents") > 0).select("th", "ents", "words").dropDuplicates(["th"])
    met = texts.select("th", F.explode("ents").alias("x"), "words").select("th", "x.ent", "x.own", "words")
    wide = met.groupBy("ent").agg(F.count_distinct("th").alias("w"), F.count_distinct("own").alias("n_own")).where(F.col("n_own") >= support)
    wide = cut(wide.select("ent", "w"))
    if wide.isEmpty():
        return None
    pairs = met.join(wide.select("ent"), "ent", "left_semi").select("ent", "th", "own", F.explode("words").alias("term"))
    near = pairs.groupBy("ent", "term").agg(F.count_distinct("own").alias("n_own"), F.count_distinct("th").alias("both"))
    total = rows.select("th").distinct().count()
    ic, n = F.log2(F.lit(float(total)) / F.col("w")), F.lit(float(total))
    pmi = lambda c: F.log2(F.col("both") * n / (F.col("w") * F.col(c)))
    near = near.where(F.col("n_own") >= support).drop("n_own").join(wide, "ent").where(ic > 0)
    # c: distinct texts known to hold the term, first of those with entities; at the end of all.
    held = texts.select("th", F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("c"))
    near = cut(near.join(held, "term").where(pmi("c") >= ic / alpha))
    at = None
    for lo, hi in pairwise(_PARTS):
        if near.isEmpty():
            return None
        more = cut(places(docs, near, lo, hi))
        at = more if at is None else at.unionByName(more)
        c = at.groupBy("term").agg(F.count("*").alias("found"))
        near = near.join(c, "term", "left").withColumn("c", F.greatest("c", "found")).drop("found")
        near = cut(near.where(pmi("c") >= ic / alpha))
    x = near.groupBy("term").agg(F.max(pmi("c") >= ic / REMOVE).alias("removed"))
    return at.join(x, "term")


def find(docs: DataFrame, **params) -> DataFrame:
    """doc_id, th (hash of the text), base counts, base_sha256, spans (all, joined by start and kind) and terms (the
    revealing ones, an array of structs, wherever they stand) of every row of docs. Null texts count as empty, an empty
    table gives an empty result, repeated rows all stay and get the same spans. Spans of one start are in the order
    of kinds; terms at a threshold count as above it. Texts of any length are read whole, in time that grows with
    their length and spans. Other columns of docs are not read."""
    rows = cut(scan(docs))
    risky = revealing(docs, rows, **params)
    none = F.array().cast("array<struct<s:int,e:int,removed:boolean>>")
    rows = rows.drop("ents", "words")
    if risky is None:
        return rows.withColumn("terms", none)
    hits = risky.select("th", F.explode("at").alias("x"), "removed").groupBy("th").agg(F.collect_set(F.struct("x.s", "x.e", "removed")).alias("terms"))
    out = rows.join(hits.withColumnRenamed("th", "_th"), F.col("th") == F.col("_th"), "left").drop("_th")
    part = lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).cast("int").alias("k"), F.split(s, ":")[2].cast("int").alias("b"))
    base = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), part)
    more = F.array_distinct(F.transform("terms", lambda x: F.struct(x["s"].alias("a"), F.lit(len(KINDS)).alias("k"), x["e"].alias("b"))))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), x["a"].cast("string"), x["b"].cast("string"))
    every = F.array_join(F.transform(F.array_sort(F.concat(base, more)), name), ",")
    return out.withColumn("spans", F.when(F.col("terms").isNull(), F.col("spans")).otherwise(every)).withColumn("terms", F.coalesce("terms", none))


def clean(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """text with base spans as [KIND], generalised terms as [TERM] and removed terms gone. Where spans overlap, the
    one that starts first, the longer of two, gives the mark, and the whole covered stretch goes."""
    spans = [(a, -b, f"[{KINDS[k].upper()}]") for a, k, b in base_spans(text)] + [(s, -e, "" if r else "[TERM]") for s, e, r in terms]
    out, end = [], 0
    for a, b, mark in sorted(spans):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, -b)
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """docs with personal data replaced in text and n_chars counted anew where there is such a column; all rows and
    columns stay, texts without findings are unchanged, null stays null."""
    found = find(docs, **params).where(F.size("terms") > 0).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "terms").dropDuplicates(["_id", "_th"])
    text = F.col("text").cast("string")
    rows = packed(docs, id=F.col("doc_id").cast("long"), h=F.xxhash64(text), t=text)
    if found.isEmpty():
        rows = rows.withColumn("terms", F.array().cast("array<struct<s:int,e:int,removed:boolean>>"))
    else:
        rows = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_th")), "left")

    @F.pandas_udf("string")
    def put(t: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else clean(x, [(r["s"], r["e"], r["removed"]) for r in (y if y is not None else ())]) for x, y in zip(t, terms, strict=True)], dtype=object)

    rows = rows.select("row", put("t", "terms").alias("t"))
    row = F.col("row").withField("text", F.col("t"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.char_length("t").cast("long"), F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir))
    n = F.size(F.filter(F.split("spans", ","), lambda x: x != "")).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", n.alias("n_spans"))
