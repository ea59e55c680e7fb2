"""Expressions over legal texts: title keys, locator counts, instrument types, reference cues and headings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import WORD, compact

# Patterns of locators, instruments and cues; matched without regard to case.
LOCATORS = {
    "dieu": r"\bđiều\s+\d+[a-zA-Z]?\b",
    "khoan": r"\bkhoản\s+\d+[a-zA-Z]?\b",
    "diem": r"\bđiểm\s+[a-zA-Zđ]\b",
    "chuong": r"\bchương\s+[IVXLCDM\d]+\b",
    "muc": r"\bmục\s+\d+\b",
}
INSTRUMENTS = {
    "bo_luat": ("bộ luật", "bo luat"),
    "luat": ("luật", "luat"),
    "nghi_dinh": ("nghị định", "nghi dinh"),
    "thong_tu": ("thông tư", "thong tu"),
    "quyet_dinh": ("quyết định", "quyet dinh"),
    "nghi_quyet": ("nghị quyết", "nghi quyet"),
    "phap_lenh": ("pháp lệnh", "phap lenh"),
    "hien_phap": ("hiến pháp", "hien phap"),
}
CUES = {
    "has_instrument_number": r"\b\d{1,4}/\d{4}/[A-ZĐ]{1,8}(?:-[A-ZĐ]+)*\b",
    "has_year": r"\b(?:19|20)\d{2}\b",
    "has_version_cue": r"\b(?:hiện\s+hành|mới\s+nhất|sửa\s+đổi|bổ\s+sung|thay\s+thế|bãi\s+bỏ|có\s+hiệu\s+lực|hết\s+hiệu\s+lực|áp\s+dụng\s+từ|trước\s+ngày|sau\s+ngày)\b",
    "has_cross_reference": r"\b(?:theo|căn\s+cứ|quy\s+định\s+tại|dẫn\s+chiếu)\b",
    "has_number": r"(?<!\w)\d+(?:[.,]\d+)?",
    "has_entity": r"\b(?:công\s+ty|doanh\s+nghiệp|cơ\s+quan|ủy\s+ban|bộ\s+[A-ZÀ-Ỹ]|người\s+lao\s+động|người\s+sử\s+dụng\s+lao\s+động|cá\s+nhân|tổ\s+chức|hộ\s+kinh\s+doanh|chủ\s+đầu\s+tư|nhà\s+thầu)\b",
}
# Classes of a question by the first rule that matches, and the cue that a locator is asked about.
ARCHETYPES = [
    ("SANCTION", r"\b(?:phạt|xử\s+phạt|mức\s+phạt|phạt\s+tiền|truy\s+cứu|hình\s+phạt|vi\s+phạm)\b"),
    ("PROCEDURE", r"\b(?:thủ\s+tục|hồ\s+sơ|trình\s+tự|các\s+bước|nộp|đăng\s+ký|cấp|gia\s+hạn|giải\s+quyết)\b"),
    ("CONDITION", r"\b(?:điều\s+kiện|đủ\s+điều\s+kiện|được\s+phép|có\s+được|yêu\s+cầu|tiêu\s+chuẩn|đối\s+tượng)\b"),
    ("DEFINITION", r"\b(?:là\s+gì|được\s+hiểu\s+là|khái\s+niệm|định\s+nghĩa|thế\s+nào\s+là)\b"),
    ("NUMERICAL_THRESHOLD", r"\b(?:bao\s+nhiêu|mức|tối\s+đa|tối\s+thiểu|ít\s+nhất|không\s+quá|thời\s+hạn|bao\s+lâu|tỷ\s+lệ)\b"),
    ("ELIGIBILITY", r"\b(?:ai\s+được|ai\s+phải|trường\s+hợp\s+nào|đối\s+tượng\s+nào|được\s+hưởng|được\s+miễn|được\s+giảm)\b"),
]
DIRECT_CUE = r"\b(?:theo|tại|quy\s+định|nội\s+dung|quy\s+định\s+gì)\b"
DIRECT_WORDS = 35
# The locators and phrases of the scored population's classes and cues.
SCORED_LOCATORS = {"ARTICLE": r"\bđiều\s+\d+[a-zđ]?\b", "CLAUSE": r"\bkhoản\s+\d+\b", "POINT": r"\bđiểm\s+(?:[a-zđ]|\d+)\b"}
SCORED_PHRASES = {
    "SANCTION": ("xử phạt", "mức phạt", "phạt bao nhiêu", "tiền phạt", "bị phạt", "hình phạt", "chế tài", "phạt tiền", "truy cứu"),
    "DEFINITION": ("là gì", "được hiểu là", "thế nào là", "khái niệm", "định nghĩa", "có nghĩa là"),
    "PROCEDURE": ("thủ tục", "hồ sơ", "trình tự", "nộp hồ sơ", "đăng ký", "cấp giấy", "cấp phép", "xin phép", "giải quyết", "thẩm quyền", "cơ quan nào", "gia hạn", "cấp lại", "cấp đổi", "thu hồi", "đề nghị"),
    "CONDITION": ("điều kiện", "khi nào", "trường hợp nào", "trong trường hợp", "có được", "được phép", "không được", "phải đáp ứng", "cần đáp ứng", "đủ điều kiện"),
    "CROSSREF": ("theo quy định tại", "quy định tại điều", "quy định tại khoản", "căn cứ", "dẫn chiếu", "theo điều", "theo khoản", "theo điểm", "tại điều", "tại khoản"),
    "INSTRUMENT": ("luật ", "bộ luật", "nghị định", "thông tư", "quyết định", "nghị quyết", "pháp lệnh", "hiến pháp", "quy chuẩn", "tiêu chuẩn", "văn bản"),
    "NEGATION": ("không", "chưa"),
    "HYPOTHETICAL": ("nếu ", "trong trường hợp", "khi "),
}
# The phrases of the query features, in their order.
QUERY_CUES = {
    "sanction": ("xử phạt", "mức phạt", "phạt tiền", "hình phạt", "truy cứu"),
    "definition": ("là gì", "được hiểu là", "định nghĩa", "khái niệm"),
    "procedure": ("thủ tục", "hồ sơ", "trình tự", "đăng ký", "cấp phép", "cấp giấy", "thẩm quyền"),
    "condition": ("điều kiện", "khi nào", "trường hợp nào", "được phép", "đủ điều kiện"),
    "crossref": ("theo quy định tại", "căn cứ", "theo điều", "theo khoản", "tại điều", "tại khoản"),
    "howmany": ("bao nhiêu", "mức bao nhiêu", "thời hạn", "bao lâu"),
    "who": ("ai ", "người nào", "đối tượng nào", "cơ quan nào"),
    "what": ("là gì", "gồm những gì", "nội dung gì", "quy định gì"),
}
YEAR = r"\b(?:19|20)\d{2}\b"
# Words that say nothing in a passage search.
STOPWORDS = ("bị", "các", "có", "của", "cho", "được", "để", "đến", "đối", "gì", "hay", "khi", "không", "là", "làm", "một", "nào", "những", "như", "phải", "ra", "sẽ", "theo", "thì", "thế", "trong", "trên", "từ", "và", "về", "với", "việc", "bao", "nhiêu", "người", "quy", "định")
# Headings at the start of a line; an annex counts only in capitals.
HEADING = re.compile(
    r"^[ \t]*(?:(?P<annex>PHỤ[ \t]+LỤC|DANH[ \t]+MỤC|MẪU)[^\r\n]{0,140}"
    r"|Chương[ \t]+(?P<chapter>[IVXLCDM]+|\d+)\b[^\r\n]*"
    r"|Mục[ \t]+(?P<section>\d+[a-zđ]?)[^\r\n]*"
    r"|Điều(?:[ \t]+|(?P<broken>[ \t]*(?:\r?\n[ \t]*){1,3}))(?P<article>\d+[a-zđ]?)(?:[ \t]*[.:])?(?=[ \t\r\n]|$)[^\r\n]*)",
    re.MULTILINE | re.IGNORECASE,
)
_EDGE = r"[\p{L}\p{N}_]"


def _bounded(p: str) -> str:
    """A pattern without regard to case whose outer word edges count letters of every alphabet."""
    p = rf"(?<!{_EDGE})" + p[2:] if p.startswith(r"\b") else p.replace(r"(?<!\w)", rf"(?<!{_EDGE})")
    return "(?iu)" + (p[:-2] + rf"(?!{_EDGE})" if p.endswith(r"\b") else p)


@F.pandas_udf(T.StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_title(t: Column) -> Column:
    """Hyphens and underscores as spaces, compact; null counts as empty."""
    return compact(F.translate(F.coalesce(t, F.lit("")), "-_", "  "))


def title_key(t: Column) -> Column:
    """clean_title in lower case; put nfkc() before it where the text may hold compatibility forms."""
    return F.lower(clean_title(t))


def title_tokens(t: Column) -> Column:
    return F.regexp_extract_all(title_key(t), F.lit(WORD), 0)


def locator_counts(t: Column) -> dict[str, Column]:
    return {k: F.coalesce(F.regexp_count(t, F.lit(_bounded(p))), F.lit(0)).cast("long") for k, p in LOCATORS.items()}


def instrument_types(t: Column) -> Column:
    """The types named in a text, with or without accents, in the order of INSTRUMENTS. The key is a lambda's
    variable, so that it is made once and not in every branch."""

    def named(key: Column) -> Column:
        found = ((k, F.contains(key, F.lit(a)) | F.contains(key, F.lit(b))) for k, (a, b) in INSTRUMENTS.items())
        return F.array_compact(F.array(*(F.when(on, F.lit(k)) for k, on in found)))

    return F.transform(F.array(title_key(t)), named)[0]


def reference_flags(t: Column) -> dict[str, Column]:
    return {k: F.coalesce(t.rlike(_bounded(p)), F.lit(False)) for k, p in CUES.items()}


def _matches(t: Column, p: str) -> Column:
    return F.coalesce(t.rlike(_bounded(p)), F.lit(False))


def _holds(t: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(t, F.lit(p))
    return F.coalesce(out, F.lit(False))


def instrument_pattern(name: str) -> str:
    return r"\b" + INSTRUMENTS[name][0].replace(" ", r"\s+") + r"\b"


def archetype(t: Column) -> Column:
    """The class of a question: DIRECT_REF where it has a locator and a cue or few words, else the first rule that
    matches, else CROSS_REFERENCE where it refers and names an instrument, else GENERAL_SEMANTIC."""
    located = F.lit(False)
    for p in LOCATORS.values():
        located = located | _matches(t, p)
    few = F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")) <= DIRECT_WORDS
    out = F.when(located & (_matches(t, DIRECT_CUE) | few), F.lit("DIRECT_REF"))
    for name, p in ARCHETYPES:
        out = out.when(_matches(t, p), F.lit(name))
    named = F.lit(False)
    for k in INSTRUMENTS:
        named = named | _matches(t, instrument_pattern(k))
    return out.when(_matches(t, CUES["has_cross_reference"]) & named, F.lit("CROSS_REFERENCE")).otherwise(F.lit("GENERAL_SEMANTIC"))


def scored_cues(t: Column) -> dict[str, Column]:
    """The seven cue flags of the scored population; t is compact and in lower case."""
    out = {k: _matches(t, p) for k, p in SCORED_LOCATORS.items()}
    return out | {k: _holds(t, SCORED_PHRASES[k]) for k in ("INSTRUMENT", "CROSSREF", "NEGATION", "HYPOTHETICAL")}


def scored_archetype(t: Column) -> Column:
    """The class of a scored question, by its own order of rules; t is compact and in lower case."""
    cue = scored_cues(t)
    located = cue["ARTICLE"] | cue["CLAUSE"] | cue["POINT"]
    out = F
    for k in ("SANCTION", "DEFINITION", "PROCEDURE", "CONDITION"):
        out = out.when(_holds(t, SCORED_PHRASES[k]), F.lit(k))
    return out.when(cue["CROSSREF"] & located, F.lit("CROSS_REFERENCE")).when(located | cue["INSTRUMENT"], F.lit("DIRECT_REF")).otherwise(F.lit("GENERAL_SEMANTIC"))


def query_features(t: Column) -> dict[str, Column]:
    """Sixteen features of a question: its length in words and characters, locators, a year, negation, hypothesis and
    the cues; t is a title_key."""
    n = F.size(F.regexp_extract_all(t, F.lit(WORD), 0))
    flags = {k.lower(): _matches(t, p) for k, p in SCORED_LOCATORS.items()} | {"year": _matches(t, YEAR)}
    flags |= {k.lower(): _holds(t, SCORED_PHRASES[k]) for k in ("NEGATION", "HYPOTHETICAL")} | {k: _holds(t, p) for k, p in QUERY_CUES.items()}
    out = {"words": F.least(n, F.lit(60)) / 60.0, "chars": F.least(F.char_length(t), F.lit(300)) / 300.0}
    return out | {k: c.cast("int").cast("double") for k, c in flags.items()}


_MARKS = "n long, blank boolean, lead_blank boolean, marks array<struct<kind:string,start:long,label:string,heading:string,broken:boolean>>"


def _marks(text: str) -> list[dict]:
    out = []
    for m in HEADING.finditer(text):
        kind = next(k for k in ("annex", "chapter", "section", "article") if m[k])
        heading = " ".join(m[0].split())
        if kind != "annex" or heading == heading.upper():
            out.append({"kind": kind, "start": m.start(), "label": " ".join(m[kind].split()), "heading": heading, "broken": bool(m["broken"])})
    return out


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document its length, whether it and the text before its first article or annex are blank, and its marks:
    one per place, in order. Offsets are code points. The engine's patterns give no offsets, hence Python."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            rows = []
            for k, t in zip(x[key], x["text"], strict=True):
                marks = _marks(t or "")
                first = next((m["start"] for m in marks if m["kind"] in ("article", "annex")), len(t or ""))
                rows.append((k, len(t or ""), not (t or "").strip(), not (t or "")[:first].strip(), marks))
            yield pd.DataFrame(rows, columns=[key, "n", "blank", "lead_blank", "marks"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInPandas(run, f"{key} long, {_MARKS}")


def legal_regions(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, kind, label, heading, chapter, section, broken) from headings(): each article or annex runs to
    the next; text before the first, or all of a document without any, is a gap unless it is blank. A region carries
    the chapter and section it stands in; an annex ends both, a chapter ends the section. All windows are within one
    document, whose marks alone are moved."""
    rows = marked.select(key, "n", F.explode("marks").alias("m")).select(key, "n", "m.*")
    by = W.partitionBy(key).orderBy("start")
    rows = rows.withColumn("_a", F.sum((F.col("kind") == "annex").cast("int")).over(by))
    rows = rows.withColumn("_c", F.sum(F.col("kind").isin("annex", "chapter").cast("int")).over(by))
    state = lambda kind, part: F.coalesce(F.last(F.when(F.col("kind") == kind, F.col("heading")), True).over(W.partitionBy(key, part).orderBy("start")), F.lit(""))
    rows = rows.withColumn("chapter", state("chapter", "_a")).withColumn("section", state("section", "_c"))
    major = rows.where(F.col("kind").isin("article", "annex"))
    major = major.withColumn("end", F.coalesce(F.lead("start").over(by), F.col("n")))
    cols = [key, "start", "end", "kind", "label", "heading", "chapter", "section", "broken"]
    first = F.array_min(F.transform(F.filter("marks", lambda m: m["kind"].isin("article", "annex")), lambda m: m["start"]))
    gap = marked.where(~F.col("blank") & ~F.col("lead_blank")).withColumn("end", F.coalesce(first, F.col("n")))
    gap = gap.select(key, F.lit(0).cast("long").alias("start"), "end", F.lit("gap").alias("kind"), *(F.lit("").alias(c) for c in cols[4:8]), F.lit(False).alias("broken"))
    return major.select(cols).unionByName(gap)
