"""Text expressions: word class, keys, flags and rule classes. All but the NFC/NFKC keys stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word class for every engine: letters, numbers and the underscore.
WORD = r"[\p{L}\p{N}_]+"


def fold(t: Column) -> Column:
    """Case folding for Latin text: lower case with ß as ss."""
    return F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))


def tokens(t: Column, folded: bool = True) -> Column:
    return F.regexp_extract_all(fold(t) if folded else F.lower(t), F.lit(WORD), 0)


def compact(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def punctuation_key(t: Column) -> Column:
    """Folded, every punctuation mark and symbol a space, compact."""
    return compact(F.regexp_replace(fold(t), r"[\p{P}\p{S}]", " "))


def word_count(t: Column) -> Column:
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")


@F.pandas_udf(T.StringType())
def model_text(t: pd.Series) -> pd.Series:
    """NFC with white space compacted; case, accents and punctuation stay."""
    return t.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()))


@F.pandas_udf(T.StringType())
def strict_key(t: pd.Series) -> pd.Series:
    """model_text, case-folded: the general form of fold(compact(t))."""
    return t.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()).casefold())


def _plain(x: str) -> str:
    x = unicodedata.normalize("NFKC", x).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in x).split())


@F.pandas_udf(T.StringType())
def nfkc_key(t: pd.Series) -> pd.Series:
    """NFKC, case-folded, punctuation and symbols as spaces: the general form of punctuation_key."""
    return t.map(lambda x: None if x is None else _plain(x))


@F.pandas_udf(T.StringType())
def accent_key(t: pd.Series) -> pd.Series:
    """nfkc_key without any accent: đ as d, decomposed, combining marks dropped."""

    def key(x: str | None) -> str | None:
        if x is None:
            return None
        x = unicodedata.normalize("NFD", _plain(x).replace("đ", "d"))
        return " ".join("".join(c for c in x if unicodedata.category(c) != "Mn").split())

    return t.map(key)


@F.pandas_udf(T.BooleanType())
def not_nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else not unicodedata.is_normalized("NFC", x))


def flags(t: Column) -> dict[str, Column]:
    """Suspicious-character flags."""
    return {
        "replacement": t.contains("\ufffd"),
        "nul": t.contains("\0"),
        "control": t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"),
        "not_nfc": not_nfc(t),
        "edge_space": t.rlike(r"^\s|\s$"),
        "double_space": t.rlike(r"\s\s"),
        "html_like": t.rlike(r"<[^>]{1,120}>"),
    }


# Rule classes of a text, the first that matches counts.
ARCHETYPES = [("LICENSE", "licen[cs]e"), ("CONTACT", "@|\\+1 "), ("NUMERIC", "[0-9]{4,}"), ("TABLE", "\\|"), ("SHOUT", "!!"), ("LIST", "\\.\\n")]


def archetype(t: Column) -> Column:
    out = F
    for name, pattern in ARCHETYPES:
        out = out.when(F.lower(t).rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("GENERAL"))


def stable_hash(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
