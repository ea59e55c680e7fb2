"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.session import spread

# Fixed value: the word pattern of all operators here.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores where their files give fewer tasks."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def word_count(text: Column) -> Column:
    """Number of words as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs' rows as a struct named row beside the columns in keys, so that no column of docs can clash with them;
    select("row.*") unpacks."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in keys.items()))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() breaks at exactly the white space of WORD."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group of equal keys is cut; holds one group and about rows rows at a time."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        x = pd.concat(held, ignore_index=True)
        k = x[keys]
        same = (k == k.iloc[-1]).all(axis=1).to_numpy()
        at = len(x) - (int(np.argmin(same[::-1])) if not same.all() else len(x))
        if at:
            yield x.iloc[:at].reset_index(drop=True)
        held, n = [x.iloc[at:]], len(x) - at
    if held:
        yield pd.concat(held, ignore_index=True)


def group_ids(x: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Running number of each run of equal keys."""
    new = np.zeros(len(x), bool)
    for k in keys:
        v = x[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def spanning(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes over the undirected links p-q."""
    label = np.arange(n)
    while len(p):
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    return label
