"""Token ids as length-delimited binary records with masked checksums and a separate offset index."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import documents
from rankloom.plans.session import cut, shared_dir

# The Castagnoli polynomial (reflected) and the mask of record checksums.
POLYNOMIAL, MASK_ADD = 0x82F63B78, 0xA282EAD8
END_ID, SHARD_CHARS = 2, 64 << 20
_BATCH_CHARS, _KEPT = 3 << 20, 1_000_000
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("at", "<u8"), ("bytes", "<u8"), ("n", "<u8")])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    cols = np.array([1 << i for i in range(32)], np.uint32)  # the effect of one zero byte on each bit of the state
    zero = [(t[cols & 255] ^ (cols >> 8)).astype(np.uint32)]
    for _ in range(48):  # of 2, 4, 8... zero bytes
        zero.append(_times(zero[-1], zero[-1]))
    return t, np.array(zero)


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 32x32 bit matrix, by columns, times each number of x."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & 1, matrix[i], 0).astype(np.uint32)
    return out


_BYTE, _ZERO = _tables()
_LANE = 64


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each blob. All blobs are cut into lanes of 64 bytes that are summed side by side; lanes are then
    folded in pairs, the left one shifted by the right one's length, so long blobs take log many steps."""
    n = np.array([len(b) for b in blobs], np.int64)
    lanes = np.maximum(1, -(-n // _LANE))
    buf = np.zeros((int(lanes.sum()), _LANE), np.uint8)
    first = np.cumsum(lanes) - lanes
    flat = buf.reshape(-1)
    for b, f, k in zip(blobs, first, lanes, strict=True):  # right-aligned: leading zeros leave a zero state as it is
        end = (f + k) * _LANE
        flat[end - len(b) : end] = np.frombuffer(b, np.uint8)
    crc = np.zeros(len(buf), np.uint32)
    for i in range(_LANE):
        crc = _BYTE[(crc ^ buf[:, i]) & 255] ^ (crc >> np.uint32(8))
    owner = np.repeat(np.arange(len(blobs)), lanes)
    level = 6  # 64 bytes
    while len(crc) > len(blobs):
        last = np.r_[owner[1:] != owner[:-1], True]
        end = np.repeat(np.flatnonzero(last), np.bincount(owner))
        back = end - np.arange(len(owner))  # pairs are counted from the right end
        left, right = np.flatnonzero(back % 2 == 1), np.flatnonzero(back % 2 == 0)
        crc[left + 1] ^= _times(_ZERO[level], crc[left])
        crc, owner, level = crc[right], owner[right], level + 1
    start = np.full(len(blobs), 0xFFFFFFFF, np.uint32)  # the register's start, moved past each blob
    for k in range(int(n.max(initial=0)).bit_length()):
        on = (n >> k) & 1 == 1
        start[on] = _times(_ZERO[k], start[on])
    return crc ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_ADD)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload behind its length (8 bytes) and that length's masked checksum, and before its own."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)), masked(crc32c(payloads))
    return [b"".join((h, x, p, y)) for h, x, p, y in zip(heads, (i.tobytes() for i in a), payloads, (i.tobytes() for i in b), strict=True)]


def payloads(blob: bytes, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The payloads of the frames at these offsets; raises on any frame whose length or checksum is wrong."""
    heads = [blob[a : a + 8] for a in at.tolist()]
    found = [struct.unpack("<Q", h)[0] for h in heads]
    out = [blob[a + 12 : a + 12 + n] for a, n in zip(at.tolist(), found, strict=True)]
    want = np.frombuffer(b"".join(blob[a + 8 : a + 12] + blob[a + 12 + n : a + 16 + n] for a, n in zip(at.tolist(), found, strict=True)), "<u4").reshape(-1, 2)
    if found != size.tolist() or (masked(crc32c(heads)) != want[:, 0]).any() or (masked(crc32c(out)) != want[:, 1]).any():
        raise ValueError("damaged record")
    return out


@lru_cache(maxsize=1)
def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    m = 0x9E3779B97F4A7C15
    up, down = np.full(n, m, np.uint64), np.full(n, pow(m, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


class Encoder:
    """Ids of whole texts, a batch at a time, each distinct piece tokenised once.

    The vocabulary's tokens never span white space, a letter and the full stop or comma after it never share one,
    and case is folded; so a text's ids are those of its pieces. Pieces are found and told apart by array
    operations: a rolling hash names each, and every occurrence is then compared with the first of its name byte
    by byte, so the result does not rest on the hash. Pieces of earlier batches are kept in arrays sorted by name, and
    compared alike; beyond _KEPT pieces they are let go.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()
        self.last = np.zeros(max(1 << 16, self.tokenizer.get_vocab_size()), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.end = np.array([END_ID], self.dtype).tobytes()
        code = np.arange(256)
        self.space = np.isin(code, [32, 9, 10, 11, 12, 13])
        self.stop = np.isin(code, [44, 46])
        self.letter = (code >= 97) & (code <= 122)
        self.lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each text by itself, as bytes."""
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def _distinct(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces and how many each has. Pieces of letters alone end in one word-end token each, so
        many go through in one call and are counted there; where the ends don't add up each goes by itself."""
        text = [w.decode("utf-8", "replace") for w in pieces]
        plain = np.array([t.isalpha() for t in text], bool)
        ids: list[bytes] = [b""] * len(text)
        where = np.flatnonzero(plain).tolist()
        batches = [where[i : i + 500] for i in range(0, len(where), 500)]
        alone = np.flatnonzero(~plain).tolist()
        got = self.tokenizer.encode_batch_fast([" ".join(text[i] for i in b) for b in batches], add_special_tokens=False)
        for b, e in zip(batches, got, strict=True):
            x = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(self.last[x]) + 1
            if len(ends) != len(b):
                alone += b
                continue
            raw, at = x.tobytes(), [0, *(ends * x.itemsize).tolist()]
            for i, lo, hi in zip(b, at, at[1:], strict=False):
                ids[i] = raw[lo:hi]
        for i, x in zip(alone, self._pieces([text[i] for i in alone]), strict=True):
            ids[i] = x
        return np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.names, self.blob, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, self.dtype)
        self.at, self.size, self.begin, self.many = none, none, none, none

    def _known(self, name: np.ndarray, buf: np.ndarray, flat: bytes, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, where each piece's begin, how many it has), adding the pieces not met before. name is sorted. None
        if two different pieces share a name."""
        if len(self.names) > _KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.names, name), max(0, len(self.names) - 1))
        old = self.names[at] == name if len(self.names) else np.zeros(len(name), bool)
        k = at[old]
        if (self.size[k] != n[old]).any() or (self.blob[_spread(self.at[k], n[old])] != buf[_spread(start[old], n[old])]).any():
            return None
        a, m = start[~old], n[~old]
        ids, many = self._distinct([flat[x:y] for x, y in zip(a.tolist(), (a + m).tolist(), strict=True)])
        names = np.r_[self.names, name[~old]]
        order = np.argsort(names, kind="stable")
        self.at = np.r_[self.at, len(self.blob) + np.cumsum(m) - m][order]
        self.size = np.r_[self.size, m][order]
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(many) - many][order]
        self.many = np.r_[self.many, many][order]
        self.blob, self.ids, self.names = np.r_[self.blob, buf[_spread(a, m)]], np.r_[self.ids, ids], names[order]
        k = np.searchsorted(self.names, name)
        return self.ids, self.begin[k], self.many[k]

    def __call__(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        flat = b" ".join([*raw, b""])
        buf = np.frombuffer(flat, np.uint8)
        if b"<|" not in flat:  # special tokens are told by case
            buf = self.lower[buf]
            flat = buf.tobytes()
        gap = np.r_[True, self.space[buf], True]
        s, e = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        cut = (e - s > 1) & self.stop[buf[e - 1]] & self.letter[buf[np.maximum(e - 2, 0)]]
        at = np.arange(len(s)) + np.cumsum(cut) - cut
        start, stop = np.empty(len(s) + int(cut.sum()), np.int64), np.empty(len(s) + int(cut.sum()), np.int64)
        start[at], stop[at] = s, e - cut
        start[at[cut] + 1], stop[at[cut] + 1] = e[cut] - 1, e[cut]
        up, down = _power(1 << len(buf).bit_length())
        total = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])]
        name = (total[stop] - total[start]) * down[start] if len(start) else np.zeros(0, np.uint64)
        _, first, of = np.unique(name, return_index=True, return_inverse=True)
        n = stop - start
        if (n != n[first][of]).any() or (buf[_spread(start, n)] != buf[_spread(start[first][of], n)]).any():
            return [x + self.end for x in self._pieces(texts)]
        got = self._known(name[first], buf, flat, start[first], n[first])
        if got is None:
            return [x + self.end for x in self._pieces(texts)]
        ids, begin, many = got
        out = ids[_spread(begin[of], many[of])]
        owner = np.searchsorted(np.cumsum(size), start, side="right")
        ends = (np.cumsum(np.bincount(owner, many[of], len(texts))) * self.dtype.itemsize).astype(np.int64).tolist()
        blob = out.tobytes()
        return [blob[a:b] + self.end for a, b in zip([0, *ends], ends, strict=False)]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 ... n[0] of them, then those of start[1] and so on."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker; loading the vocabulary takes a while."""
    return Encoder(path)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


@contextmanager
def _put(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A file written under a name of this attempt, then renamed, so a retried or doubled task leaves one whole file."""
    fs, at = _open(folder)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        yield f
    fs.move(own, f"{at}/{name}")


def write_records(docs: DataFrame, folder: str, path: str, shards: int) -> DataFrame:
    """Write shard files of docs' ids, ascending by doc_id (null first), and return (shard, ids) per shard.

    A range shuffle of the texts by (doc_id, text) puts the order in place, each task encodes its range in bounded slices and
    writes NNNNN.rec and NNNNN.idx. Only a slice's bytes and a shard's index are held at a time.
    """
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard = encoder(path), TaskContext.get().partitionId()
        index, off, ids = [], 0, 0
        with _put(folder, f"{shard:05d}.rec") as out:
            for x in it:
                part = x["text"].str.len().cumsum() // _BATCH_CHARS
                for _, y in x.groupby(part, sort=False):
                    data = encode([t or "" for t in y["text"]])
                    framed = frames(data)
                    for i, d, f in zip(y["doc_id"], data, framed, strict=True):
                        index.append((0 if pd.isna(i) else int(i), pd.isna(i), off, len(d), len(d) // encode.dtype.itemsize))
                        off += len(f)
                        ids += len(d) // encode.dtype.itemsize
                    out.write(b"".join(framed))
        with _put(folder, f"{shard:05d}.idx") as out:
            out.write(np.array(index, _INDEX).tobytes())
        yield pd.DataFrame({"shard": [shard], "ids": [ids]})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return rows.select("doc_id", "text").mapInPandas(run, "shard int, ids long")


def read_records(spark: SparkSession, folder: str, shards: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, checked against its checksums. shards: (shard, ids)."""
    w = W.orderBy("shard")  # one row per file
    base = shards.withColumn("base", F.sum("ids").over(w) - F.col("ids")).select("shard", "base")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = _open(folder)
        for x in it:
            for shard, first in zip(x["shard"], x["base"], strict=True):
                index = np.frombuffer(fs.open_input_stream(f"{at}/{shard:05d}.idx").read(), _INDEX)
                start = int(first)
                with fs.open_input_file(f"{at}/{shard:05d}.rec") as f:
                    for s in range(0, len(index), 1000):
                        y = index[s : s + 1000]
                        lo = int(y["at"][0])
                        f.seek(lo)
                        data = payloads(f.read(int(y["at"][-1] + y["bytes"][-1]) + 16 - lo), y["at"] - lo, y["bytes"])
                        n = y["n"].astype(np.int64)
                        crc = [zlib.crc32(np.frombuffer(d, f"<u{width}").astype("<u4")) for d in data]
                        ids = pd.Series(y["doc_id"], dtype="Int64").mask(y["null"].astype(bool))
                        yield pd.DataFrame({"doc_id": ids, "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})
                        start += int(n.sum())

    files = max(1, shards.count())  # a task for each, which adaptive execution doesn't merge
    return base.repartition(files, "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty and get the end id alone; rows that repeat a doc_id are ordered by their text's hash."""
    import public_tokenizers

    docs = documents(spark, sf_dir)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    shards = cut(write_records(docs, folder, public_tokenizers.path("word_bpe_49k.json"), max(8, -(-chars // SHARD_CHARS))))
    return read_records(spark, folder, shards)
