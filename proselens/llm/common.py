"""Shared helpers: shared storage, byte-level tokenising and hashing in numpy over Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

np.seterr(over="ignore")  # hashes wrap

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
ARROW_BATCH = "4m"
BASE = 0xD6E8FEB86659FD93
BASE2 = 0xA0761D6478BD642F


# ---------------------------------------------------------------- storage

def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a temporary folder is made and set in local mode (tests); on a cluster, where nobody else would see such a folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="proselens-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    The explicit schema spares the file footers and makes empty results readable."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._proselens_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_proselens_path", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base and of its inverse modulo 2**64; grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], filled, step = 1, 1, b
            while filled < size:  # p[k + filled] = p[k] * b**filled
                p[filled : 2 * filled] = p[:filled] * np.uint64(step)
                step = step * step % (1 << 64)
                filled *= 2
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


def byte_table(base: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


_TABLES = {b: byte_table(b) for b in (BASE, BASE2)}


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """c with c[j] - c[i] = base**i times a hash of values[i:j], for all i <= j."""
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=c[1:])
    return c


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """prefix_sums() of bytes."""
    return prefix_sums(_TABLES[base][data], base)


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    h = (c[end] - c[start]) * powers(len(c), base)[1][start]
    return mix(h + (end - start).astype(np.uint64) * M1)


# ---------------------------------------------------------------- filters

BLOOM_BITS = 1 << 26  # fixed size of a filter of keys (8 MB); a full filter only costs time


def bloom(ids: DataFrame) -> bytes:
    """Bits of a filter of the column id: of fixed size, or'ed from blocks."""
    block = 1 << 19

    def bits(frames):
        acc = np.zeros(BLOOM_BITS // 8, np.uint8)
        for pdf in frames:
            at = bloom_at(pdf["id"].to_numpy(np.int64))
            np.bitwise_or.at(acc, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for k in range(0, len(acc), block):
            if acc[k : k + block].any():
                yield pd.DataFrame({"k": [k], "bits": [acc[k : k + block].tobytes()]})

    def either(key, pdf):
        return pd.DataFrame({"k": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()]})

    acc = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in ids.mapInPandas(bits, "k int, bits binary").groupBy("k").applyInPandas(either, "k int, bits binary").collect():
        acc[r["k"] : r["k"] + block] = np.frombuffer(r["bits"], np.uint8)
    return acc.tobytes()


def bloom_at(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.uint64))
    return np.concatenate([(h >> np.uint64(k)) & np.uint64(BLOOM_BITS - 1) for k in (0, 26)]).astype(np.int64)


def bloom_has(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Which ids pass the filter."""
    at = bloom_at(ids)
    return ((np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(2, -1).all(0)


# ---------------------------------------------------------------- Arrow

def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying the text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, limit: int = 1 << 19, column: str = "text"):
    """Record batches cut so that each holds about limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Give back to the system what this worker has freed; idle workers would keep it from others. Tables of powers, as long as the longest text, go too."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


# ---------------------------------------------------------------- words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts; and for each text, the number of its first word (with one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]  # a text's end also ends a word
    begins[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z in lower case."""
    return span_hash(prefix_hash(LOWER[data]), start, end)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries; the result is n - 1 shorter."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * M1
        out ^= out >> np.uint64(29)
    return mix(out)


def pick(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Only the columns named, cast; a column that is missing is null. Extra columns go.

    Every operator begins here, so this also bounds the Arrow batches that its tasks exchange with Python."""
    from pyspark.sql import functions as F

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def row_key(df: DataFrame):
    """128 bits that tell rows apart by all their columns, nulls by where they stand."""
    from pyspark.sql import functions as F

    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256), 1, 32))
