"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram's vector binds (multiplies) its letters' vectors, each permuted (rolled) by
the letter's place; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles its training texts.
A text gets the language whose prototype, less the mean of all prototypes' directions, has the highest cosine with it.

Bundling is linear, so a batch of texts is one product of n-gram counts and n-gram vectors. Training sums one
vector for each language and task: what is gathered is (languages x DIM) numbers, whatever the number of documents.
Letters are folded into ALPHABET classes (rare letters share classes), so the vectors of pairs can be kept between batches, and an n-gram's needs one more product.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pick, slices

DIM = 512
N = 3
LETTERS = 64          # classes of letters; 0 is the gap between words
MAX_LANGS = 4096      # more names of languages than that are an error: the prototypes travel to every task
UNKNOWN = "und"


def _letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter; a-z 1..26, further letters by a hash of the lower-case letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0x4E00 <= cp <= 0x9FFF or 0x3400 <= cp <= 0x4DBF or 0x20000 <= cp <= 0x3FFFF:
            low = cp
        else:
            ch = chr(cp)
            if unicodedata.category(ch)[0] != "L":
                continue
            low = ord(ch.lower()[0])
        out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % (1 << 32)) * (LETTERS - 27) >> 32
    return out


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_letter_classes())
    return _CLASSES[0]


_BOUND: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _bound(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all pairs of letters at an n-gram's first two places, bound, and of the letters at its last: 2 MB, where those of all n-grams would be 134."""
    if dim not in _BOUND:
        bits = mix(np.arange(LETTERS * dim, dtype=np.uint64) + np.uint64(12345)) & np.uint64(1)
        letter = (bits.astype(np.int8) * 2 - 1).reshape(LETTERS, dim)
        out = np.ones((1, dim), np.int8)
        for place in range(N - 1):
            rolled = np.roll(letter, N - 1 - place, axis=1)
            out = (out[:, None, :] * rolled[None, :, :]).reshape(-1, dim)
        _BOUND[dim] = out, letter
    return _BOUND[dim]


def vectors_of(gram: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The n-grams' vectors, (len(gram), dim) of +1 and -1 in int8."""
    front, last = _bound(dim)
    return front[gram // LETTERS] * last[gram % LETTERS]


def vectors(dim: int = DIM) -> np.ndarray:
    """All n-grams' vectors, (LETTERS**N, dim)."""
    return vectors_of(np.arange(LETTERS**N), dim)


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram) of each n-gram of the batch's texts, and for each row whether it has letters.

    Runs of what is no letter count as one gap; a text has a gap at both ends."""
    texts = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
    joined = "\n\n".join(texts.to_pylist()) + "\n\n"
    lengths = np.asarray(pa.compute.utf8_length(texts), np.int64) + 2
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = classes()[code]
    row = np.repeat(np.arange(len(lengths)), lengths)
    letters = np.bincount(row[c > 0], minlength=len(lengths)) > 0
    keep = (c > 0) | np.r_[True, c[:-1] > 0]
    c, row = c[keep].astype(np.int32), row[keep]
    # one gap before each text's first word
    head = np.r_[True, row[1:] != row[:-1]]
    at = np.flatnonzero(head & (c > 0))
    c, row = np.insert(c, at, 0), np.insert(row, at, row[at])
    if len(c) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), letters
    g = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
    ok = (row[:-2] == row[2:]) & (c[1:-1] > 0)
    return row[:-2][ok], g[ok], letters


def bundles(row: np.ndarray, gram: np.ndarray, rows: int, dim: int = DIM) -> np.ndarray:
    """The texts' vectors (rows, dim): counts of n-grams times their vectors, over blocks of rows."""
    out = np.zeros((rows, dim), np.float32)
    step = 64
    edges = np.searchsorted(row, np.arange(0, rows + step, step))
    for b in range(len(edges) - 1):
        lo, hi = edges[b], edges[b + 1]
        if lo == hi:
            continue
        uniq, inv = np.unique(gram[lo:hi], return_inverse=True)
        n = min(step, rows - b * step)
        counts = np.bincount((row[lo:hi] - b * step) * len(uniq) + inv, minlength=n * len(uniq)).reshape(n, -1).astype(np.float32)
        for a in range(0, len(uniq), 4096):
            out[b * step : b * step + n] += counts[:, a : a + 4096] @ vectors_of(uniq[a : a + 4096], dim).astype(np.float32)
    return out


def train(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Names of the languages and their prototypes, from all rows of docs (text, lang) whose lang isn't null.

    Sums are of whole numbers, so the order of tasks doesn't matter."""
    schema = "lang string, part binary"

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            row, gram, _ = grams(batch)
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs]) if len(names) < 50 else np.array(list(map({x: i for i, x in enumerate(names)}.get, langs)))
            key = of[row].astype(np.int64) * LETTERS**N + gram
            uniq, n = np.unique(key, return_counts=True)
            for i, name in enumerate(names):
                at = (uniq // LETTERS**N) == i
                u, w = uniq[at] % LETTERS**N, n[at]
                acc = total.setdefault(name, np.zeros(dim, np.int64))
                for a in range(0, len(u), 4096):
                    acc += np.rint(w[a : a + 4096].astype(np.float64) @ vectors_of(u[a : a + 4096], dim)).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_pylist([{"lang": k, "part": v.tobytes()} for k, v in total.items()], pa.schema([("lang", pa.string()), ("part", pa.binary())]))

    def add(key, pdf):
        return pd.DataFrame({"lang": [key[0]], "part": [np.sum([np.frombuffer(x, np.int64) for x in pdf["part"]], 0).tobytes()]})

    parts = docs.where("lang is not null").select("text", "lang").mapInArrow(run, schema)
    found = parts.groupBy("lang").applyInPandas(add, schema).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    found.sort(key=lambda r: r["lang"])
    p = np.array([np.frombuffer(r["part"], np.int64) for r in found], np.float64).reshape(len(found), dim)
    return [r["lang"] for r in found], p


def directions(p: np.ndarray) -> np.ndarray:
    unit = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return unit


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, columns: list[str]) -> DataFrame:
    """columns of docs, lang_pred, score. Of equal cosines the first language by name wins."""
    dim = prototypes.shape[1]
    unit = directions(prototypes)
    mean = unit.mean(0) if len(unit) > 1 else np.zeros(dim)
    sharp = directions(unit - mean)
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((names, unit, mean, sharp))  # at most MAX_LANGS * DIM numbers
    src = docs.select(*columns, *([] if "text" in columns else ["text"]))
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(src.select(*columns).schema.fields).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches):
        names, unit, mean, sharp = sent.value
        for batch in slices(batches):
            row, gram, letters = grams(batch)
            n = batch.num_rows
            if not names:
                pred, score = [UNKNOWN] * n, np.zeros(n)
            else:
                x = bundles(row, gram, n, dim).astype(np.float64)
                length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                x /= length
                best = ((x - (x @ mean)[:, None] * mean / max(mean @ mean, 1e-12)) @ sharp.T).argmax(1) if len(names) > 1 else np.zeros(n, int)
                score = np.clip((x * unit[best]).sum(1), 0, 1)
                score[~letters] = 0
                pred = [names[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*columns, "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: learned from the rows that aren't held out.

    Null text or text without letters gives `und` and 0; so does every text where nothing can be learned. A null doc_id counts
    as the empty string for the fold. Extra columns are ignored."""
    d = pick(docs, {"doc_id": "long", "text": "string", "lang": "string"}).withColumn("held_out", held_out())
    names, p = train(d.where(~F.col("held_out")))
    return identify(d, names, p, ["doc_id", "held_out"])


def query(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
