"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every training passage.

Impacts are BM25 contributions divided by the item's score for itself, so that one threshold suits all items: 1 means that the
passage holds every word of the item. A passage is a window of words; windows overlap by half, so that
every item piece lies wholly in one. Before the search proper, a bound that is a sum over the rarer words of each item
(those that make up ESSENTIAL of its score) discards passages that can't reach the threshold: the other words together add at most the
rest. What is left is searched with block-max WAND, which returns all items above the threshold. These are verified: the word n-grams of
the item's question part and those of its answer part must both be found in the passage.

The index is broadcast in shards of at most SHARD_ITEMS pieces of at most HALF words each, one pass over the documents for each shard. Document
frequencies and mean length are those of the whole benchmark, so that scores do not depend on the shards.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, written

HALF = 64            # words between the starts of windows; a window has twice as many
THRESHOLD = 0.5      # of the item's own score
ESSENTIAL = 0.8
QUESTION = 0.5       # of the question's n-grams
ANSWER = 0.5
GRAM = 3
BLOCK = 16           # items in a block of a posting list
K1, B = 1.2, 0.75
SHARD_ITEMS = 20_000
WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pieces_of(text: str | None) -> list[list[str]]:
    """The words of an item in pieces of HALF at most."""
    w = tokens(text or "")
    n = max(1, math.ceil(len(w) / HALF))
    return [piece for k in range(n) if (piece := w[len(w) * k // n : len(w) * (k + 1) // n])]


class Index:
    """Posting lists with block maxima over pieces (item_id, words, question words). whole: document frequencies of these items' words, number and mean
    length of pieces in the whole benchmark, if these items are a shard of it."""

    def __init__(self, items: list[tuple[int, str]], whole: tuple[dict[str, int], int, float] | None = None):
        pieces = [(item, piece) for item, text in items for piece in pieces_of(text)]
        pieces.sort(key=lambda p: (len(p[1]), p[0]))  # pieces of like length share blocks, so block maxima are tight
        self.items = [i for i, _ in pieces]
        self.words = [p for _, p in pieces]
        self.question = [max(1, len(p) * 2 // 3) for p in self.words]
        df, total, mean = whole or (Counter(t for p in self.words for t in set(p)), len(pieces), sum(map(len, self.words)) / max(1, len(self.words)))
        idf = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.vocab = {t: k for k, t in enumerate(df)}
        self.docs: list[list[int]] = [[] for _ in self.vocab]
        self.impact: list[list[float]] = [[] for _ in self.vocab]
        essential: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        self.need = np.zeros(len(pieces))
        for d, p in enumerate(self.words):
            part = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(p) / mean)) for t, n in Counter(p).items()}
            own, mass = sum(part.values()), 0.0
            for t in sorted(part, key=lambda t: (df[t], t)):
                c = part[t] / own
                k = self.vocab[t]
                self.docs[k].append(d)
                self.impact[k].append(c)
                if mass < ESSENTIAL:
                    essential[k].append((d, c))
                    mass += c
            self.need[d] = THRESHOLD - (1 - mass) - 1e-9
        self.top = [max(x) for x in self.impact]
        self.blocks = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impact]
        # essential postings in arrays, for the bound over many passages at once
        self.at = np.cumsum([0, *map(len, essential)])
        flat = [y for x in essential for y in x]
        self.ess_doc, self.ess_c = np.array([d for d, _ in flat], np.int64), np.array([c for _, c in flat])

    def reach(self, window: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Windows that some piece's essential words let reach the threshold; (window, term) pairs are distinct."""
        n = self.at[term + 1] - self.at[term]
        some = n > 0
        window, term, n = window[some], term[some], n[some]
        if not len(n):
            return window
        post = np.repeat(self.at[term] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = np.repeat(window, n) * len(self.items) + self.ess_doc[post]
        order = np.argsort(key, kind="stable")
        key, c = key[order], self.ess_c[post][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return np.unique(key[first][np.add.reduceat(c, first) >= self.need[key[first] % len(self.items)]] // len(self.items))

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All pieces that score at least the threshold for a passage with these distinct terms: block-max WAND."""
        docs, blocks, impact, top = self.docs, self.blocks, self.impact, self.top
        cur = [[docs[t][0], t, 0] for t in terms]
        found = []
        end = len(self.items)

        def seek(c, d):
            post = docs[c[1]]
            c[2] = bisect.bisect_left(post, d, c[2])
            c[0] = post[c[2]] if c[2] < len(post) else end

        while True:
            cur = sorted(c for c in cur if c[0] < end)
            bound, pivot = 0.0, None
            for k, c in enumerate(cur):
                bound += top[c[1]]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            d = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == d:
                pivot += 1
            # the block of each list in which d would lie
            places = []
            for c in cur[: pivot + 1]:
                at = c[2] if c[0] >= d else bisect.bisect_left(docs[c[1]], d, c[2])
                places.append(at // BLOCK if at < len(docs[c[1]]) else -1)
            limit = sum(blocks[c[1]][b] for c, b in zip(cur, places) if b >= 0)
            if limit < threshold - 1e-9:
                # nothing before the nearest end of these blocks, or the next list's document, can reach the threshold
                ends = [docs[c[1]][min((b + 1) * BLOCK, len(docs[c[1]])) - 1] + 1 for c, b in zip(cur, places) if b >= 0]
                nxt = min([*ends, cur[pivot + 1][0] if pivot + 1 < len(cur) else end])
                for c in cur[: pivot + 1]:
                    seek(c, max(nxt, d + 1))
            elif cur[0][0] == d:
                score = sum(impact[c[1]][c[2]] for c in cur[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((d, score))
                for c in cur[: pivot + 1]:
                    seek(c, d + 1)
            else:
                for c in cur[: pivot + 1]:
                    if c[0] < d:
                        seek(c, d)

    def verify(self, d: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the n-grams of the piece's question and answer parts that are in the passage."""
        w, q = self.words[d], self.question[d]
        out = []
        for part in (w[:q], w[q:] or w[-1:]):
            n = min(GRAM, len(part))
            have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
            grams = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
            out.append(sum(g in have for g in grams) / len(grams))
        return out[0], out[1]


def matches(batch: pa.RecordBatch, index: Index):
    """(row, item_id, score, question share, answer share, first word of the passage) of all verified matches of the batch."""
    words = [tokens(t or "") for t in batch.column("text").to_pylist()]
    get = index.vocab.get
    ids = np.fromiter((get(t, -1) for w in words for t in w), np.int64)
    n = np.array([len(w) for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), n)
    within = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    base = np.r_[0, np.cumsum(n // HALF + 1)]  # numbers of a row's windows
    known = ids >= 0
    at, term = (base[row] + within // HALF)[known], ids[known]
    second = (within // HALF > 0)[known]
    v = len(index.vocab)
    key = np.unique(np.r_[at * v + term, (at[second] - 1) * v + term[second]])
    for w in index.reach(key // v, key % v):
        lo, hi = np.searchsorted(key, [w * v, (w + 1) * v])
        r = int(np.searchsorted(base, w, "right")) - 1
        first = int(w - base[r]) * HALF
        passage = words[r][first : first + 2 * HALF]
        for d, score in index.search((key[lo:hi] % v).tolist()):
            q, a = index.verify(d, passage)
            if q >= QUESTION and a >= ANSWER:
                yield r, index.items[d], score, q, a, first


def statistics(b: DataFrame) -> tuple[DataFrame, int, float]:
    """Of the whole benchmark b (text, shard): (shard, term, df) for the words of each shard, number of pieces, mean length."""
    def run(batches):
        for batch in batches:
            found, n, length = Counter(), Counter(), Counter()
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
                for piece in pieces_of(text):
                    found.update((shard, t) for t in set(piece))
                    n[shard] += 1
                    length[shard] += len(piece)
            rows = [(s, t, c, 0) for (s, t), c in found.items()] + [(s, None, n[s], length[s]) for s in n]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["shard", "term", "n", "length"])

    c = b.select(F.col("shard").cast("long").alias("shard"), "text").mapInArrow(run, "shard long, term string, n long, length long")
    c = written(c.groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")), "terms")
    total, length = c.where("term is null").agg(F.sum("n"), F.sum("length")).first()
    df = c.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    return written(c.where("term is not null").select("shard", "term").join(df, "term"), "frequencies"), total or 0, (length or 0) / max(1, total or 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, score (of the best passage), question_overlap, answer_overlap, passage (its first word).

    Null or empty texts and items match nothing; rows that repeat a doc_id give one row together. With keep, instead the columns named of the
    documents (each row with doc_id and text) in which nothing is found. Extra columns are ignored."""
    spark = docs.sparkSession
    b = pick(benchmark, {"item_id": "long", "text": "string"}).where("text is not null")
    shards = max(1, math.ceil((b.agg(F.sum(F.floor(F.length("text") / HALF) + 1)).first()[0] or 0) / SHARD_ITEMS))
    b = b.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage long"
    names = [c.split()[0] for c in schema.split(", ")]
    d = pick(docs, {"doc_id": "long", "text": "string"}) if keep is None else docs
    parts = []
    of, total, mean = statistics(b) if shards > 1 else (None, 0, 0.0)  # one shard has them all
    for k in range(shards):
        items = sorted(((r["item_id"], r["text"]) for r in b.where(F.col("shard") == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # a shard: bounded
        whole = ({r["term"]: r["df"] for r in of.where(F.col("shard") == k).collect()}, total, mean) if shards > 1 else None  # words of a shard: bounded
        sent = spark.sparkContext.broadcast(Index(items, whole))

        def found(batches, sent=sent):
            for batch in slices(batches):
                best: dict = {}
                ids = batch.column("doc_id").to_pylist()
                for r, item, score, q, a, first in matches(batch, sent.value):
                    x = (score, q, a, -first)
                    if x > best.get((ids[r], item), (-1,)):
                        best[ids[r], item] = x
                rows = [(i, item, s, q, a, -f) for (i, item), (s, q, a, f) in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()])], names)

        def clean(batches, sent=sent):
            for batch in slices(batches):
                ok = np.ones(batch.num_rows, bool)
                for r, *_ in matches(batch, sent.value):
                    ok[r] = False
                yield batch.filter(pa.array(ok))

        if keep is None:
            parts.append(d.mapInArrow(found, schema))
        else:
            d = d.mapInArrow(clean, d.schema)
    if keep is not None:
        return d.select(*keep)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage")).alias("p")))
    out = out.groupBy("doc_id", "item_id").agg(best.alias("m"))
    return out.select("doc_id", "item_id", "m.score", "m.question_overlap", "m.answer_overlap", (-F.col("m.p")).alias("passage"))


def query(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
