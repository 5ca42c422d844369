"""N-gram Jaccard join: universe-partition pigeonhole with size bands, one-deletion neighbourhoods and exact verification.

A document's set holds the hashes of its word shingles. Sets fall into size bands such that a pair
with similarity >= 0.8 lies in one band or in two neighbouring ones. For each band, a hash partitions the universe of
shingles into m segments. If two sets differ by at most H elements, and a set spends a budget of at least H + 1 on
its segments - 1 where it asks for equality, 2 where one-deletion neighbourhoods also find segments that differ by one
element, 0 where its segment is empty - then one of these segments must match. How many segments there
are, and for how many neighbourhoods are indexed, is allocated for each band by cost: the fewest signatures
for which practically every set has the budget. A first pass finds the bands where some set falls short; there m grows until none does,
so the join is exact.

Signatures travel packed in arrays by bucket. Sets that are equal are one node. Within a signature's group, only a star around
the smallest node is emitted, never all pairs; stars are verified on the texts. Only where a member failed
against its centre are pairs of the centre's members in different components tested as well: parity bits of the sets
rule out nearly all that cannot be similar, and what they leave is verified, nearest first.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, bloom, bloom_has, mix, pick, rolling, row_key, slices, trim, utf8, word_hashes, word_spans, written
from .graph import components

WORDS = 5
NUM, DEN = 4, 5            # similarity >= NUM / DEN
PER_BUCKET = 500_000     # signatures in a bucket, about
SIGMA = 5.0
BANDS_IN_USE = 20         # about as many size bands hold nearly all sets
LEAST_BITS = 512


# ---------------------------------------------------------------- sets

def sets(batch: pa.RecordBatch, words: int = WORDS):
    """The distinct shingle hashes (sorted) of each text of the batch."""
    data, offsets = utf8(batch.column("text"))
    start, end, first = word_spans(data, offsets)
    h = word_hashes(data, start, end)
    grams = rolling(h, words)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:  # the whole sequence as one
            yield mix(rolling(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield h[:0]


def set_hash(s: np.ndarray) -> int:
    """Node of a set: equal sets have equal nodes."""
    return int(mix(np.add.reduce(mix(s ^ M1), dtype=np.uint64).reshape(1) + np.uint64(len(s)) * M1)[0].astype(np.int64))


def parity(s: np.ndarray) -> bytes:
    """Bits, at least twice as many as elements, each the parity of the elements that hash to it. Where two sets' bits differ, the sets
    differ by an element at least, so the number of different bits is a lower bound of their difference."""
    size = max(LEAST_BITS, 1 << int(2 * len(s) - 1).bit_length())
    at = (mix(s) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def halved(words: np.ndarray) -> np.ndarray:
    """The bits of half the number that the same sets have."""
    h = words.shape[-1] // 2
    return words[..., :h] ^ words[..., h:]


# ---------------------------------------------------------------- bands and allocation

@lru_cache(None)
def bands(most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    lo, los, his = 1, [], []
    while lo <= most:
        hi = lo * DEN // NUM
        los.append(lo)
        his.append(hi)
        lo = hi + 1
    return np.array(los), np.array(his)


@lru_cache(None)
def allocation(band: int, level: int) -> tuple[int, int, int]:
    """(m, q, need) of a band: segments, segments with one-deletion neighbourhoods (the first q), and the budget that proves a match.

    Chosen by cost: among several shares of neighbourhoods, the fewest signatures such that a set of the band's least size has
    the budget by SIGMA standard deviations, with a charge on segments so small that they match by chance. Each level grows m by half."""
    los, his = bands()
    lo, hi = int(los[band]), int(his[band])
    need = (hi + hi * DEN // NUM) * (DEN - NUM) // (DEN + NUM) + 1
    best = None
    for share in (0.0, 0.1, 0.25, 0.5, 1.0):
        m = max(1, math.ceil(need / (1 + share)))
        while m <= 4 * hi:
            q, lam = math.ceil(share * m), lo / m
            p0, p1 = (1 - 1 / m) ** lo, (lo / m * (1 - 1 / m) ** (lo - 1))
            mean = m * (1 - p0) + q * (1 - p0 - p1)
            var = m * p0 * (1 - p0) * (1 + 3 * share)
            if mean - SIGMA * math.sqrt(var) >= need or m >= 4 * hi - 1:
                cost = (m + q * (lam + 1)) * (1 + max(0.0, 3 - lam))
                if best is None or cost < best[0]:
                    best = (cost, m, q)
                break
            m = max(m + 1, int(m * 1.04))
    m, q = best[1], best[2]
    for _ in range(level):
        m = m + m // 2 + 1
    return m, q, need


def segments(s: np.ndarray, band: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mixed elements in order of segment, each non-empty segment's number, its first element, its size)."""
    m, _, _ = allocation(band, level)
    h = mix(s + np.uint64(band * 1000 + level + 1) * M1)
    seg = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(seg, kind="stable")
    seg, h = seg[order], h[order]
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    return h, seg[first], first, np.diff(np.r_[first, len(seg)])


def budget(s: np.ndarray, band: int, level: int) -> bool:
    _, q, need = allocation(band, level)
    _, seg, _, n = segments(s, band, level)
    return len(seg) + int(((seg < q) & (n >= 2)).sum()) >= need


def short_of(s: np.ndarray, band: int) -> int:
    """The first level at which the set has the budget. Ends: with ever more segments every element has one of its own."""
    level = 0
    while not budget(s, band, level):
        level += 1
    return level


def signatures(s: np.ndarray, band: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the set's segments and of their one-deletion neighbourhoods, and the segment of each."""
    _, q, _ = allocation(band, level)
    h, seg, first, n = segments(s, band, level)
    total = np.add.reduceat(h, first)
    tag = (seg + np.uint64(band << 40)) * M1
    out, of = [mix(total + n.astype(np.uint64) * M1 + mix(tag))], [seg]
    near = np.flatnonzero((seg < q) & (n >= 2))
    if len(near):
        rep = np.repeat(near, n[near])
        at = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in near])
        out.append(mix(total[rep] - h[at] + (n[rep] - 1).astype(np.uint64) * M1 + mix(tag[rep])))
        of.append(seg[rep])
    return np.concatenate(out), np.concatenate(of).astype(np.int64)


def bands_of(n: int) -> list[int]:
    """The bands in which a set of this size has signatures: its own and the one below, whose members can be up to 1 / 0.8 smaller."""
    b = int(np.searchsorted(bands()[0], n, "right")) - 1
    return [b, b - 1] if b else [b]


# ---------------------------------------------------------------- passes over the texts

def survey(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, node, parity bits, and levels: for each of the set's bands, the level it needs (band * 64 + level).

    Within a task only the first row of a node carries bits."""
    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            n, node, levels, bits = [], [], [], []
            for s in sets(batch):
                n.append(len(s))
                node.append(set_hash(s) if len(s) else 0)
                fresh = len(s) and node[-1] not in seen
                seen.add(node[-1])
                levels.append([b * 64 + short_of(s, b) for b in bands_of(len(s))] if fresh else [])
                bits.append(parity(s) if fresh else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.array(levels, pa.list_(pa.int32()))], ["doc_id", "row", "n_shingles", "node", "bits", "levels"])

    return docs.mapInArrow(run, "doc_id long, row binary, n_shingles long, node long, bits binary, levels array<int>")


FLUSH = 750_000  # signatures kept before a task writes them out


def signed(docs: DataFrame, level: dict[int, int], parts: int) -> DataFrame:
    """Packed signatures: bucket, sigs (uint64), nodes (int64), runs (uint32: signatures of each node). Within a task, each node only once.

    A bucket holds whole segments of a band, every parts-th: so that a pair that agrees on many segments meets in few buckets."""
    def run(batches):
        seen: set[int] = set()
        sigs, where, nodes, kept = [], [], [], 0

        def flush():
            sig, b = np.concatenate(sigs), np.concatenate(where)
            node = np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs])
            order = np.argsort(b, kind="stable")
            sig, node, b = sig[order], node[order], b[order]
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            rows = []
            for x, y in zip(cut, np.r_[cut[1:], len(b)]):
                part = node[x:y]
                run = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                rows.append((int(b[x]), sig[x:y].tobytes(), part[run].tobytes(), np.diff(np.r_[run, len(part)]).astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "sigs", "nodes", "runs"])

        for batch in slices(batches):
            for s in sets(batch):
                if not len(s) or (h := set_hash(s)) in seen:
                    continue
                seen.add(h)
                for b in bands_of(len(s)):
                    x, seg = signatures(s, b, level.get(b, 0))
                    sigs.append(x)
                    where.append(b * parts + seg % parts)
                    nodes.append(h)
                    kept += len(x)
                if kept > FLUSH:
                    yield flush()
                    sigs, where, nodes, kept = [], [], [], 0
        if sigs:
            yield flush()

    return docs.mapInArrow(run, "bucket int, sigs binary, nodes binary, runs binary")


def matched(packed: DataFrame) -> DataFrame:
    """(u, v): for each group of nodes that share a signature, its smallest node u with each other one v; each pair once a bucket."""
    def run(key, pdf):
        sig = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["sigs"]])
        node = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(r, np.uint32)) for a, r in zip(pdf["nodes"], pdf["runs"])])
        order = np.argsort(sig)
        sig = sig[order]
        twice = np.zeros(len(sig), bool)
        same = sig[1:] == sig[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        sig, node = sig[twice], node[order[twice]]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
        u = node[first][np.cumsum(first) - 1] if len(sig) else node
        pairs = np.unique(np.stack([u, node], 1)[u != node], axis=0) if len(sig) else np.zeros((0, 2), np.int64)
        trim()
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return packed.groupBy("bucket").applyInPandas(run, "u long, v long")


class Sketches:
    """Parity bits of several sets. Sets that are similar have equally many bits or twice as many."""

    def __init__(self, bits: list[bytes]):
        own = [np.frombuffer(b, np.uint64) for b in bits]
        self.size = np.array([len(w) for w in own])
        self.at, self.of = {}, {}
        for size in set(self.size.tolist()) | {int(x) // 2 for x in self.size}:
            rows = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            self.at[size] = np.full(len(own), -1)
            self.at[size][rows] = np.arange(len(rows))
            self.of[size] = np.stack([own[r] if self.size[r] == size else halved(own[r]) for r in rows])

    def differing(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits that differ between set i and the others, in the smaller number of bits of both."""
        out = np.zeros(len(others), np.int64)
        low = np.minimum(self.size[others], self.size[i])
        for size in np.unique(low):
            k = np.flatnonzero(low == size)
            at, of = self.at[int(size)], self.of[int(size)]
            out[k] = np.bitwise_count(of[at[others[k]]] ^ of[at[i]]).sum(-1, dtype=np.int64)
        return out


def differing(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = halved(x)
    while len(y) > len(x):
        y = halved(y)
    return int(np.bitwise_count(x ^ y).sum())


def apart(star: DataFrame, checked: DataFrame, root: DataFrame, nodes: DataFrame, every: bool) -> DataFrame:
    """Pairs (u, v) of nodes in different components that share a centre, and which sizes and parity bits leave possible: all, or the nearest of each node.

    All members of a centre hold at least the pairs that share a signature with it as their group's centre. Only members outside
    the largest component are compared, with all others; nothing but possible pairs is emitted."""
    failed = star.join(checked.where("linked"), ["u", "v"], "left_anti").select("u").distinct()
    near = star.join(failed, "u")
    m = near.select(F.col("u").alias("g"), F.col("v").alias("node")).union(failed.select("u", "u"))
    m = m.join(root, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
    # a centre with one member is tested already
    mixed = m.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("c")).where("a <> b and c > 2").select("g")
    m = m.join(mixed, "g").join(nodes.select("node", "n", "bits"), "node")

    def run(key, pdf):
        node, n = pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        _, comp = np.unique(pdf["root"].to_numpy(np.int64), return_inverse=True)
        sketches = Sketches(pdf["bits"].tolist())
        small = np.flatnonzero(comp != np.bincount(comp).argmax())
        out = []
        for i in small:
            at = np.flatnonzero((comp != comp[i]) & (NUM * np.maximum(n, n[i]) <= DEN * np.minimum(n, n[i])) & (every | (node != key[0])))
            if not len(at):
                continue
            slack = (DEN - NUM) * (n[at] + n[i]) - (DEN + NUM) * sketches.differing(i, at)
            at, slack = at[slack >= 0], slack[slack >= 0]
            if len(at):
                out.append(np.stack([np.full(len(at), node[i]), node[at]], 1) if every else np.array([[node[i], node[at[slack.argmax()]]]]))
        p = np.sort(np.concatenate(out), 1) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"u": p[:, 0], "v": p[:, 1]})

    return m.groupBy("g").applyInPandas(run, "u long, v long").distinct()


# ---------------------------------------------------------------- verification

def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the wanted nodes: the text of each node's representative document. Only texts that pass a small filter are shuffled.
    A null doc_id counts as 0 here: the representative of a node whose rows all have none."""
    spark = docs.sparkSession
    ask = written(wanted.join(nodes.select("node", F.coalesce("rep", F.lit(0)).alias("rep")), "node"), "ask")
    sent = spark.sparkContext.broadcast(bloom(ask.select(F.col("rep").alias("id"))))

    def run(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id").fill_null(0)
            ok = bloom_has(sent.value, ids.to_numpy(zero_copy_only=False))
            if ok.any():
                batch = batch.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array([set_hash(s) if len(s) else 0 for s in sets(batch)], pa.int64()), batch.column("text").cast(pa.string())], ["rep", "node", "text"])

    near = docs.mapInArrow(run, "rep long, node long, text string")
    return near.join(ask, ["rep", "node"]).dropDuplicates(["rep", "node"]).select("node", "text")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    inner = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * inner >= NUM * (len(a) + len(b) - inner)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> with linked: the exact similarity of both texts' sets is at least 0.8."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    t = written(texts_of(docs, nodes, wanted), "texts")
    both = (pairs.join(t.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
            .join(t.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v"))

    def run(batches):
        for whole in batches:
            for batch in slices([whole], column="tu"):
                one = {}

                def of(column):
                    return sets(pa.RecordBatch.from_arrays([batch.column(column)], ["text"]))

                us = batch.column("u").to_pylist()
                left = []
                known = [us.index(u) for u in us] if len(us) < 64 else [one.setdefault(u, i) for i, u in enumerate(us)]
                for i, s in enumerate(of("tu")) if len(set(known)) > len(us) // 2 else ():
                    left.append(s)
                if not left:  # many pairs of few centres: each centre's set once
                    firsts = sorted(set(known))
                    by = dict(zip(firsts, sets(pa.RecordBatch.from_arrays([batch.column("tu").take(pa.array(firsts))], ["text"]))))
                    left = [by[k] for k in known]
                ok = [similar(a, b) for a, b in zip(left, of("tv"))]
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(ok, pa.bool_())], ["u", "v", "linked"])

    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long, linked boolean")


# ---------------------------------------------------------------- the join

def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Rows with null or wordless text have n_shingles 0 and are components of their own. Rows with equal sets are linked. A row with null doc_id
    takes part; component_id is the smallest non-null doc_id of its component, null if there is none. Extra columns are ignored."""
    d = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("row", F.lit(b""))
    return components_of(d).select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, that with the smallest doc_id (null last); wordless rows stay. Of rows that are equal in all columns one stays."""
    d = docs.withColumn("row", row_key(docs))
    kept = components_of(d.select("doc_id", "text", "row")).where("row = least.row").select("row").distinct()
    return d.join(kept, "row").dropDuplicates(["row"]).select(*docs.columns)


def components_of(d: DataFrame) -> DataFrame:
    """d (doc_id, text, row) -> doc_id, row, n_shingles, least: the doc_id and row of the component's first member."""
    spark = d.sparkSession
    a = written(survey(d), "sets")
    level: dict[int, int] = {}
    for r in a.select(F.explode("levels").alias("x")).groupBy(F.floor(F.col("x") / 64).cast("int").alias("band")).agg(F.max(F.col("x") % 64).alias("level")).collect():
        level[r["band"]] = r["level"]  # one row for each size band
    nodes = written(a.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(first()).alias("first"), F.max("n_shingles").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total * 0.7 / PER_BUCKET / BANDS_IN_USE))
    star = written(matched(signed(d, level, parts)).distinct(), "stars")
    ends = star.select(F.col("u").alias("node")).union(star.select(F.col("v").alias("node"))).distinct()
    sketch = written(a.where("bits is not null").select("node", "bits", F.col("n_shingles").alias("n")).join(ends, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    checked = written(verified(d, nodes, in_reach(star, sketch)), "links")
    root = components(checked.where("linked").select("u", "v"))
    # where a member failed against its centre: pairs of the centre's members that are still apart. First each node's nearest, then the rest
    for every in (False, True):
        more = written(apart(star, checked, root, sketch, every).join(checked, ["u", "v"], "left_anti"), "apart")
        if more.isEmpty():
            continue  # the nearest may all have been checked before; the rest have not
        checked = checked.union(written(verified(d, nodes, more), "links"))
        root = components(checked.where("linked").select("u", "v"))
    label = nodes.join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = label.groupBy("root").agg(F.min("first").alias("least"))
    of = label.join(least, "root").select("node", "least")
    out = a.where("n_shingles > 0").join(of, "node").select("doc_id", "row", "n_shingles", "least")
    return out.union(a.where("n_shingles = 0").select("doc_id", "row", "n_shingles", first().alias("least")))


def first():
    """Sorts rows by doc_id, null last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def in_reach(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and parity bits leave the similarity possible."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    p = pairs.join(side("u"), "u").join(side("v"), "v").where(f"{NUM} * greatest(nu, nv) <= {DEN} * least(nu, nv)")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv")))
            ok = [(DEN - NUM) * (m + n) >= (DEN + NUM) * differing(a, b) for m, n, a, b in rows]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return p.mapInArrow(run, "u long, v long")


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) s from w),
e as (select doc_id, len(s) n, unnest(s) g from s),
p as (select a.doc_id u, b.doc_id v, any_value(a.n) + any_value(b.n) n, count(*) c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select u, v from p where 100 * c >= 80 * (n - c)),
r as (select doc_id, doc_id o from s union select r.doc_id, l.v from r join l on r.o = l.u)
select s.doc_id, cast(len(s) as bigint) n_shingles, m component_id from s join (select doc_id, min(o) m from r group by doc_id) using (doc_id)
"""
