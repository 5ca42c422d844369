"""Document scores by masked pseudo-likelihood.

Tokens are characters folded into CLASSES classes. A window network - embeddings of the SIDE tokens on either side, one hidden layer, a
softmax over classes - predicts every token from both sides. It is trained in numpy, by rounds: each task takes Adam steps on the
contexts that it holds, and the driver averages the parameters by weight. What it learns from are the counts of all contexts of all documents: the
rounds together pass over every token at least once, so that steps grow with the tokens; few tokens are passed over several times. A document's score is the sum over its tokens of the log-probability given both sides.

Scores are looked up: a batch's distinct contexts go through the network once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions, pick, slices, written

CLASSES = 64
BITS = 6
SIDE = 2
EMBED, HIDDEN = 12, 48
ROUNDS = 4
STEP_ROWS = 1024
LEAST_STEPS = 200     # of a round; fewer tokens are passed over several times
RATE = 0.01
PIECE = 1 << 22
BUCKET_TOKENS = 8 << 20  # tokens for each bucket of contexts
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000  # few tokens are trained on in parallel as well

FIXED = {"\n": 1, " ": 2, ".": 3, ",": 4, "'": 5, '"': 6, "-": 7, ":": 8, ";": 9, "!": 10, "?": 11, "(": 12, ")": 13}
DIGIT, OTHER, LATIN, FURTHER = 14, 15, 16, 42  # a-z: 16 to 41; further letters share the rest

_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point. 0 is the place beyond either end of a text."""
    if not _CLASS:
        out = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x30000):
            ch = chr(cp)
            if ch in FIXED:
                out[cp] = FIXED[ch]
                continue
            cat = unicodedata.category(ch)
            if cat[0] == "L":
                low = ord(ch.lower()[0])
                out[cp] = LATIN + low - 97 if 97 <= low <= 122 else FURTHER + (low * 2654435761 % (1 << 32)) * (CLASSES - FURTHER) >> 32
            elif cat == "Nd":
                out[cp] = DIGIT
            elif cat[0] == "Z" or ch in "\t\r\x0b\x0c":
                out[cp] = FIXED[" "]
        _CLASS.append(out)
    return _CLASS[0]


def contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, context) of each token of the batch's texts; a context packs the 2 * SIDE + 1 classes around and at the token, the token's own last."""
    texts = batch.column("text")
    texts = texts.fill_null("") if texts.null_count else texts
    n = np.asarray(pa.compute.utf8_length(texts), np.int64)
    joined = "".join(texts.to_pylist())
    c = classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    padded = np.zeros(len(c) + 2 * SIDE * len(n), np.int64)
    at = np.arange(len(c)) + SIDE * (2 * row + 1)
    padded[at] = c
    size = max(0, len(padded) - 2 * SIDE)  # contexts of all places, those between texts too
    key = np.zeros(size, np.int64)
    for k in [*range(-SIDE, 0), *range(1, SIDE + 1), 0]:
        key <<= BITS
        key |= padded[SIDE + k : SIDE + k + size]
    return row, key[at - SIDE], len(n)


def unpack(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes around, class at) of contexts."""
    x = np.stack([(key >> (BITS * (2 * SIDE - k))) & (CLASSES - 1) for k in range(2 * SIDE + 1)], 1)
    return x[:, :-1], x[:, -1]


# ---------------------------------------------------------------- network

def initial(seed: int = 1) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = 2 * SIDE * EMBED
    return [rng.normal(0, 0.3, (CLASSES, EMBED)), rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, CLASSES)), np.zeros(CLASSES)]


def hidden(p, around):
    e = p[0].take(around, 0).reshape(len(around), -1)
    h = e @ p[1]
    h += p[2]
    return e, np.tanh(h, out=h)


def forward(p, around):
    e, h = hidden(p, around)
    z = h @ p[3] + p[4]
    z -= z.max(1, keepdims=True)
    return e, h, z - np.log(np.exp(z).sum(1, keepdims=True))


def gradients(p, around, at, share=None, row=None):
    """Of the mean loss; with share, of the sum of losses weighted by it. With row, token k stands between the classes around[row[k]], so that
    tokens between the same neighbours go through the network as one row; then no pair of row and class may occur twice."""
    kind = p[0].dtype
    if share is None:
        share = np.full(len(at), 1 / len(at), kind)
    if row is None:
        row = np.arange(len(at))
    e, h = hidden(p, around)
    d = h @ p[3]
    d += p[4]
    if max(d.max(), -d.min()) > 80:  # else no exponential leaves the range of its type
        d -= d.max(1, keepdims=True)
    np.exp(d, out=d)
    d *= (np.bincount(row, share, len(around)).astype(kind) / (d @ np.ones(CLASSES, kind)))[:, None]
    d.reshape(-1)[row * CLASSES + at] -= share
    dh = d @ p[3].T
    dv, rows = h.T @ d, np.ones(len(around), kind)
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    de = (dh @ p[1].T).reshape(-1, EMBED)
    flat = around.astype(np.uint8).reshape(-1)  # bytes sort by radix
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = changes(flat).nonzero()[0]
    emb = np.zeros((CLASSES, EMBED), kind)
    emb[flat[first]] = np.add.reduceat(de.take(order, 0), first, axis=0)
    return [emb, e.T @ dh, rows @ dh, dv, rows @ d]


def changes(x: np.ndarray) -> np.ndarray:
    """Whether an entry begins a run of equal entries."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def n_steps(tokens: int, rounds: int) -> int:
    """Steps of a round, such that all rounds pass over all tokens."""
    return max(LEAST_STEPS, -(-tokens // (STEP_ROWS * rounds)))


def passed(count, seed, k, rounds):
    """For each step of round k: (contexts, how often each), STEP_ROWS tokens in all.

    The tokens are a line, on which each context takes its count. A grid of at least as many points lies evenly over it; every point
    belongs to one step of one round, and the points of a step are evenly spread."""
    total = np.cumsum(count)
    tokens, n = int(total[-1]), n_steps(int(total[-1]), rounds)
    points = n * STEP_ROWS * rounds
    row = np.arange(STEP_ROWS, dtype=np.int64) * (n * rounds)
    for t in np.random.default_rng(seed).permutation(n):
        point = row + (t * rounds + k)
        token = point * tokens // points if tokens < 1 << 31 else (point.astype(object) * tokens // points).astype(np.int64)
        drawn = np.searchsorted(total, token, "right")
        first = changes(drawn).nonzero()[0]
        yield drawn.take(first), np.diff(first, append=STEP_ROWS)


def steps(p, key, count, seed, rate, k=0, rounds=1):
    """Adam steps of round k over its tokens; the more tokens, the more steps."""
    shapes, kind = [x.shape for x in p], p[0].dtype
    line = np.concatenate([x.ravel() for x in p]).astype(np.float32)  # all parameters, of which p are views
    p = parted(line, shapes)
    m, v, work = np.zeros_like(line), np.zeros_like(line), np.empty_like(line)
    n = n_steps(int(count.sum()), rounds)
    around, at = unpack(key)
    new = changes(key >> BITS)
    around, between = around[new], np.cumsum(new) - 1
    for t, (drawn, times) in enumerate(passed(count, seed, k, rounds), 1):
        near = between.take(drawn)
        new = changes(near)
        g = np.concatenate([x.ravel() for x in gradients(p, around.take(near[new], 0), at.take(drawn), (times / STEP_ROWS).astype(np.float32), np.cumsum(new) - 1)])
        r = np.float32(rate * (1 - t / (n + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t))
        np.subtract(g, m, out=work)
        work *= np.float32(0.1)
        m += work
        g *= g
        g -= v
        g *= np.float32(0.001)
        v += g
        np.sqrt(v, out=work)
        work += np.float32(1e-8)
        np.divide(m, work, out=work)
        work *= r
        line -= work
    return [x.astype(kind) for x in p]


def parted(line: np.ndarray, shapes) -> list[np.ndarray]:
    """Views of line in these shapes, one after the other."""
    cut = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    return [line[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], shapes)]


# ---------------------------------------------------------------- training

def counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed counts of all contexts of all documents: bucket, keys (packed_keys), times (int64). Counted within tasks, then by bucket, which is a hash of the classes around:
    tokens between the same neighbours are in one bucket, which so sees each of their classes in its share, and takes them through the network as one row."""
    def packed(key, n):
        b = ((mix(key >> BITS) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(b, kind="stable")
        key, n, b = key[order], n[order], b[order]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        ends = np.r_[cut[1:], len(b)]
        return pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array([packed_keys(key[x:y]) for x, y in zip(cut, ends)], pa.binary()), pa.array([n[x:y].astype(np.uint32).tobytes() for x, y in zip(cut, ends)], pa.binary())], ["bucket", "keys", "times"])

    def run(batches):
        keys, times, size = [], [], 0
        for batch in slices(batches, PIECE):
            _, k, _ = contexts(batch)
            k, c = np.unique(k, return_counts=True)
            keys.append(k)
            times.append(c)
            size += len(k)
            if size > 1_500_000:
                k, c = merged(keys, times)
                keys, times, size = [k], [c], len(k)
                if size > 1_000_000:
                    yield packed(k, c)
                    keys, times, size = [], [], 0
        if size:
            yield packed(*merged(keys, times))

    def add(key, pdf):
        k, n = merged([unpacked_keys(x) for x in pdf["keys"]], [np.frombuffer(x, np.uint32) for x in pdf["times"]])
        return pd.DataFrame({"bucket": [key[0]], "keys": [packed_keys(k)], "times": [n.tobytes()]})

    schema = "bucket int, keys binary, times binary"
    return docs.mapInArrow(run, schema).groupBy("bucket").applyInPandas(add, schema)


def packed_keys(key: np.ndarray) -> bytes:
    """Rising keys as their differences, byte by byte, so that most bytes are alike."""
    return np.ascontiguousarray(np.diff(key, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def merged(keys, times):
    k, n = np.concatenate(keys), np.concatenate(times)
    uniq, inv = np.unique(k, return_inverse=True)
    return uniq, np.bincount(inv, weights=n, minlength=len(uniq)).astype(np.int64)


def train(docs: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Parameters of the network, trained on the counts of all contexts. Reruns agree, whatever the session's settings: buckets follow from the number of tokens,
    draws are seeded by bucket and round, averages taken in order of bucket."""
    spark = docs.sparkSession
    tokens = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, LEAST_BUCKETS + tokens // BUCKET_TOKENS)
    table = written(counts(docs, buckets), "contexts")
    p = initial()
    shapes = [x.shape for x in p]
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(p)  # some 6,000 numbers

        def run(frames, sent=sent, k=k):
            for pdf in frames:
                for b, keys, times in zip(pdf["bucket"], pdf["keys"], pdf["times"]):
                    key, n = unpacked_keys(keys), np.frombuffer(times, np.int64)
                    q = steps(sent.value, key, n, [int(b), k], RATE / (1 + k), k, rounds)
                    yield pd.DataFrame({"bucket": [b], "weight": [float(n.sum())], "p": [np.concatenate([x.ravel() for x in q]).tobytes()]})

        # averages of averages: a fixed number of parts reach the driver
        def mean(key, pdf):
            pdf = pdf.sort_values("bucket")
            w = pdf["weight"].to_numpy()
            return pd.DataFrame({"part": [key[0]], "weight": [w.sum()], "p": [np.average([np.frombuffer(x) for x in pdf["p"]], axis=0, weights=w).tobytes()]})

        local = table.repartition(min(buckets, 8 * partitions(spark)), "bucket").mapInPandas(run, "bucket int, weight double, p binary")
        parts = sorted(local.withColumn("part", F.col("bucket") % 16).groupBy("part").applyInPandas(mean, "part int, weight double, p binary").collect(), key=lambda r: r["part"])
        if parts:
            flat = np.average([np.frombuffer(r["p"]) for r in parts], axis=0, weights=[r["weight"] for r in parts])
            p = parted(flat, shapes)
    return p


def log_probabilities(p, key: np.ndarray) -> np.ndarray:
    out = np.empty(len(key))
    p = [x.astype(np.float32) for x in p]
    for a in range(0, len(key), 65536):
        around, at = unpack(key[a : a + 65536])
        new = np.r_[True, (around[1:] != around[:-1]).any(1)] if len(around) else np.zeros(0, bool)  # sorted contexts: tokens between the same neighbours
        _, _, lp = forward(p, around[new])
        out[a : a + 65536] = lp[np.cumsum(new) - 1, at]
    return out


def scored(docs: DataFrame, p: list[np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, pseudo_loglik (sum of log-probabilities, natural), mean_loglik (null for texts without tokens)."""
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        for batch in slices(batches, PIECE):
            row, key, n = contexts(batch)
            bits = len(key).bit_length()
            key = key << bits | np.arange(len(key))  # contexts take 30 bits; sorting these is several times as fast as argsort
            key.sort()
            order = key & ((1 << bits) - 1)
            key >>= bits
            new = changes(key)
            lp = log_probabilities(sent.value, key[new])[np.cumsum(new) - 1]
            size = np.bincount(row, minlength=n)
            line = np.empty(len(lp))
            line[order] = lp  # sums in the order of the text, whatever else is in the batch
            total = np.bincount(row, weights=line, minlength=n)
            mean = [t / s if s else None for t, s in zip(total, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(total), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "pseudo_loglik", "mean_loglik"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, pseudo_loglik double, mean_loglik double")


def score_documents(docs: DataFrame) -> DataFrame:
    """See scored(); trained on the same documents. Null text counts as empty and scores 0; with no text at all the network stays as it begins. Extra columns are ignored."""
    d = pick(docs, {"doc_id": "long", "text": "string"})
    return scored(d, train(d))


def query(spark, sf_dir):
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
