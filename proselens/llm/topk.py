"""Exact top-k search: columnar branch-and-bound over blocks of vectors.

Vectors become integers floor(256 * x) and are packed into blocks, one contiguous array per
dimension (vertical layout). Each block of queries meets each block of candidates once. Within
such a pair, partial inner products grow by a few dimensions at a time; after each step a candidate is
dropped for a query when its partial score plus the most that the remaining dimensions can still add
(Cauchy-Schwarz on the remaining mass of both vectors) is below the query's k-th best score known so
far, and the surviving columns are compacted once half of them are gone for all queries. Dropping is
strict, so ties are kept, and results are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pick, written

BLOCK = 8192      # candidates in a block
QUERIES = 2048    # queries in a block
FEW_BYTES = 64 << 20  # of queries, which are broadcast up to there
STEP = 8          # dimensions added between two prunings
SAFE = 2.0**52    # below it sums of products of integers are exact in doubles


def pack(frames, wanted: bool):
    """Blocks of (ids, values): column-major int64, rows padded with zeros to the longest vector."""
    size = QUERIES if wanted else BLOCK
    ids: list = []
    rows: list = []

    def block():
        width = max(map(len, rows))
        m = np.zeros((width, len(rows)), np.int64)
        for j, r in enumerate(rows):
            m[: len(r), j] = r
        return pd.DataFrame({"ids": [np.asarray(ids, np.int64).tobytes()], "dims": [width], "values": [m.tobytes()]})

    for pdf in frames:
        for i, v in zip(pdf["vec_id"], pdf["q"]):
            ids.append(i)
            rows.append(np.asarray(v, np.int64))
            if len(ids) == size:
                yield block()
                ids, rows = [], []
    if ids:
        yield block()


def search(q_ids, q, c_ids, c, k: int):
    """The k best of the candidates for each query: parallel arrays of (query, candidate, score)."""
    dims = max(len(q), len(c))
    q = np.vstack([q, np.zeros((dims - len(q), q.shape[1]), np.int64)])
    c = np.vstack([c, np.zeros((dims - len(c), c.shape[1]), np.int64)])
    top = float(max(1, np.abs(q).max(initial=0))) * float(max(1, np.abs(c).max(initial=0))) * max(1, dims)
    exact = top < SAFE
    if exact:
        q, c = q.astype(np.float64), c.astype(np.float64)
    # dimensions that carry most of the queries' mass first
    mass = (q.astype(np.float64) ** 2).sum(1)
    order = np.argsort(-mass, kind="stable")
    q, c = q[order], c[order]
    qq = np.vstack([np.cumsum((q.astype(np.float64) ** 2)[::-1], 0)[::-1], np.zeros((1, q.shape[1]))])
    cc = np.vstack([np.cumsum((c.astype(np.float64) ** 2)[::-1], 0)[::-1], np.zeros((1, c.shape[1]))])
    # a first bound from the candidates with the greatest norms
    n = c.shape[1]
    seed = np.argsort(-cc[0], kind="stable")[: max(4 * k, 64)]
    first = q.T @ c[:, seed]
    own = q_ids[:, None] == c_ids[seed][None, :]
    first = np.where(own, np.iinfo(np.int64).min // 2, first)
    bound = np.sort(first, 1)[:, -k] if len(seed) >= k else np.full(len(q_ids), -np.inf)
    bound = np.where(own.sum(1) + k > len(seed), -np.inf, bound.astype(np.float64))
    alive = np.arange(n)
    score = np.zeros((len(q_ids), n), q.dtype)
    keep = np.ones((len(q_ids), n), bool)
    for d in range(0, dims, STEP):
        to = min(dims, d + STEP)
        score += q[d:to].T @ c[d:to][:, alive]
        slack = np.sqrt(qq[to])[:, None] * np.sqrt(cc[to][alive])[None, :]
        keep &= score + slack * (1 + 1e-9) + 1e-6 >= bound[:, None]
        some = keep.any(0)
        if some.sum() * 2 <= len(alive):
            alive, score, keep = alive[some], score[:, some], keep[:, some]
            if not len(alive):
                break
    out = []
    cand = c_ids[alive]
    for i in range(len(q_ids)):
        at = np.flatnonzero(keep[i] & (cand != q_ids[i]))
        if len(at):
            best = at[np.lexsort((cand[at], -score[i, at]))][:k]
            out.append((np.full(len(best), q_ids[i]), cand[best], score[i, best].astype(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, few: int = FEW_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, the k rows (never itself) with the
    highest inner product of floor(256 * x), ties to the smaller vec_id.

    Vectors that are null or hold a null, NaN or infinite component, and rows without vec_id, take no part; shorter vectors
    count as padded with zeros; an empty vector scores 0. Of rows with one vec_id each takes part as a candidate,
    and a query is asked once (with its least vector). Scores are exact while they fit 63 bits. Extra columns are ignored."""
    v = pick(vectors, {"vec_id": "long", "embedding": "array<double>"})
    v = v.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    v = v.select("vec_id", F.transform("embedding", lambda x: F.floor(x * 256).cast("long")).alias("q"))
    spark = vectors.sparkSession
    schema = "ids binary, dims int, values binary"
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    q = written(asked.mapInPandas(lambda it: pack(it, True), schema).withColumn("qb", F.expr("uuid()")), "topk-queries")
    c = v.mapInPandas(lambda it: pack(it, False), schema)

    def block(x):
        ids = np.frombuffer(x["ids"], np.int64)
        return ids, np.frombuffer(x["values"], np.int64).reshape(x["dims"], -1) if x["dims"] else np.zeros((0, len(ids)), np.int64)

    def both(q_, c_):
        found = [search(q_[0][a : a + 256], q_[1][:, a : a + 256], *c_, k) for a in range(0, len(q_[0]), 256)]
        x, y, s = (np.concatenate(z) for z in zip(*found))
        return pd.DataFrame({"query_id": x, "vec_id": y, "score": s})

    out = "query_id long, vec_id long, score long"
    if (q.agg(F.sum(F.length("values") + F.length("ids"))).first()[0] or 0) <= few:
        sent = spark.sparkContext.broadcast([r.asDict() for r in q.orderBy("qb").collect()])  # of few bytes, as just counted

        def run(frames):
            for pdf in frames:
                for c_ in map(block, pdf.to_dict("records")):
                    for q_ in map(block, sent.value):
                        yield both(q_, c_)

        return ranked(c.mapInPandas(run, out), k)
    # beyond that, a grid: every block of queries in each of `wide` columns meets the candidate blocks of that column
    wide = partitions(spark)
    names = q.groupBy().agg(F.collect_list("qb").alias("names"))  # 36 bytes for QUERIES queries
    tiles = c.select(F.struct("ids", "dims", "values").alias("c"), F.pmod(F.xxhash64("ids"), F.lit(wide)).alias("col")).crossJoin(F.broadcast(names)).select("c", "col", F.explode("names").alias("qb"))
    rows = q.select("qb", F.struct("ids", "dims", "values").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))).alias("col"))

    def run_tiles(frames):
        for pdf in frames:
            for c_, q_ in zip(pdf["c"], pdf["q"]):
                yield both(block(q_), block(c_))

    return ranked(tiles.join(rows, ["qb", "col"]).select("c", "q").mapInPandas(run_tiles, out), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) q from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
select query_id, cast("rank" as int) "rank", vec_id, score from r where "rank" <= 5
"""
