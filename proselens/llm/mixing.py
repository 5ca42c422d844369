"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in a pseudorandom order, form one stream of words that is cut into blocks of fixed length. The
mix is a list of slots, each of which takes one block. Slots are grouped into output shards. Each shard draws its number of blocks of every
source from a multinomial distribution by the sources' shares of the target. What a source drew too often over all shards, evenly
spread draws of it, goes to the sources that were drawn too rarely, so that totals are met exactly. Within a source, draw j
reads block p(j mod blocks), where p is another pseudorandom permutation for each pass over the source. Permutations are swap-or-not
shuffles on hashes, valid for every length, so that nothing is sorted or kept to draw an index.

Positions within a source, of documents and of draws, are prefix sums in two levels (chunks, then within a chunk), so that no
task handles a whole source. Slots meet sources by an equi-join on intervals of shares, blocks meet documents by one on (source, block index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pick, row_key, written

WEIGHTS = (5, 2, 1)
BLOCK = 64        # words in a block
SHARD = 1024      # slots in an output shard
ROUNDS = 16
CAP = 3           # a source gives at most so many times its size
CHUNK = 1000      # documents in a chunk of the prefix sum, about
SLOTS_PER_TASK = 102_400  # whole shards
SHARDS_PER_CHUNK = 1000
FEW_SOURCES = 100_000  # rows of the table of sources that is broadcast at most; beyond that the joins shuffle


def permute(x: Column, n: Column, key: Column) -> Column:
    """Where x of 0..n-1 goes under the permutation chosen by key: a swap-or-not shuffle. In each round x and its partner
    (k - x) mod n change places or not, as a bit says that both derive from the larger of them."""
    def step(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - v, n)
        return F.when(F.xxhash64(F.greatest(v, other), key, r).bitwiseAND(1) == 1, other).otherwise(v)

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)]), x.cast("long"), step)


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null. Replacing whole strings is several times as fast as a regular expression that
    makes an array of the words: white space becomes pairs of marks, and a run of pairs collapses into one."""
    t = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(space), F.lit(" "))
    for mark in "\x01\x02":  # in the text, the marks are letters like others
        t = F.replace(t, F.lit(mark), F.lit("x"))
    t = F.replace(F.replace(t, F.lit(" "), F.lit("\x01\x02")), F.lit("\x02\x01"), F.lit(""))
    return F.get(F.transform(F.array(t), _gaps), F.lit(0))  # so that t is computed once


def _gaps(t: Column) -> Column:
    # length less what the removal of gaps leaves counts the gaps; those at the ends separate nothing
    gaps = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\x01"), F.lit("")))).cast("long")
    inner = gaps + 1 - F.startswith(t, F.lit("\x01")).cast("long") - F.endswith(t, F.lit("\x02")).cast("long")
    return F.when(F.octet_length(t) == 0, F.lit(0)).otherwise(inner).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, docs, source_size -> with weight and target (double).

    Each source i gets min(CAP * size, level * weight) words, where the level makes the sum that of all sizes:
    the shares that capped sources leave go to the others by weight until none is above its cap. Sources are ordered by
    the ratio of cap to weight; those before the first whose level fits are capped. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(WEIGHTS)
    t = sizes.withColumn("ord", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.get(F.lit(list(WEIGHTS)), F.col("ord") % n).cast("double")).withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    t = (t.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    # levels rise while sources are capped; the first source whose cap / weight is not below its level ends that
    t = t.withColumn("fits", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.row_number().over(by).alias("at"), "level")))
    t = t.withColumn("final", F.min("fits").over(whole)["level"])
    return t.select("source", "ord", "docs", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).alias("target"))


def small(table: DataFrame, sources: int) -> DataFrame:
    """The table of sources, to be broadcast if its counted rows are few."""
    return F.broadcast(table) if sources <= FEW_SOURCES else table


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """(one row for each source: ord, source, docs, source_size, target, blocks, slots, chunks, from_slot; number of sources; number of slots). Written, as it is read often."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").cast("long").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    t = (targets(sizes).withColumn("blocks", blocks)
         .withColumn("slots", F.when(F.col("source_size") > 0, F.least(F.col("blocks") * CAP, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0)).cast("long"))
         .withColumn("chunks", F.ceil(F.col("docs") / CHUNK).cast("long"))
         .withColumn("from_slot", F.coalesce(F.sum("slots").over(w), F.lit(0)).cast("long")))
    t = written(t, "sources")
    sources, n = t.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    return t, sources, int(n)


def prefix_sums(rows: DataFrame, by: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows with column out: the sum of value over the rows of the same `by` that come before, by chunk and then order."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, chunk).agg(F.sum(value).alias("_words"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_words").over(before(Window.partitionBy(by).orderBy(chunk))), F.lit(0))).drop("_words")
    inside = before(Window.partitionBy(by, chunk).orderBy(*order))
    out_of = rows.join(sums, [by, chunk]).withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
    return out_of.drop("_base")


def positions(docs: DataFrame, t: DataFrame, sources: int) -> DataFrame:
    """docs (doc_id, source, size, tie and any other columns) with those of its source and _from, its first word's place in the source."""
    of = t.select(F.col("source").alias("_s"), "ord", "source_size", "target", "chunks")
    d = docs.join(small(of, sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), "tie")
    d = d.withColumn("_h", F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")).withColumn("_chunk", F.col("_h") % F.col("chunks"))
    return prefix_sums(d, "ord", "_chunk", ["_h", "doc_id", "size", "tie"], "size", "_from").drop("chunks")


def uniform(slot: Column) -> Column:
    """A pseudorandom number from 0 to 1, less than 1, for each slot."""
    return F.shiftrightunsigned(F.xxhash64(slot, F.lit(-1).cast("long")), 11) / float(1 << 53)


def shard_counts(spark, t: DataFrame, sources: int, n: int, shard: int = SHARD) -> DataFrame:
    """out_shard, ord, count: how many blocks of each source every output shard draws, a multinomial draw by the sources' slots of all n."""
    per = max(1, SLOTS_PER_TASK // shard) * shard
    s = spark.range(0, n, 1, max(partitions(spark), -(-n // per))).select((F.col("id") / shard).cast("long").alias("out_shard"), uniform(F.col("id")).alias("u"))
    share = t.where("slots > 0").select("ord", (F.col("from_slot") / n).alias("lo"), ((F.col("from_slot") + F.col("slots")) / n).alias("hi"))
    # as many intervals as sources: a slot meets the sources that reach into its interval, two on average
    cells = max(1, sources)
    share = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("long"), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells).cast("long")))))
    met = s.withColumn("cell", F.floor(F.col("u") * cells).cast("long")).join(small(share, sources), "cell").where("u >= lo and u < hi")
    return met.groupBy("out_shard", "ord").agg(F.count(F.lit(1)).alias("count"))


def draws(spark, t: DataFrame, sources: int, n: int, shard: int = SHARD) -> DataFrame:
    """out_shard, ord, j: every slot of the mix as a draw of a source, numbered from 0 to its slots within the source."""
    c = written(shard_counts(spark, t, sources, n, shard).withColumn("_chunk", (F.col("out_shard") / SHARDS_PER_CHUNK).cast("long")), "counts")
    total = c.groupBy("ord").agg(F.sum("count").alias("drawn"))
    of = t.where("slots > 0").join(total, "ord", "left").select("ord", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    of = of.withColumn("over_from", F.coalesce(F.sum(over).over(w), F.lit(0))).withColumn("under", under).withColumn("under_from", F.coalesce(F.sum(under).over(w), F.lit(0)))
    c = prefix_sums(c, "ord", "_chunk", ["out_shard"], "count", "_from").drop("_chunk")
    # few rows, each of which becomes up to a shard's slots: dealt by the number of slots
    c = c.repartition(max(partitions(spark), -(-n // SLOTS_PER_TASK)), "out_shard", "ord").select("out_shard", "ord", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("count") - 1)).alias("i"))
    c = c.join(small(of.select("ord", "slots", "drawn", "over_from"), sources), "ord")
    # of drawn, slots stay: those where i * slots / drawn reaches another whole number
    at = F.floor(F.col("i").cast("decimal(20,0)") * F.col("slots").cast("decimal(18,0)") / F.col("drawn")).cast("long")
    c = c.withColumn("j", F.when(F.col("drawn") <= F.col("slots"), F.col("i")).otherwise(at))
    following = F.floor((F.col("i") + 1).cast("decimal(20,0)") * F.col("slots").cast("decimal(18,0)") / F.col("drawn")).cast("long")
    stays = (F.col("drawn") <= F.col("slots")) | (following > F.col("j"))
    kept = c.where(stays).select("out_shard", "ord", "j")
    # the rest in one line, over which the sources that lack draws are laid
    spare = c.where(~stays).select("out_shard", (F.col("over_from") + F.col("i") - F.col("j")).alias("e"))
    lack = of.where("under > 0").select("ord", F.col("drawn").alias("d"), F.col("under_from").alias("lo"), (F.col("under_from") + F.col("under")).alias("hi"))
    width = max(1, -(-n // max(1, sources)) // 64)
    lack = lack.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    moved = spare.withColumn("cell", F.floor(F.col("e") / width)).join(lack, "cell").where("e >= lo and e < hi")
    return kept.unionByName(moved.select("out_shard", "ord", (F.col("d") + F.col("e") - F.col("lo")).alias("j")))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, source, size, tie and any other columns) -> with ord (of the source), _chunk (of its documents), source_size, target and taken (long).

    Null sources form one source of their own, last in order. Documents of size 0 take 0 words. Rows that are equal in doc_id, size and tie are
    separate documents. No document takes more than CAP times its size; reruns agree, as order within a source derives
    from doc_id, size and tie only. An empty input gives no rows."""
    spark = docs.sparkSession
    t, sources, n = plan(docs, block)
    d = positions(docs, t, sources)
    drawn = draws(spark, t, sources, n, shard).join(small(t.select("ord", "blocks"), sources), "ord")
    # from an array of one, as the expression of a column that is merely named would be copied to wherever it is used
    key = (F.col("ord").cast("long") * 8 + F.floor(F.col("j") / F.col("blocks"))).alias("key")
    place = F.transform(F.array(F.struct((F.col("j") % F.col("blocks")).alias("at"), "blocks", key)), lambda x: permute(x["at"], x["blocks"], x["key"]))
    drawn = drawn.select("ord", F.get(place, F.lit(0)).alias("block"))
    drawn = drawn.groupBy("ord", "block").agg(F.count(F.lit(1)).alias("times"))
    cut = d.where("size > 0").select("ord", "_from", "size", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block))).alias("block"))
    cut = cut.withColumn("part", F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("_from"), F.col("block") * block))
    took = cut.join(drawn, ["ord", "block"]).groupBy("ord", "_from").agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    # where a document that isn't empty begins within its source identifies it
    out = d.join(took, ["ord", "_from"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return out.drop("_h", "_from")


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, tie (a digest of the text) and further columns; written, so that texts are read once."""
    return written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"), *more), "sizes")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row; see mix()."""
    d = measured(pick(docs, {"doc_id": "long", "text": "string", "source": "string"}))
    return mix(d).select("doc_id", "size", "source_size", "target", "taken", "source")


def repeated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source and further columns), each row taken / size times, rounded without bias; rows without words go. Only small columns are
    mixed; texts move once, to meet their counts. Rows that are equal in all columns are separate documents, whose counts add up.

    Remainders are carried along the documents of a chunk of the source in order of size, from a pseudorandom start: so many of them are rounded up
    as they add up to, and the words that a source hands on come near those that it draws."""
    d = docs.withColumn("_id", row_key(docs))
    along = Window.partitionBy("ord", "_chunk").orderBy("size", "_id", "taken")
    start = F.pmod(F.xxhash64("ord", "_chunk", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    m = mix(measured(d, "_id")).where("size > 0").withColumn("_rest", (F.col("taken") % F.col("size")) / F.col("size"))
    m = m.withColumn("_to", F.sum("_rest").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_before", F.coalesce(F.sum("_rest").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    copies = F.floor(F.col("taken") / F.col("size")) + F.floor(start + F.col("_to")) - F.floor(start + F.col("_before"))
    times = m.withColumn("_copies", copies).groupBy("_id").agg(F.sum("_copies").cast("int").alias("_times")).where("_times > 0")
    once = d.join(times, "_id").dropDuplicates(["_id"])
    return once.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def query(spark, sf_dir):
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def targets_query(spark, sf_dir):
    """The columns of op4 that SQL can express: all but the words that are drawn."""
    return query(spark, sf_dir).select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"))


TARGETS = r"""
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) - 1 ord from d group by source),
w as (select *, cast([5, 2, 1][1 + ord % 3] as double) weight, 3.0 * source_size cap from s),
f as (select 0 round, (select sum(source_size) from w) / (select sum(weight) from w) level
      union all
      select round + 1, (select (any_value(t.total) - coalesce(sum(cap) filter (cap < f.level * weight), 0)) / sum(weight) filter (cap >= f.level * weight) from w, (select sum(source_size) total from w) t)
      from f where round < 200 and exists (select 1 from w where cap < f.level * weight)),
l as (select max(level) level from f)
select doc_id, d.source, size, source_size, round(least(cap, level * weight), 6) target from d join w on d.source is not distinct from w.source cross join l
"""
