"""Suffix-array dedup: symbols covered by strings of WINDOW symbols that start anywhere else are removed.

Symbols are bytes or words. A full suffix array of all positions would be hundreds of times the input when it is dealt out, as each suffix has to
carry its window. So the array is sparse: each window is owned by one of the positions in it that its content chooses (the
least hash of a few symbols among the first window - core + 1 positions, leftmost on ties), its anchor. Equal windows have anchors at
equal offsets, so only suffixes at anchors need to meet. An anchor's block is the text that its windows span.

1. Texts are cut into blocks; only hashes travel: of the core symbols from the anchor, which all its windows hold, and of the whole block. Equal
   blocks are one: their windows all repeat. A task settles those that it meets twice and sends on one of them, so that a block that stands in every
   document is a row for each task's flush. Blocks whose core no different block has are settled too (least and greatest hash of a core's blocks, combined before the shuffle).
2. What is left - at the edges of repeated passages - is fetched: suffixes at anchors with the text to their left. Sampled splitters
   range-partition them by their leading symbols. Within a bucket, a multikey quicksort on 8-byte words sorts the suffixes, and
   another the reversed texts to the left; lengths of common prefixes between neighbours give the classes of suffixes that agree on a depth. A window
   repeats if another window at the same offset has the same class on both sides. Splitters never part equal cores, nor do the chunks that are
   sorted at a time, so that across either border common prefixes are shorter than a core.
3. Cores with more than GROUP different blocks are parted before that: windows at offsets a to b hold the a symbols left of the anchor and
   window - b right of it, so their blocks meet others that agree on these only. Halving the range of offsets goes on until a group has no more than
   GROUP blocks, or one offset, where agreeing is being equal.

Exact copies are settled by their whole text beforehand, and a task hands on one of them only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, bloom, bloom_has, discard, mix, partitions, pick, prefix_hash, prefix_sums, slices, span_hash, utf8, word_hashes, word_spans, written


@dataclass(frozen=True)
class Unit:
    """How texts become symbols: width in bytes, symbols in a window and in its core, symbols hashed to choose anchors."""

    width: int
    window: int
    core: int
    seed: int

    @property
    def most(self) -> int:
        return self.window - self.core


BYTES = Unit(1, 400, 200, 16)
WORDS = Unit(4, 50, 25, 3)
GROUP = 8192           # different blocks that are sorted as one group
PIECE = 1 << 19        # bytes of text handled at a time
CHUNK = 4096           # blocks sorted at a time, about
FLUSH = 500_000        # blocks kept before a task writes them out


# ---------------------------------------------------------------- symbols

def symbols(column, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets of texts, prefix hashes): bytes, or 32 bits of the hash of each word in lower case."""
    data, off = utf8(column)
    if unit.width == 1:
        return data, off, prefix_hash(data)
    start, end, first = word_spans(data, off)
    h = word_hashes(data, start, end) >> np.uint64(32)
    return h.astype(np.uint32), first.astype(np.int64), prefix_sums(mix(h + M1))


def n_symbols(text: np.ndarray, unit: Unit) -> int:
    return len(text) if unit.width == 1 else len(word_spans(text, np.array([0, len(text)]))[0])


def text_key(text: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(text.data, digest_size=8).digest(), "little", signed=True)


# ---------------------------------------------------------------- anchors

def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, m = 1, x
    while 2 * n <= w:
        m = np.minimum(m[: len(m) - n], m[n:])
        n *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - n : w - n + len(x) - w + 1]) if w > n else m[: len(x) - w + 1]


def blocks(c: np.ndarray, offsets: np.ndarray, unit: Unit):
    """Arrays (row, anchor, first window, last window, core hash, block hash) of all blocks of the texts with prefix hashes c; positions count within the row's text."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    size = len(c) - 1
    if size < unit.window:
        return empty
    at = np.arange(size - unit.seed + 1)
    value = (span_hash(c, at, at + unit.seed) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    least = (sliding_min(value[: size - unit.core + 1], unit.most + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = np.flatnonzero(row[: len(least)] == row[unit.window - 1 : unit.window - 1 + len(least)])
    if not len(ok):
        return empty
    a, r = least[ok], row[ok]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    last = np.r_[first[1:], len(ok)] - 1
    lo, hi, a, r = ok[first], ok[last], a[first], r[first]
    h1 = span_hash(c, a, a + unit.core)
    h2 = span_hash(c, lo, hi + unit.window) ^ mix((a - lo).astype(np.uint64) * M1)
    base = offsets[r]
    return r, a - base, lo - base, hi - base, h1, h2


def pieces(batch, unit: Unit):
    """(prefix hashes, offsets, where the piece starts) of a batch's texts; a long text's pieces are such that each window lies in exactly one."""
    data, off, c = symbols(batch.column("text"), unit)
    if len(off) > 2 or len(data) <= 2 * PIECE:
        yield c, off, 0
        return
    for x in range(0, len(data) - unit.window + 1, PIECE):
        part = data[x : x + PIECE + unit.window - 1]
        yield (prefix_hash(part) if unit.width == 1 else prefix_sums(mix(part.astype(np.uint64) + M1))), np.array([0, len(part)]), x


def texts(batches):
    """(batch, data, offsets, keys, fresh): fresh tells the texts that did not come before in this task."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, PIECE):
        data, off = utf8(batch.column("text"))
        keys = [text_key(data[off[i] : off[i + 1]]) for i in range(batch.num_rows)]
        fresh = []
        for k, n in zip(keys, np.diff(off)):
            fresh.append((k, int(n)) not in seen)
            seen.add((k, int(n)))
        yield batch, data, off, keys, fresh


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, k and n (key and bytes of the text), its words, its sha256."""
    def run(batches):
        for batch in slices(batches):
            data, off = utf8(batch.column("text"))
            parts = [data[off[i] : off[i + 1]] for i in range(batch.num_rows)]
            _, _, first = word_spans(data, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_key(p) for p in parts], pa.int64()), pa.array(np.diff(off)), pa.array(np.diff(first).astype(np.int64)),
                                              pa.array([hashlib.sha256(p.data).hexdigest() for p in parts])], ["doc_id", "k", "n", "words", "sha"])

    return docs.mapInArrow(run, "doc_id long, k long, n long, words long, sha string")


# h1, h2: hashes of core and block; a: anchor; lo, hi: from it back to the first window, and on to the last; m: how often, 2 for more than once, 0 where it is settled
PACK = np.dtype([("h1", "u8"), ("h2", "u8"), ("a", "i8"), ("lo", "i4"), ("hi", "i4"), ("m", "i4")])


def anchored(docs: DataFrame, buckets: int, unit: Unit) -> DataFrame:
    """Packed blocks by bucket of the block's hash: bucket, packed (PACK), owners (k, n of each text), runs (blocks of each owner)."""
    def run(batches):
        held, size, turn = [], 0, 0

        def flush():
            arr = np.concatenate([x[0] for x in held])
            own = np.repeat(np.array([x[1:] for x in held], np.int64), [len(x[0]) for x in held], axis=0)
            _, inv, times = np.unique(arr["h2"] ^ mix(arr["h1"]), return_inverse=True, return_counts=True)
            again = times[inv] > 1
            whose = np.zeros(len(times), np.int64)
            whose[inv] = np.arange(len(arr))
            one = np.flatnonzero(times > 1)
            arr["m"] = np.where(again, 0, 1)
            more = arr[whose[one]].copy()  # one of each stands for all
            more["m"] = 2
            b = ((mix(arr["h2"]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            b[again] = (turn + np.arange(again.sum()) * buckets // max(1, again.sum())) % buckets  # what is settled goes anywhere, evenly
            arr, own = np.concatenate([arr, more]), np.concatenate([own, own[whose[one]]])
            b = np.r_[b, ((mix(more["h2"]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)]
            order = np.argsort(b, kind="stable")
            arr, own, b = arr[order], own[order], b[order]
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            rows = []
            for x, y in zip(cut, np.r_[cut[1:], len(b)]):
                o = own[x:y]
                f = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]).any(1)])
                rows.append((int(b[x]), arr[x:y].tobytes(), o[f].tobytes(), np.diff(np.r_[f, len(o)]).astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "packed", "owners", "runs"])

        for batch, _, off, keys, fresh in texts(batches):
            for c, poff, start in pieces(batch, unit):
                r, a, lo, hi, h1, h2 = blocks(c, poff, unit)
                arr = np.empty(len(r), PACK)
                arr["h1"], arr["h2"], arr["a"], arr["lo"], arr["hi"] = h1, h2, a + start, a - lo, hi - a
                edge = np.searchsorted(r, np.arange(batch.num_rows + 1))
                for i in range(batch.num_rows):
                    if fresh[i] and edge[i] < edge[i + 1]:
                        held.append((arr[edge[i] : edge[i + 1]], keys[i], int(off[i + 1] - off[i])))
                        size += edge[i + 1] - edge[i]
                if size > FLUSH:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, packed binary, owners binary, runs binary")


DECISION = "k long, n long, kind int, a long, lo int, hi int, h1 long, h2 long"  # kind 0: all windows of the block repeat; 1: compare; 3: as 1, only for others to compare with


def decided(packed: DataFrame) -> DataFrame:
    """Of blocks that occur more than once, all (kind 0) and one of each (kind 3); and the others (kind 1)."""
    def run(key, pdf):
        arr = np.concatenate([np.frombuffer(x, PACK) for x in pdf["packed"]])
        own = np.concatenate([np.repeat(np.frombuffer(o, np.int64).reshape(-1, 2), np.frombuffer(r, np.uint32), axis=0) for o, r in zip(pdf["owners"], pdf["runs"])])
        order = np.lexsort((arr["m"] == 0, arr["h1"], arr["h2"]))
        arr, own = arr[order], own[order]
        settled = arr["m"] == 0
        new = np.r_[True, (arr["h1"][1:] != arr["h1"][:-1]) | (arr["h2"][1:] != arr["h2"][:-1]) | (settled[1:] != settled[:-1])]
        g = np.cumsum(new) - 1
        times = np.bincount(g, weights=arr["m"])[g]
        twice = settled | (times > 1)
        out = [np.flatnonzero(twice & (arr["m"] < 2)), np.flatnonzero(new & ~settled)]
        at, kind = np.concatenate(out), np.concatenate([np.zeros(len(out[0]), int), np.where(twice[out[1]], 3, 1)])
        return pd.DataFrame({"k": own[at, 0], "n": own[at, 1], "kind": kind, "a": arr["a"][at], "lo": arr["lo"][at], "hi": arr["hi"][at], "h1": arr["h1"][at].astype(np.int64), "h2": arr["h2"][at].astype(np.int64)})

    return packed.groupBy("bucket").applyInPandas(run, DECISION)


def asked(dec: DataFrame) -> DataFrame:
    """The blocks whose core a different block has, where not all of these are settled."""
    u = dec.where("kind > 0")
    cores = u.groupBy("h1").agg(F.min("h2").alias("x"), F.max("h2").alias("y"), F.min("kind").alias("open")).where("x <> y and open = 1").select("h1")
    return u.join(cores, "h1", "left_semi").drop("h2")


# ---------------------------------------------------------------- sorting suffixes

def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of words. Each round, every unsorted group splits into the rows whose current word is below, equal to or
    above that of its middle row; equal ones go on to the next word. All groups split at once."""
    n, width = words.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)      # groups in order
    depth = np.zeros(1, np.int64)      # of each group
    while True:
        size = np.bincount(group, minlength=len(depth))
        active = (size > 1) & (depth < width)
        if not active.any():
            return order
        first = np.cumsum(size) - size
        rows = np.flatnonzero(active[group])
        g = group[rows]
        word = words[order[rows], depth[g]]
        pivot = words[order[first + size // 2 - (size == 0)], np.minimum(depth, width - 1)]
        side = np.where(word < pivot[g], 0, np.where(word == pivot[g], 1, 2))
        by = np.argsort(g * 3 + side, kind="stable")
        order[rows] = order[rows[by]]
        key = group * 3 + 1
        key[rows] = (g * 3 + side)[by]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(fresh) - 1
        old = key[fresh]
        depth = depth[old // 3] + np.where(active[old // 3] & (old % 3 == 1), 1, 0)


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it in order; -1 for the first."""
    a, b = words[order[:-1]], words[order[1:]]
    differ = a != b
    at = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    x = np.zeros(len(at), np.uint64)
    some = at < words.shape[1]
    x[some] = a[some, at[some]] ^ b[some, at[some]]
    extra = np.zeros(len(at), np.int64)
    for k in range(1, 8):
        extra += (x >> np.uint64(64 - 8 * k)) == 0
    return np.r_[-1, at * 8 + np.where(some, extra, 0)]


def as_words(rows: list[bytes], width: int) -> np.ndarray:
    buf = b"".join(r[:width].ljust(width, b"\0") for r in rows)
    return np.frombuffer(buf, ">u8").reshape(len(rows), width // 8).astype(np.uint64)


def repeated(left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, unit: Unit = BYTES) -> np.ndarray:
    """(block, offset) matrix: the window that starts offset symbols before the block's anchor repeats. left: reversed symbols before the anchor; right: those
    from it, big-endian. Offsets -hi..lo belong to a block, hi <= 0 counting windows that start at the anchor as offset 0."""
    n, most = len(left), unit.most
    out = np.zeros((n, most + 1), bool)
    sides = []
    for rows, width in ((left, most * unit.width), (right, unit.window * unit.width)):
        w = as_words(rows, -(-width // 8) * 8)
        order = multikey_quicksort(w)
        sides.append((order, common_prefixes(w, order)))
    cls = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(most + 1):
        own = np.flatnonzero((lo >= r) & (-hi <= r))
        if len(own) < 2:
            continue
        for c, (order, lcp), depth in zip(cls, sides, (r, unit.window - r)):
            c[order] = np.cumsum(lcp < depth * unit.width)
        key = cls[0][own] * (n + 1) + cls[1][own]
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        out[own, r] = count[inv] > 1
    return out


def wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """k, n, text of docs' texts whose k is among ids (id), and few others: those that a filter of fixed size lets pass. In a task each text once."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids))

    def run(batches):
        for batch, data, off, keys, fresh in texts(batches):
            k = np.array(keys, np.int64)
            ok = np.array(fresh) & bloom_has(sent.value, k)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.diff(off)), batch.column("text").cast(pa.string())], ["k", "n", "text"]).filter(pa.array(ok))

    return docs.mapInArrow(run, "k long, n long, text string")


BLOCK_ROWS = "lead binary, h1 long, k long, n long, a long, lo int, hi int, kind int, left binary, right binary"


def fetched(docs: DataFrame, ask: DataFrame, unit: Unit) -> DataFrame:
    """The blocks asked for, with their symbols. Texts meet the list of their own blocks, which is no longer than they are."""
    lists = ask.groupBy("k", "n").agg(F.collect_list(F.struct("a", "lo", "hi", "h1", "kind")).alias("blocks"))
    both = wanted(docs, ask.select(F.col("k").alias("id"))).join(lists, ["k", "n"])

    def run(batches):
        done = set()
        for batch in slices(batches, PIECE):
            data, off, _ = symbols(batch.column("text"), unit)
            raw = data if unit.width == 1 else data.astype(">u4")
            rows = []
            for i, (k, n, bl) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "n", "blocks")))):
                if (k, n) in done:  # another task's copy of the same text
                    continue
                done.add((k, n))
                for b in bl:
                    a, lo, hi = off[i] + b["a"], b["lo"], b["hi"]
                    left = raw[a - lo : a][::-1].tobytes()
                    right = raw[a : a + hi + unit.window].tobytes()
                    rows.append((right[:16], b["h1"], k, n, b["a"], lo, hi, b["kind"], left, right))
            if rows:
                types = [pa.binary()] + [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in BLOCK_ROWS.split(", ")])

    return both.select("k", "n", "text", "blocks").mapInArrow(run, BLOCK_ROWS)


SPANS = "k long, n long, start long, stop long"


def runs_of(flags: np.ndarray, a: np.ndarray, k, n, unit: Unit):
    """Ranges of symbols covered by the flagged windows (block, offset)."""
    f = flags[:, ::-1].astype(np.int8)  # by rising start
    d = np.diff(np.pad(f, ((0, 0), (1, 1))), axis=1)
    i, s = np.nonzero(d == 1)
    _, e = np.nonzero(d == -1)
    most = flags.shape[1] - 1
    return pd.DataFrame({"k": k[i], "n": n[i], "start": a[i] - most + s, "stop": a[i] - most + e - 1 + unit.window})


def parted(rows: DataFrame, unit: Unit, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows whose groups - column h1 - have at most group rows, spans of windows that are equal as their groups have one offset).

    A row is in a group for a range of offsets (columns from, to). A group that is too large is parted in two halves of the range, whose rows agree on more."""
    names = [c.split()[0] for c in BLOCK_ROWS.split(", ")]
    rows = rows.select(*names, F.lit(0).alias("from"), F.lit(unit.most).alias("to"))
    small, spans = None, []
    while True:
        large = written(rows.groupBy("h1").count().where(F.col("count") > group).select("h1"), "large")
        if large.isEmpty():
            return (rows if small is None else small.unionByName(rows)), spans
        fits = rows.join(large, "h1", "left_anti")
        small = fits if small is None else small.unionByName(fits)

        def halves(batches):
            for batch in batches:
                out = []
                for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                    lead, _, k, n, a, lo, hi, kind, left, right, x, y = row
                    mid = (x + y) // 2
                    for s, e in ((x, mid), (mid + 1, y)):
                        if lo >= s and -hi <= e:  # the block owns windows at these offsets
                            s_, e_ = max(s, -hi), min(e, lo)
                            agree = b"%d %d %d " % (s, e, row[1]) + left[: s * unit.width] + b" " + right[: (unit.window - e) * unit.width]
                            if s_ <= e_:
                                digest = hashlib.blake2b(agree, digest_size=24).digest()
                                out.append((lead, int.from_bytes(digest[:8], "little", signed=True), k, n, a, lo, hi, kind, left, right, s, e, digest[8:]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), [*batch.schema, pa.field("digest", pa.binary())])], [*batch.schema.names, "digest"])

        schema = BLOCK_ROWS + ", `from` int, `to` int"
        both = written(rows.join(large, "h1", "left_semi").select(*names, "from", "to").mapInArrow(halves, schema + ", digest binary"), "halves", "lz4")
        equal = both.where("`from` = `to`").groupBy("h1", "digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "digest")
        one = both.where("`from` = `to` and kind < 3").join(equal, ["h1", "digest"], "left_semi")
        spans.append(one.select("k", "n", (F.col("a") - F.col("from")).alias("start"), (F.col("a") - F.col("from") + unit.window).alias("stop")))
        rows = both.where("`from` < `to`").drop("digest")


def compared(rows: DataFrame, buckets: int, unit: Unit) -> DataFrame:
    """Ranges of repeated windows among blocks. Splitters are sampled from the leading symbols; equal groups, which have equal leading symbols, never part."""
    dealt = rows.repartitionByRange(buckets, "lead", "h1").sortWithinPartitions("lead", "h1")

    def solve(t: pa.Table):
        k, n, a, lo, hi, kind, x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("k", "n", "a", "lo", "hi", "kind", "from", "to"))
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        flags = repeated(left, right, np.minimum(lo, y), np.minimum(hi, -x), unit)
        flags[kind >= 3] = False
        return pa.RecordBatch.from_pandas(runs_of(flags, a, k, n, unit), preserve_index=False)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h1").to_numpy()
                cut = np.flatnonzero(h[1:] != h[:-1]) + 1
                if len(cut):  # whole groups only; the last one may go on
                    yield solve(t.slice(0, cut[-1]))
                    t = t.slice(cut[-1])
                held, size = t.combine_chunks().to_batches(), t.num_rows
        if size:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, SPANS)


# ---------------------------------------------------------------- the operator

def repeats(docs: DataFrame, unit: Unit, group: int = GROUP) -> DataFrame:
    """k, n, spans of every text that is no exact copy of another and holds windows that start elsewhere too: ranges (start, stop) of symbols, which may overlap."""
    buckets = partitions(docs.sparkSession)
    dec = written(decided(anchored(docs, buckets, unit)), "blocks")
    ask = written(asked(dec), "asked")
    rows = written(fetched(docs, ask, unit), "suffixes", "lz4")
    sizes, spans = parted(rows, unit, group)
    found = compared(sizes, buckets, unit)
    for s in spans:
        found = found.union(s)
    found = found.union(dec.where("kind = 0").select("k", "n", (F.col("a") - F.col("lo")).alias("start"), (F.col("a") + F.col("hi") + unit.window).alias("stop")))
    # ranges of a text are no more than its blocks and windows
    out = written(found.groupBy("k", "n").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    for used in (dec, ask, rows):
        discard(used)
    return out


def covered(spans: DataFrame, copies: DataFrame) -> DataFrame:
    """k, n, symbols that the spans cover, of texts that are no copies."""
    def run(batches):
        for batch in batches:
            out = []
            for sp in batch.column("spans").to_pylist():
                total, end = 0, 0
                for s, e in sorted((x["start"], x["stop"]) for x in sp):
                    total += max(0, e - max(s, end))
                    end = max(end, e)
                out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array(out, pa.int64())], ["k", "n", "covered"])

    return spans.join(copies, ["k", "n"], "left_anti").mapInArrow(run, "k long, n long, covered long")


def removed(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words of every row of docs (doc_id, text).

    n_removed counts bytes in strings of 400 bytes that start elsewhere too; n_repeated_words counts words, whatever their case and the space between them, in strings of 50
    words that do. Null text counts as empty. Texts shorter than a window lose nothing; texts that have an exact copy and are not shorter lose
    everything. Rows may repeat a doc_id. Extra columns are ignored."""
    d = pick(docs, {"doc_id": "long", "text": "string"})
    meta = written(metadata(d), "texts")
    copies = meta.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c"), F.max("words").alias("words")).where("c > 1").drop("c")
    keys = copies.select("k", "n")
    lists = repeats(d, BYTES, group).join(keys, ["k", "n"], "left_anti")

    def cut(batches):
        for batch in slices(batches, PIECE):
            data, off = utf8(batch.column("text"))
            out = []
            for i, sp in enumerate(batch.column("spans").to_pylist()):
                n = int(off[i + 1] - off[i])
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, [s["start"] for s in sp], 1)
                np.add.at(edge, [s["stop"] for s in sp], -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((int(gone.sum()), int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()), hashlib.sha256(data[off[i] : off[i + 1]][~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))], ["k", "n", "n_removed", "n_spans", "kept"])

    both = wanted(d, lists.select(F.col("k").alias("id"))).join(lists, ["k", "n"]).select("k", "n", "text", "spans")
    done = written(both.mapInArrow(cut, "k long, n long, n_removed long, n_spans long, kept string").dropDuplicates(["k", "n"]), "cut")
    empty = hashlib.sha256(b"").hexdigest()
    all_ = copies.where(F.col("n") >= BYTES.window).select("k", "n", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept"))
    words = covered(repeats(d, WORDS, group), keys).union(copies.where(F.col("words") >= WORDS.window).select("k", "n", F.col("words").alias("covered")))
    out = meta.join(done.union(all_), ["k", "n"], "left").join(words, ["k", "n"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("doc_id", F.col("n").alias("n_bytes"), zero("n_removed").alias("n_removed"), zero("n_spans").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), zero("covered").alias("n_repeated_words"))


def query(spark, sf_dir):
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) h, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
bw as (select doc_id, i, md5(substr(h, cast(2 * i + 1 as bigint), 800)) k from (select doc_id, h, unnest(range(len(h) // 2 - 399)) i from t where len(h) >= 800)),
bs as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 400 then 1 else 0 end cut from (select *, count(*) over (partition by k) c from bw) where c > 1),
sp as (select doc_id, min(i) s, max(i) + 400 e from (select doc_id, i, sum(cut) over (partition by doc_id order by i) g from bs) group by doc_id, g),
gap as (select doc_id, s, coalesce(lag(e) over (partition by doc_id order by s), 0) before, e from sp),
cut as (select doc_id, sum(e - s) n_removed, count(*) n_spans, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (s - before) as bigint)), '' order by s) || substr(any_value(h), cast(2 * max(e) + 1 as bigint)) kept from gap join t using (doc_id) group by doc_id),
ww as (select doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) k from (select doc_id, ws, unnest(range(len(ws) - 49)) i from t where len(ws) >= 50)),
wi as (select doc_id, i, lead(i) over (partition by doc_id order by i) following from (select *, count(*) over (partition by k) c from ww) where c > 1),
wr as (select doc_id, sum(least(50, coalesce(following - i, 50))) n from wi group by doc_id)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256, cast(coalesce(n, 0) as bigint) n_repeated_words
from t left join cut using (doc_id) left join wr using (doc_id)
"""
