"""Suffix dedup, Jaccard join and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import WORDS, clusters, documents, shingles

from proselens.llm import decontam, jaccard, suffixes


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def near_copies(seed=5):
    rng, rows = random.Random(seed), []
    for _ in range(25):
        base = words(rng, rng.choice([3, 8, 30, 80, 400])).split()
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 25) + 1)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(t).upper() if rng.random() < 0.2 else "  ".join(t))
    rng.shuffle(rows)
    return rows + [None, "", " \n\t", "one", "ONE", "a b c d e", "a  b c\td e", rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    texts = dict(enumerate(near_copies(seed)))
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(documents(spark, list(texts.items())).repartition(3)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == clusters(texts)
    assert all(r["n_shingles"] == len(shingles(texts[i])) for i, r in got.items())


def test_jaccard_chain_and_blocks(spark):
    """A chain of documents of which only neighbours are similar, so that stars around one centre don't link it."""
    rng = random.Random(3)
    w = words(rng, 300, 10**6).split()
    texts = {}
    for k in range(12):
        texts[k * 7 % 12] = " ".join(w)
        at = rng.randrange(0, 280)
        w[at : at + 18] = words(rng, 18, 10**6).split()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(documents(spark, list(texts.items()))).collect()}
    assert got == clusters(texts)


def test_jaccard_edges(spark):
    d = documents(spark, [(None, "same text here"), (None, "same text here"), (4, "same text here"), (4, "other"), (None, "alone in null"), (7, None)])
    rows = jaccard.near_duplicates(d).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=repr) == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (7, 7)], key=repr)
    assert jaccard.near_duplicates(d.limit(0)).count() == 0
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "alone in null"), (4, "other"), (4, "same text here"), (7, "")]


def test_jaccard_near_copies_without_doc_id(spark):
    """Near copies with null doc_id, among them the middle of a chain; ids beyond 2**53 next to them."""
    rng, big = random.Random(7), 2**53 + 1
    w = words(rng, 100, 10**6).split()
    chain = [" ".join(w[:k] + ["y"] * (k > 0) + w[k + 1 :]) for k in (0, 95)]
    end = " ".join(w[:80] + ["z", "z"] + w[82:95] + ["y"] + w[96:])
    other = words(rng, 100, 10**6)
    texts = [chain[0], chain[1], end, other, other + " more", words(rng, 60, 10**6)]
    sets = [shingles(t) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert like(0, 1) and like(1, 2) and like(3, 4)
    rows = [(big, texts[0]), (None, texts[1]), (big + 2, texts[2]), (None, texts[3]), (None, texts[4]), (0, texts[5])]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(big, big), (None, big), (big + 2, big), (None, None), (0, 0)}
    assert len(jaccard.one_of_each(documents(spark, rows)).collect()) == 3


def test_jaccard_tests_the_rest_where_the_nearest_are_known(spark, monkeypatch):
    """One star whose members fail against its centre but resemble each other, while the first pass offers nothing that is new."""
    rng = random.Random(3)
    w = words(rng, 300, 10**6).split()
    texts = {}
    for k in range(12):
        texts[k * 7 % 12] = " ".join(w)
        at = rng.randrange(0, 280)
        w[at : at + 18] = words(rng, 18, 10**6).split()
    apart, asked = jaccard.apart, []

    def offered(star, checked, root, sketch, every):
        asked.append(every)
        return apart(star, checked, root, sketch, every).where(f"{every}")

    monkeypatch.setattr(jaccard, "apart", offered)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(documents(spark, list(texts.items()))).collect()}
    assert asked == [False, True] and got == clusters(texts)


def test_pigeonhole_budget():
    """Similar sets share a signature, whatever their sizes; every set has the budget at some level."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 5, 9, 17, 60, 333, 2000]:
        for _ in range(30):
            s = np.unique(rng.integers(1, 2**62, n).astype(np.uint64))
            drop = rng.integers(0, len(s) // 5 + 1)
            t = s[drop:]
            if 5 * len(t) < 4 * len(s):
                continue
            level = {}
            for x in (s, t):
                for b in jaccard.bands_of(len(x)):
                    level[b] = max(level.get(b, 0), jaccard.short_of(x, b))
            common = [set(jaccard.signatures(s, b, level[b])[0]) & set(jaccard.signatures(t, b, level[b])[0]) for b in set(jaccard.bands_of(len(s))) & set(jaccard.bands_of(len(t)))]
            assert any(common)
            bits = [jaccard.parity(x) for x in (s, t)]
            assert jaccard.differing(*bits) <= drop
            assert jaccard.Sketches(bits).differing(0, np.array([1, 0])).tolist() == [jaccard.differing(*bits), 0]


def brute_removed(texts):
    raw = {i: (t or "").encode() for i, t in texts}
    n = suffixes.BYTES.window
    count = Counter(b[k : k + n] for b in raw.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeats(seed=1):
    rng = random.Random(seed)
    passage, line = words(rng, 200), words(rng, 90)
    rows = [words(rng, 30) + " " + passage[rng.randrange(300) :] + " é " + words(rng, 40) for _ in range(12)]
    rows += [words(rng, 100) + passage[: rng.randrange(380, 420)] for _ in range(8)]
    rows += [line + " x " + line, line[:399], line[:400], "a" * 1500, "ab" * 400, "a" * 700 + "b" + "a" * 399, rows[0], rows[0], None, "", "b" * 399, "b" * 400, words(rng, 3000) + passage]
    return list(enumerate(rows))


def brute_words(rows, n=50):
    w = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    count = Counter(tuple(x[k : k + n]) for x in w.values() for k in range(len(x) - n + 1))
    return {i: len({j for k in range(len(x) - n + 1) if count[tuple(x[k : k + n])] > 1 for j in range(k, k + n)}) for i, x in w.items()}


@pytest.mark.parametrize("group", [1, 3, 8192])
def test_suffixes(spark, group):
    rows = repeats(group % 7)
    rows += [(1000 + i, t.upper().replace(" ", "\t\n")) for i, t in rows[:3]]
    rng = random.Random(4)
    licence = words(rng, 52)  # of over 50 words, but not of 400 bytes
    rows += [(2000 + i, words(rng, rng.randrange(60)) + " " + licence + " " + words(rng, rng.randrange(60))) for i in range(12)]
    assert len(licence) < 400
    want, more = brute_removed(rows), brute_words(rows)
    got = suffixes.removed(documents(spark, rows).repartition(3), group).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert {r["doc_id"]: r["n_repeated_words"] for r in got} == more
    assert all(more[2000 + i] >= 52 for i in range(12))


def test_suffixes_long_text_and_empty(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    rng = random.Random(9)
    long = words(rng, 2500)
    rows = [(1, long), (2, words(rng, 100) + long[3000:6000]), (3, long[:900] + words(rng, 50))]
    got = suffixes.removed(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_removed(rows)
    assert suffixes.removed(documents(spark, rows).limit(0)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffixes.multikey_quicksort(w)
    assert (w[order] == np.array(sorted(map(tuple, w)), np.uint64)).all()
    rows = [bytes(rng.integers(97, 99, rng.integers(0, 20)).astype(np.uint8)) for _ in range(200)]
    m = suffixes.as_words(rows, 24)
    o = suffixes.multikey_quicksort(m)
    lcp = suffixes.common_prefixes(m, o)
    for k in range(1, len(rows)):
        a, b = (rows[o[j]].ljust(24, b"\0") for j in (k - 1, k))
        assert lcp[k] == next((i for i in range(24) if a[i] != b[i]), 24)


def test_wand_is_exact():
    rng = random.Random(4)
    index = decontam.Index([(i, words(rng, rng.choice([1, 4, 20, 70, 200]), 150)) for i in range(120)] + [(500, ""), (501, None)])
    for _ in range(60):
        p = words(rng, 60, 150).split() + rng.choice(index.words)
        terms = sorted({index.vocab[t] for t in p if t in index.vocab})
        score = Counter()
        for t in terms:
            for d, c in zip(index.docs[t], index.impact[t]):
                score[d] += c
        for threshold in (0.3, 0.5, 0.9):
            assert sorted(d for d, _ in index.search(terms, threshold)) == sorted(d for d, s in score.items() if s >= threshold - 1e-9)
        key = np.array(terms)
        if any(s >= decontam.THRESHOLD for s in score.values()):
            assert len(index.reach(np.zeros(len(key), np.int64), key)) == 1


def test_decontamination(spark):
    rng = random.Random(8)
    items = {i: words(rng, n, 5000) for i, n in enumerate([6, 15, 40, 60, 150])} | {9: None, 10: ""}
    text = lambda *p: " ".join(p)
    rows, want = [], set()
    for i, t in items.items():
        if t:
            rows.append((i, text(words(rng, 200, 5000), t.upper(), words(rng, 77, 5000))))
            rows.append((100 + i, text(words(rng, 59, 5000), t.replace(" ", "%%% "))))
            want |= {(i, i), (100 + i, i)}
    rows += [(300 + k, words(rng, 150, 5000)) for k in range(20)] + [(400, None), (401, ""), (0, text(items[0], items[0]))]
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = documents(spark, rows)
    got = decontam.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    clean = decontam.contaminated(d, b, keep=["doc_id", "text"])
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), b).count() == 0
    assert WORDS.findall("a b") == ["a", "b"]


def test_decontamination_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 2)
    rng = random.Random(8)
    items = [(i, words(rng, 30, 5000)) for i in range(7)]
    d = documents(spark, [(i, words(rng, 40, 5000) + " " + t) for i, t in items])
    got = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i, _ in items}


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, rng.choice([9, 30, 150]), 300)) for i in range(12)] + [(50, None), (51, "")]
    cut = [" ".join(w for w in t.split() if rng.random() > 0.15) for _, t in items[:12]]
    d, b = documents(spark, [(i, words(rng, 40, 300) + " " + t) for i, t in enumerate(cut)]), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: {(r["doc_id"], r["item_id"]): (round(r["score"], 9), r["question_overlap"], r["passage"]) for r in decontam.contaminated(d, b).collect()}
    whole = rows()
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 3)
    assert rows() == whole and len(whole) >= 6


def test_rows_that_differ_only_in_where_a_null_stands_stay(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", None, 5), (1, None, None, "en", 5), (1, None, "en", "", 5), (1, None, "en", None, 5), (2, "", None, None, None), (2, None, None, None, None)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(set(map(repr, rows)))
    texts = [(k, "w " * 20, "en" if k % 2 else None, None, 3) for k in range(4)]
    assert [r["doc_id"] for r in jaccard.one_of_each(spark.createDataFrame(texts, schema)).collect()] == [0]
