import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n=5):
    w = WORDS.findall(lower(t))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def clusters(texts):
    """doc_id -> smallest linked doc_id, over all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def documents(spark, rows):
    """rows of (doc_id, text, lang, source), with extra columns whose names clash with the operators' own."""
    rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 0.5, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, bits string, score double, size long")
