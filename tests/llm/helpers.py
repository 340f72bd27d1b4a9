"""Small fixtures and brute-force versions."""

import hashlib
import itertools
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k2 string, h int, value string, part int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use inside."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", 1, "v", 3) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=5, n=60):
    """(doc_id, text, lang, source): random texts, copies, edits, shared passages, nulls, empty and long ones, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgä") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = prose(rng, 45, words)
    rows = []
    for i in range(n):
        t = prose(rng, rng.randint(1, 160), words)
        if i % 7 == 3 and rows:
            w = (rng.choice(rows)[1] or "a b c d e f").split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        if i % 9 == 4:
            t = t + "\n" + line + " " + prose(rng, 3, words)
        if i % 11 == 5 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, t, rng.choice(["en", None]), f"s{i % 3}"))
    rows += [(n, None, None, None), (n + 1, "", "en", "s0"), (n + 2, " \t\n", None, ""), (n + 3, "A b", "en", "s0"), (n + 4, "a B", "en", "s0"),
             (n + 5, prose(rng, 6000, words), "en", "s0"), (n + 6, "ab " * 400, "en", "s0"), (n + 7, "ab " * 401, "en", "s1")]
    return rows + [rows[2], rows[2]]


def shingles(text, width, pattern):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(pattern, low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def components(rows, width, threshold):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t, width, r"[^\x20\x09-\x0D]+") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= threshold * len(a | b):
            parent[find(i)] = find(j)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(same, default=None)))
    return out


def removals(texts):
    """(n_bytes, n_removed, n_spans, sha256) of each text by the definition."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - 199):
            seen[d[p:p + 200]] = seen.get(d[p:p + 200], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if seen[d[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out
