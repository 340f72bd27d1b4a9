"""Whole results of the operators on evidence graphs, against plain versions of their definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import frame
from pyspark.sql import functions as F
from test_texts import naive_spans

from siltbed.llm import language_id, private_data


def plain_contexts(text):
    """(patterns, value, seed, start, end) of base spans and of the other tokens that look like identifiers."""
    base, found = naive_spans(text), []
    for _, a, b in base:
        found.append((text[a:b].lower(), True, a, b))
    for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9_./+@-]{4,}[A-Za-z0-9]", text):
        a, b = m.span()
        if len(re.findall("[0-9]", m[0])) >= 4 and not any(x < b and a < y for _, x, y in base):
            found.append((m[0].lower(), False, a, b))
    for value, seed, a, b in found:
        left, right = re.search(r"([^\W\d_]+)\W*$", text[:a]), re.match(r"\W*([^\W\d_]+)", text[b:])
        left, right = left and left[1].lower(), right and right[1].lower()
        some = [(left, None)] * bool(left) + [(None, right)] * bool(right) + [(left, right)] * bool(left and right)
        yield some, value, seed, a, b


def plain_found(texts):
    """Values that the bootstrapped patterns discover, and the rounds it took."""
    of, known = defaultdict(set), {}
    for t in texts:
        for some, v, seed, _, _ in plain_contexts(t):
            for p in some:
                of[p].add(v)
                if seed:
                    known[v] = 1.0
    seeds, rounds = set(known), 0
    while True:
        trust = {p: sum(known.get(v, 0) for v in vs) / (len(vs) + 1) for p, vs in of.items() if sum(v in known for v in vs) >= 5}
        doubt = defaultdict(lambda: 1.0)
        for p, x in trust.items():
            if x >= 0.8:
                for v in of[p] - set(known):
                    doubt[v] *= 1 - x
        if not doubt:
            return set(known) - seeds, rounds
        known |= {v: 1 - x for v, x in doubt.items()}
        rounds += 1


def test_private_spans_equal_brute_force(spark):
    rng = random.Random(4)
    make = [lambda: f"+1 555 01{rng.randint(0, 9)} {rng.randint(1000, 9999)}", lambda: f"u{rng.randint(0, 40)}@ex.org", lambda: f"10.0.{rng.randint(0, 300)}.7",
            lambda: f"ID-{rng.randint(1000, 1040)}-{rng.randint(10, 12)}", lambda: f"{rng.randint(10**5, 10**5 + 30)}x", lambda: "4111 1111 1111 1111"]
    words = ["call", "mail:", "host", "Ref", "é", "card_", "about", "x", "then"]
    rows = [(None, "call +1 555 010 1234", "en", "s"), (7000, None, None, None), (7001, "", "en", "s"), (7002, "7" * 3000 + " call 12-34-5678", "en", "s")]
    for k in range(220):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.choice([0, 0, 1, 2, 3, 4, 5])
            lead = {0: "call", 1: "mail:", 2: "host", 5: "card_"}.get(kind, rng.choice(words)) if rng.random() < 0.85 else rng.choice(words)
            parts += [lead, make[kind]()]
        rows.append((k, " ".join(parts), "en", "s"))
    rows += [rows[9], rows[9]]
    found, _ = plain_found([r[1] or "" for r in rows])
    want = []
    for i, t, *_ in rows:
        base = naive_spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        more = sorted({(a, b) for _, v, seed, a, b in plain_contexts(t or "") if not seed and v in found})
        counts = Counter(k for k, _, _ in base)
        want.append((i, *(counts[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(said.encode()).hexdigest(),
                     ",".join([said] * bool(said) + [f"id:{a}:{b}" for a, b in more])))
    got = private_data.find_spans(frame(spark, rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert found and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_found_identifiers_induce_patterns(spark):
    """A badge number is known by its context of a second round only: the words around it never stand around a seed."""
    rows = [(k, f"please dial +1 (555) 010-{k:04d} today", "en", "s") for k in range(1000, 1400)]
    rows += [(k, f"please dial 555-01-{k:04d}, my number", "en", "s") for k in range(2000, 2030)]
    rows += [(k, f"{'. ' * 40}{'w' * 70} 555-01-{k:04d}x {'! ' * 40}", "en", "s") for k in range(2000, 2030)]
    rows += [(k, f"her number 555-01-{k:04d} at work", "en", "s") for k in range(2000, 2030)] + [(5000, "her number 77-88-9911 at home", "en", "s"), (5001, "room 77-88-1111 is free", "en", "s")]
    found, rounds = plain_found([r[1] for r in rows])
    assert rounds >= 2 and "77-88-9911" in found and "77-88-1111" not in found
    got = {r.doc_id: r.spans for r in private_data.find_spans(frame(spark, rows)).collect()}
    assert got[5000] == "id:11:21" and got[5001] == ""
    assert private_data.left_word("x" * 90 + " " * 200, 290) == "x" * 90


def plain_grams(text):
    data = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in text.encode())
    letter = lambda b: 0x61 <= b <= 0x7A or b >= 0x80
    for k in range(len(data) - 2):
        g = data[k:k + 3]
        if all(letter(b) or b == 0x20 for b in g) and sum(map(letter, g)) >= 2:
            yield ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 & 0xFFFFFFFF) >> 18


def plain_languages(rows, labelled, folds, own, suffixes):
    """(doc_id, declared, language, posterior, n_grams, accepted) of (doc_id, text, declared, host, suffix); labelled are (id, text, tag)
    with a fold each."""
    clean = lambda s: (m := re.match("^([a-z]{2,3})([-_].*)?$", (s or "").strip().lower())) and m[1]
    declared, tags = [clean(r[2]) for r in rows], [clean(x[2]) for x in labelled]
    langs = sorted(x for x, n in Counter(filter(None, tags)).items() if n >= 5)
    distinct = {(i, t, tag, f) for (i, t, _), tag, f in zip(labelled, tags, folds["labelled"])}
    grams = [list(plain_grams(r[1] or "")) for r in rows]
    logs = {}
    for fold in (0, 1):
        for lang in langs:
            counts = Counter(g for _, t, tag, f in distinct if tag == lang and (not own or f != fold) for g in plain_grams(t or ""))
            total = sum(counts.values()) + 0.1 * (1 << 14)
            logs[fold, lang] = {g: math.log((counts[g] + 0.1) / total) for some in grams for g in some}
    texts = [[sum(logs[f, k][g] for g in some) * min(len(some), 60) / max(1, len(some)) for k in langs] for some, f in zip(grams, folds["rows"])]
    zero = lambda: [0.0] * len(langs)
    hosts, ends, whole, n_host, n_end, n_all = defaultdict(zero), defaultdict(zero), zero(), Counter(), Counter(), 0
    for r, some, ll in zip(rows, grams, texts):
        if len(some) >= 3:
            p = [math.exp(x - max(ll)) for x in ll]
            p = [x / sum(p) for x in p]
            n_host[r[3:5]] += 1
            n_end[r[4]] += 1
            n_all += 1
            hosts[r[3:5]] = [a + b for a, b in zip(hosts[r[3:5]], p)]
            ends[r[4]] = [a + b for a, b in zip(ends[r[4]], p)]
            whole = [a + b for a, b in zip(whole, p)]
    corpus = [(x + 1) / (n_all + len(langs)) for x in whole]
    want = []
    for r, said, some, ll in zip(rows, declared, grams, texts):
        above = [(x + 20 * c) / (n_end[r[4]] + 20) for x, c in zip(ends[r[4]], corpus)]
        seen = n_host[r[3:5]]
        prior = corpus if not seen else above if r[3] is None else [(x + 20 * a) / (seen + 20) for x, a in zip(hosts[r[3:5]], above)]
        factor = lambda tag, right, k: 0 if tag not in langs else math.log(right) if tag == k else math.log((1 - right) / (len(langs) - 1))
        s = [x + math.log(p) + factor(said, 0.9, k) + factor(suffixes.get(r[4]), 0.8, k) for x, p, k in zip(ll, prior, langs)]
        sure = 1 / sum(math.exp(x - max(s)) for x in s)
        fine = len(some) >= 3
        want.append((r[0], said, langs[s.index(max(s))] if fine else "und", sure if fine else 0.0, len(some), fine and sure >= 0.5))
    return langs, want


@pytest.mark.parametrize("own", [True, False])
def test_languages_equal_brute_force(spark, own):
    rng = random.Random(8)
    vocabulary = {"en": ["the", "other", "thing", "with", "there"], "de": ["und", "nicht", "auch", "ein", "über"], "fr": ["les", "avec", "être", "nous", "où"]}

    def make(n):
        lang = rng.choice(["en", "de", "fr"])
        mixed = vocabulary[lang] + (vocabulary[rng.choice(["en", "de", "fr"])] if rng.random() < 0.3 else [])
        return lang, " ".join(rng.choice(mixed) for _ in range(n))

    rows = []
    for k in range(150):
        lang, text = make(rng.choice([1, 2, 5, 30]))
        said = rng.choice([lang, lang, lang.upper() + "-xx", None, rng.choice(["en", "de", "fr"]), "zz", "?"])
        rows.append((k, text, said, rng.choice(["h1", "h2", "h3", None, ""]), rng.choice(["de", "fr", "com", None, "it"])))
    rows += [(900, None, "en", "h1", "de"), (901, "12 3", "de", None, None), (902, "the", "zz", "new", "fr"), rows[3], rows[3]]
    keyed = lambda some, names: spark.createDataFrame([(bytes(f"{x[0]}", "ascii"), *x) for x in some], names)
    frame_ = keyed(rows, "k2 binary, doc_id int, text string, declared string, host string, suffix string")
    labels = [(k, make(9)[1], rng.choice(["en", "de", "FR-x", None])) for k in range(60)]
    labelled = keyed(labels, "k2 binary, id int, text string, lang string")
    fold = lambda df: [r[0] for r in df.select(language_id.fold_of(F.col("k2"))).collect()]
    folds = {"rows": fold(frame_), "labelled": fold(frame_ if own else labelled)}
    langs, want = plain_languages(rows, [r[:3] for r in (rows if own else labels)], folds, own, language_id.SUFFIX_LANGUAGES)
    got = [tuple(x) for x in language_id.identify(frame_, None if own else labelled).drop("k2").collect()]
    assert len(langs) >= 3 and sorted((g[:3] + g[4:] for g in got), key=repr) == sorted((w[:3] + w[4:] for w in want), key=repr)
    assert all(abs(g[3] - w[3]) < 1e-3 for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)))


def test_the_sample_of_a_language_is_bounded_and_never_empty(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 8)
    docs = spark.range(3000).selectExpr("cast(cast(id % 1500 as string) as binary) k2", "cast(id as string) text", "if(id % 10 = 0, 'de', 'en') lang")
    copies = spark.range(2000).selectExpr("cast('same' as binary) k2", "'same' text", "'fr' lang")
    few = spark.range(6).selectExpr("cast(concat('f', id) as binary) k2", "'few' text", "'es' lang")
    rows = docs.union(copies).union(few)
    sizes = rows.groupBy("lang").count()
    got = {r.lang: r["count"] for r in language_id.sampled(rows, sizes).groupBy("lang").count().collect()}
    assert got["en"] == got["de"] == 8 and got["es"] == 6 and got.get("fr", 0) <= 1
    huge = spark.range(1).select(language_id.share(5_000_000_000).alias("s")).first().s
    assert 31 < huge * 5_000_000_000 < 33  # rows of five thousand million that are looked at
