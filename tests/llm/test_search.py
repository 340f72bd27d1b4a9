import re

import numpy as np
import pytest
from compare import mismatch
from helpers import corpus, frame, shingles
from pyspark.sql import functions as F

from siltbed.llm import containment, exact_topk, ngram_jaccard
from siltbed.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_sql_twins(spark):
    for name in ORACLES:
        assert mismatch(spark, SF, QUERIES[name], ORACLES[name]) == ""


WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def held_items(rows, items):
    """(doc_id, item_id, shared, n_item) by the definition; an item below five words is one shingle of its own width."""
    want = []
    for doc, text, *_ in rows:
        d = re.findall(WORD, (text or "").lower())
        for item, t in items:
            w = re.findall(WORD, (t or "").lower())
            width = min(5, len(w))
            s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if w else set()
            both = s & {tuple(d[k:k + width]) for k in range(len(d) - width + 1)}
            if s and 100 * len(both) >= 80 * len(s):
                want.append((doc, item, len(both), len(s)))
    return sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [40, 2_000_000])
def test_containment_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(containment, "CHUNK", chunk)
    rows = corpus()
    items = [(k, " ".join((rows[k][1] or "").split()[2:22])) for k in range(0, 50, 3)] + [(90, None), (91, ""), (92, "one two"), (None, "ab ab ab ab ab ab"), (93, "Ab"), (94, "ab  ab! ab")]
    items += [items[2], items[2], (95, items[4][1]), (96, " ".join((rows[65][1] or "").split()[:3000])), (97, " ".join((rows[10][1] or "x").split()[:4]))]
    frame_ = lambda some: spark.createDataFrame([(*x, 3, "n") for x in some], "item_id long, text string, size int, words string")
    got = containment.contained_items(frame(spark, rows), frame_(items)).drop("k2").collect()
    assert sorted(map(tuple, got), key=repr) == held_items(rows, items)
    assert containment.contained_items(frame(spark, rows), frame_([])).count() == 0
    assert containment.decontaminate(frame(spark, rows).limit(0), frame_(items)).count() == 0
    bad = {r[0] for r in held_items(rows, [x for x in items if len(re.findall(WORD, (x[1] or "").lower())) >= 5])}
    assert {r.doc_id for r in containment.decontaminate(frame(spark, rows), frame_(items)).collect()} == {r[0] for r in rows} - bad


def thue_morse(flip):
    return "".join("ab"[i.bit_count() % 2 ^ flip] for i in range(2048))


def test_long_words_that_are_alike_are_different(spark):
    """Prefix sums modulo 2^64 give both words one hash."""
    a, b = thue_morse(0), thue_morse(1)
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, f"{a} p q r {b} p q r", "en", "s"), (4, f"{b} x y z w", "en", "s")]
    got = ngram_jaccard.similar_groups(frame(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 5, 3), (4, 2, 4)]
    items = [(7, f"{a} x y z w"), (8, a)]
    found = containment.contained_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("k2")
    assert sorted(map(tuple, found.collect())) == [(1, 8, 1, 1), (3, 8, 1, 1)]
    assert containment.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).count() == 4


def test_a_hash_is_no_proof():
    """Items are verified on their words: with one hash for all words nothing else is found."""
    index = containment.SketchIndex([(b"a b c d e", 5, np.array([7], np.uint64).tobytes())], 80)
    one = np.array([7], np.uint64), np.array([0, 2]), np.array([0, 1])
    assert index.held(0, 5, one, lambda p: b"v w x y z") is None
    assert index.held(0, 5, one, lambda p: [b"v w x y z", b"a b c d e"][p]) == (1, 1)


def test_chunks_hold_what_fits():
    assert containment.chunks_of([(3, 10), (1, 5), (2, 6), (5, 25), (6, 1)], 12) == [[(1, 1, 0), (2, 1, 0)], [(3, 1, 0)], [(5, 3, 0)], [(5, 3, 1)], [(5, 3, 2)], [(6, 1, 0)]]


def test_topk_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 7)
    monkeypatch.setattr(exact_topk, "GROUP", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist(), 0, "x") for i in range(60)]
    rows += [(60, None, 0, "x"), (61, [1.0, None], 0, "x"), (62, [float("nan")], 0, "x"), (63, [float("inf")], 0, "x"), (64, [], 0, "x"), (65, [2.0], 0, "x"), (None, [1.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, b int, g string")
    got = sorted(map(tuple, exact_topk.search(df, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows[:60]] + [(64, []), (65, [512])]
    want = []
    for q, w in fine:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in fine if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert exact_topk.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
