import numpy as np
import pyarrow as pa
import pytest
from helpers import components, corpus, frame, removals

from siltbed.llm import common, ngram_jaccard, suffix_dedup

ROWS = corpus()


@pytest.mark.parametrize("width,threshold,group,hot", [(4, 85, 256, 64), (5, 80, 2, 2), (5, 80, 2, 64), (3, 60, 3, 3)])
def test_components_equal_brute_force(spark, monkeypatch, width, threshold, group, hot):
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    monkeypatch.setattr(ngram_jaccard, "GROUP", group)
    monkeypatch.setattr(ngram_jaccard, "ONE", 2 * group if group > 3 else 3)
    got = ngram_jaccard.similar_groups(frame(spark, ROWS), width, threshold).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(components(ROWS, width, threshold), key=repr)


def test_frequent_shingles_are_counted_beyond_a_slice(monkeypatch):
    """A shingle that two texts of a slice have at most, but many of the table, must not choose candidates."""
    monkeypatch.setattr(common, "SLICE_BYTES", 400)
    texts = [" ".join([*(f"w{i}x{k}" for k in range(40)), "one very common line", f"end{i}"]) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    total = {}
    for out in ngram_jaccard.repeated_shingles(4, common.ASCII_SPACE)(iter([batch])):
        for h, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            total[h] = total.get(h, 0) + n
    data, offsets = common.utf8(pa.array(["one very common line"]))
    line = int(common.batch_shingles(data, offsets, 4, common.ASCII_SPACE)[0].view(np.int64)[0])
    assert total == {line: 100}


@pytest.mark.parametrize("room,found", [(10, 3), (2, 1), (0, 0)])
def test_the_list_of_frequent_shingles_has_room_for_the_most_frequent(spark, monkeypatch, room, found):
    monkeypatch.setattr(ngram_jaccard, "HEAVY", room)
    rows = [(i, f"a b c d x{i}" + " e f g h" * (i < 30) + f" z{i} i j k l" * (i < 30), "en", "s") for i in range(60)]
    assert len(ngram_jaccard.heavy_shingles(frame(spark, rows), 4, common.ASCII_SPACE)) == found


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", "en", "s"), (3, "a b c d e f", "en", "s"), (None, "g h i j k l", "en", "s")]
    got = ngram_jaccard.similar_groups(frame(spark, rows), 4, 85).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == [(3, 3), (None, 3), (None, None)]
    assert ngram_jaccard.similar_groups(frame(spark, ROWS).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = sorted(r.doc_id for r in ngram_jaccard.keep_one(frame(spark, ROWS)).select("doc_id").collect())
    assert kept == sorted({c if n else i for i, n, c in components(ROWS, 5, 80)})


def test_components_without_an_id_of_their_own_stay(spark):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x", "a b c d e f"]
    rows = [(i, t, "en", "s") for i, t in zip([None, None, 7, 7, None], texts)]
    assert sorted(r.text for r in ngram_jaccard.keep_one(frame(spark, rows)).collect()) == sorted(set(texts))


def test_halved_bitmaps_cover_the_members():
    rng = np.random.default_rng(1)
    u = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    bits = ngram_jaccard.token_bits(u)
    assert len(ngram_jaccard.halved(bits)) * 2 == len(bits)
    assert np.unpackbits(ngram_jaccard.halved(bits)).sum() <= np.unpackbits(bits).sum() <= len(u)


@pytest.mark.parametrize("hot", [2000, 2])
def test_removals_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = suffix_dedup.repeated_spans(frame(spark, ROWS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(r[0], *x) for r, x in zip(ROWS, removals([r[1] for r in ROWS]))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_removals_of_no_rows(spark):
    assert suffix_dedup.repeated_spans(frame(spark, ROWS).limit(0)).count() == 0


def test_loser_tree_merges_with_prefixes():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(200)]
    runs = [suffix_dedup.front_coded([(w, b"", 0, k, 0, 0, 0) for k, w in enumerate(words[i::5])]) for i in range(5)]
    merged = list(suffix_dedup.merge_runs(runs))
    assert [e[0] for e, _ in merged] == sorted(words)
    for (a, _), (b, lcp) in zip(merged, merged[1:]):
        assert lcp == suffix_dedup.common_prefix(a[0], b[0], 0)


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, 7), (7, 200), (5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, **{k: 7 for k in (7, 100, 200)}}
