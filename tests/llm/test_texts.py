import base64
import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from helpers import corpus, frame

from siltbed.llm import html_text, language_id, piece_sampling, private_data, quality_rules, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    inner = warc.record_bytes(7, "http://in", b"inner", None, warc.digest(b"inner"))
    html = ["<p>a</p>" * 30, None, "", "<p>a</p>" * 30, "é" * 3000, "<p>a</p>" * 30, inner.decode("latin-1")]
    rows = [(k, None if k == 2 else f"http://h/{k} \n", h, 5, "z") for k, h in enumerate(html)] + [(None, "u", "", 1, "z"), (4, "http://h/4", "é" * 3000, 2, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int, sha string")
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=2000), split_bytes=300).collect()
    top = {}
    for i, _, h, *_ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        last = top.get(h or "")
        again = i is not None and i < last
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    assert sorted((tuple(r)[0], *tuple(r)[2:6]) for r in got if r.page_id is not None) == sorted(w for w in want if w[0] is not None)
    assert sum(r.page_id is None for r in got) == 1
    assert all(r.payload == (rows[r.page_id][2] or "") for r in got if r.record_type == "response" and r.page_id is not None)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def number_of(data, split):
    """Record ids by range, each range alone, with what a record hides in later ranges left out as the reader does."""
    out, reach = [], 0
    for s in range(0, len(data), split):
        ends = []
        for at, stop, fields, _ in warc.records(io.BytesIO(data), len(data), s, min(len(data), s + split)):
            ends.append(stop)
            if at >= reach:
                out.append(warc.urn_number(fields["warc-record-id"]))
        reach = max([reach, *ends])
    return out


def test_warc_ranges_own_each_record_once():
    stored = gzip.compress(warc.record_bytes(99, "u", b"x", None, warc.digest(b"x")), 0)
    parts = [warc.record_bytes(k, "u", stored * (k % 5) if k % 3 == 0 else bytes([k]) * 500, None, warc.digest(b"")) for k in range(40)]
    parts[9] = gzip.compress(gzip.decompress(parts[9]), 0)  # its payload is stored, so members lie in it as they are
    data = b"".join(parts)
    assert data.count(stored[:40]) >= 4
    for split in (1, 2, 7, 64, 333, 1000, 10**6):
        assert number_of(data, split) == list(range(40))


def test_damage_costs_no_other_record(spark, tmp_path):
    parts = [warc.record_bytes(k, "u", random.Random(k).randbytes(90).hex().encode(), None, warc.digest(random.Random(k).randbytes(90).hex().encode())) for k in range(5)]
    cut = bytearray(parts[2])
    cut[len(cut) // 2] ^= 0xFF
    junk = b"\x1f\x8b\x08junk"
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nabc\r\n\r\n")
    data = parts[0] + junk + parts[1] + bytes(cut) + parts[3] + short + parts[4][:-5]
    for split in range(1, len(data) + 1):
        assert number_of(data, split) == [0, 1, 3]
    wrong = parts[1] + warc.record_bytes(8, "u", b"x", None, warc.digest(b"y"))
    paths = []
    for name, some in (("a", data), ("b", wrong), ("c", b"none")):
        (tmp_path / name).write_bytes(some)
        paths.append((f"file://{tmp_path / name}", len(some), 5))
    manifest = spark.createDataFrame(paths, "path string, size long, records long")
    assert sorted(r.page_id for r in warc.read_archives(manifest.drop("records"), 100).collect()) == [0, 1, 1, 3]
    with pytest.raises(ValueError, match="4 sound records"):
        warc.read_archives(manifest, 100)
    found = {r.path[-1]: tuple(r)[2:] for r in warc.damage(manifest, 64).collect()}
    assert found == {"a": (3, 0, len(data) - sum(len(parts[k]) for k in (0, 1, 3))), "b": (2, 1, 0), "c": (0, 0, 4)}


def test_long_addresses_are_read():
    url = random.Random(1).randbytes(300_000).hex()
    data = warc.record_bytes(1, "u", b"a", None, warc.digest(b"a")) + warc.record_bytes(2, url, b"b", None, warc.digest(b"b"))
    for split in (1000, 10**7):
        assert number_of(data, split) == [1, 2]
    assert next(iter(warc.records(io.BytesIO(data), len(data), 10, len(data))))[2]["warc-target-uri"] == url


def naive_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and private_data.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice("a1@.é+ -(5%_04") for _ in range(rng.randint(0, 40)))
        assert private_data.base_spans(text) == naive_spans(text), text
    assert private_data.base_spans("see 4111 1111 1111 1111 or 1.2.3.4") == [("ip", 27, 34), ("card", 4, 23)]
    assert private_data.base_spans("7" * 200_000) == []


def test_context_finds_unseen_identifiers(spark):
    rows = [(k, f"please dial +1 (555) 010-{k:04d} today", "en", "s") for k in range(1000, 1030)]
    rows += [(1, "please dial 555-010-7777 now", "en", "s"), (2, "chapter 555-010-8888 ends", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (1, "please dial 555-010-7777 now", "en", "s")]
    got = private_data.find_spans(frame(spark, rows))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and by[1].spans == "id:12:24" and by[2].spans == "" and by[3].spans == ""
    assert by[1000].n_phone == 1 and by[1000].base_sha256 == hashlib.sha256(b"phone:12:29").hexdigest()
    masked = {r.doc_id: r for r in private_data.redact(frame(spark, rows)).collect()}
    assert masked[1].text == "please dial [ID] now" and masked[1].n_chars == 20 and masked[3].text is None and masked[2].text == rows[31][1]
    assert private_data.find_spans(frame(spark, rows).limit(0)).count() == 0


def test_quality_rules_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_rules.score_quality(docs, labels)
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in scored.collect())


def test_quality_of_odd_rows(spark):
    docs = frame(spark, corpus() + [(None, "x y", None, None)])
    one_kind = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (one_kind, one_kind.limit(0)):
        rows = quality_rules.score_quality(docs, labels).collect()
        assert len(rows) == len(corpus()) + 1 and all(r.score is not None for r in rows)
    assert quality_rules.score_quality(docs.limit(0), one_kind).count() == 0


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(language_id.document_rows(docs)).collect()
    assert len(rows) == docs.count() and sum(r.language == r.declared for r in rows) / len(rows) > 0.95
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = language_id.identify(language_id.page_rows(pages), language_id.document_labels(docs)).collect()
    assert len(found) == pages.count() and sum(r.language == r.declared for r in found) / len(found) > 0.9


def test_text_outweighs_a_wrong_declaration(spark):
    rng = random.Random(2)
    make = lambda words: " ".join(rng.choice(words) for _ in range(60))
    a, b = ["the", "other", "thing", "with", "there"], ["und", "nicht", "auch", "ein", "zwischen"]
    rows = [(k, make(a if k % 2 else b), "en" if k % 2 else "DE-at", f"h{k % 2}") for k in range(80)]
    rows += [(80, make(a), "de", "new"), (81, make(b), None, None), (82, None, "en", "h1"), (83, "12 34 !!", "en", "h1"), (82, None, "en", "h1")]
    got = {r.doc_id: r for r in language_id.identify(language_id.document_rows(frame(spark, rows))).collect()}
    assert (got[80].language, got[81].language, got[82].language, got[83].language) == ("en", "de", "und", "und")
    kept = language_id.keep_identified(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(82)) and kept.columns == frame(spark, rows).columns
    assert language_id.identify(language_id.document_rows(frame(spark, rows).limit(0))).count() == 0


@pytest.mark.parametrize("text,span", [
    ("dial 555 010 7777 now", "555 010 7777"), ("dial (555) 010-7777.", "(555) 010-7777"), ("account 1234 5678 9012", "1234 5678 9012"),
    ("iban DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 00"), ("iban GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"),
    ("dial 555-010-7777", "555-010-7777"), ("in 2020. 1500 went", None),
])
def test_grouped_digits_are_one_candidate(text, span):
    found = private_data.candidates(text, [])
    assert [(p, text[x["s"]:x["e"]]) for x in found for p in x["patterns"] if p.endswith(" _")] == ([(f"{text.split()[0]} _", span)] if span else [])


@pytest.fixture(scope="module")
def tokenizer():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    return sp, piece_sampling.Automaton(sp)


def test_pieces_round_trip(spark):
    rows = corpus() + [(500, "  two  spaces \n\ttab 日本 \U0001F600", "en", "s")]
    mark = piece_sampling.encode(frame(spark, [(1, "a▁b", "en", "s")])).collect()
    assert not any(r.decodes for r in mark)
    coded = piece_sampling.encode(frame(spark, rows), k=2).cache()
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.text == texts[r.doc_id] for r in piece_sampling.decode(coded).collect())
    by = {}
    for r in coded.collect():
        assert r.decodes and len(r.ids) == r.n_pieces
        by.setdefault(r.doc_id, {}).setdefault(r["rank"], set()).add(r.ids_sha256)
    assert all(len(x) == 1 for ranks in by.values() for x in ranks.values())  # repeated rows draw the same
    assert all(ranks[1] != ranks[2] for ranks in by.values() if 2 in ranks)
    assert piece_sampling.encode(frame(spark, rows).limit(0)).count() == 0


def test_the_query_returns_and_decodes_every_sequence(spark):
    """Ids of all ranks, the digest of these, and whether the tokenizer gives the text back from them."""
    import sentencepiece

    from siltbed.llm import queries

    d, sp = "/root/testdata/sf0.001", sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op4_sentencepiece(spark, d).collect()
    assert {r["rank"] for r in got} == {0, 1, 2} and {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() and r.decodes == (sp.decode(r.ids) == texts[r.doc_id])
        assert r["rank"] or r.ids == sp.encode(texts[r.doc_id])


def test_a_worker_gives_back_what_another_operator_kept():
    """The tokenizer's automaton would stay beside the sets of a join in the same worker."""
    from siltbed.llm import common, ngram_jaccard

    with open(piece_sampling.MODEL, "rb") as f:
        piece_sampling.loaded(f.read())
    assert common.KEPT
    assert list(ngram_jaccard.by_unit(ngram_jaccard.set_links, 80, ngram_jaccard.LINKS)(iter([])))[0].num_rows == 0 and not common.KEPT


def test_samples_follow_the_lattice(tokenizer):
    sp, auto = tokenizer
    ids = np.array(sp.encode("better"))
    seen, n = {}, 3000
    for s in range(n):
        out, kappa = piece_sampling.top_k(auto, ids, 2, piece_sampling.generator(s, 1, "better"))
        assert len({tuple(p) for _, _, p in out}) == len(out) and all(a[0] > b[0] for a, b in zip(out, out[1:])) and kappa < out[-1][0]
        first = tuple(out[0][2])
        seen[first] = (seen.get(first, (0, 0))[0] + 1, out[0][1])
    for count, logp in seen.values():
        if count > 100:
            assert abs(count / n - np.exp(logp)) < 0.04
    every, kappa = piece_sampling.top_k(auto, np.array(sp.encode("the")), 1000, piece_sampling.generator(1, 1, ""))
    assert kappa == -np.inf and abs(sum(np.exp(x[1]) for x in every) - 1) < 1e-6  # all segmentations, each once


@pytest.mark.parametrize("text", ["getz", "belich", "  to be\nor  a日b", "né\U0001F600t"])
def test_lattice_holds_every_segmentation(tokenizer, text):
    sp, auto = tokenizer
    whole = sp.normalize(text)
    normal = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def splits(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in normal:
                yield from ((normal[rest[:k]], *x) for x in splits(rest[k:]))
        if rest and rest[0] not in normal:
            yield from ((*(sp.piece_to_id(f"<0x{b:02X}>") for b in rest[0].encode()), *x) for x in splits(rest[1:]))

    weight = {x: sum(max(sp.get_score(i), -1e5) / piece_sampling.SCALE - piece_sampling.COST for i in x) for x in splits(whole)}
    total = np.logaddexp.reduce(list(weight.values()))
    got, kappa = piece_sampling.top_k(auto, np.array(sp.encode(text)), 10**5, piece_sampling.generator(1, 1, ""))
    assert kappa == -np.inf and len(got) == len(weight) and all(sp.decode(p.tolist()) == text for _, _, p in got)
    assert all(abs(logp - (weight[tuple(p.tolist())] - total)) < 1e-9 for _, logp, p in got)


def test_units_give_the_tokenizers_encoding(tokenizer):
    sp, auto = tokenizer
    texts = [r[1] or "" for r in corpus()] + ["a\u2581b", "\u2581", "  x   y ", "\n\t z\n a", "\u65e5\u672c \U0001F600 ab\ue000c", "\x00a", "ab" * 3000, "<s> </s> <0x41>", "\ufb01 \uff21"]
    assert [x.tolist() for x in auto.encode(sp, texts)[0]] == [sp.encode(t) for t in texts] and auto.apart


def test_samples_do_not_depend_on_kept_units(tokenizer, monkeypatch):
    sp, _ = tokenizer
    texts, got = [r[1] for r in corpus() if r[1]], []
    for choices, size in ((10**9, 1000), (300, 7), (2000, 1)):
        monkeypatch.setattr(piece_sampling.Automaton, "CHOICES", choices)
        auto, rows = piece_sampling.Automaton(sp), []
        for at in range(0, len(texts), size):
            keys = np.array([piece_sampling.generator(7, None, t) for t in texts[at:at + size]], np.uint64)
            rows += piece_sampling.searches(auto, auto.encode(sp, texts[at:at + size])[1], keys, 3)
        got.append([([(v, p, x.tolist()) for v, p, x in out], kappa) for out, kappa in rows])
    assert got[0] == got[1] == got[2]


def test_units_are_cut_where_no_piece_crosses(tokenizer):
    """A word is one unit whatever stands behind it, so that its lattice and encoding are made once."""
    sp, _ = tokenizer
    auto, texts = piece_sampling.Automaton(sp), ["to better, it", "better; better%%%", "better|"]
    units, found = auto.split([sp.normalize(t) for t in texts])
    assert ["".join(units.take(x.tolist()).to_pylist()) for x in found] == [sp.normalize(t) for t in texts]
    auto.encode(sp, texts)
    assert [u for u in auto.units if "better" in u] == ["\u2581better"]
    pairs = {p[i:i + 2] for p in map(sp.id_to_piece, range(sp.get_piece_size())) if not p.startswith("<") for i in range(len(p) - 1)}
    assert not any(a[-1] + b[0] in pairs for x in found for a, b in zip(units.take(x[:-1].tolist()).to_pylist(), units.take(x[1:].tolist()).to_pylist()))


def test_known_units_are_found_without_strings(tokenizer, monkeypatch):
    """Units of up to 23 bytes are found in their slots; others, and those whose slot another unit took, by the numbers of all. All give the same."""
    sp, _ = tokenizer
    texts, got = [r[1] for r in corpus() if r[1]] + ["a", "a\x00", "a\x00\x00", "ab" * 11, "ab" * 12, "ab" * 3000], []
    for slots in (1 << 19, 1 << 4, 1):
        monkeypatch.setattr(piece_sampling.Automaton, "SLOTS", slots)
        auto, strings = piece_sampling.Automaton(sp), []
        entered = auto.entered
        auto.entered = lambda parts, processor: strings.append(sum(map(len, parts))) or entered(parts, processor)
        rows = [auto.encode(sp, texts) for _ in range(2)]
        assert all([x.tolist() for x in a] == [x.tolist() for x in b] for a, b in zip(*rows))
        assert [x.tolist() for x in rows[0][0]] == [sp.encode(t) for t in texts]
        assert slots == 1 or strings[1] < strings[0]
        got.append([x.tolist() for x in rows[0][1]])
    assert got[0] == got[1] == got[2]


def test_regions_are_the_same_however_few_steps_are_looked_at(tokenizer, monkeypatch):
    sp, auto = tokenizer
    texts, got = [r[1] for r in corpus() if r[1]] + ["x" * 3000, "to be or not to be " * 200], []
    keys = np.array([piece_sampling.generator(7, i, t) for i, t in enumerate(texts)], np.uint64)
    for steps in (1, 20, 10**6):
        monkeypatch.setattr(piece_sampling, "STEPS", steps)
        got.append([([(v, p, x.tolist()) for v, p, x in out], kappa) for out, kappa in piece_sampling.searches(auto, auto.encode(sp, texts)[1], keys, 3)])
    assert got[0] == got[1] == got[2]


def test_rows_do_not_depend_on_how_much_is_kept():
    import pyarrow as pa

    with open(piece_sampling.MODEL, "rb") as f:
        model = type("Model", (), {"value": f.read()})
    docs = pa.table({"doc_id": [r[0] for r in corpus()], "text": [r[1] for r in corpus()]})
    few, many = ([b.to_pylist() for b in piece_sampling.encoded_rows(model, 2, 7, n)(iter(docs.to_batches(16)))] for n in (300, 10**9))
    assert few == many


def test_ids_pass_to_the_tokenizer_and_back_as_arrays(tokenizer, monkeypatch):
    """Without lists of Python integers in between; each unit of a text is looked up once."""
    import pyarrow as pa

    sp, lookups = tokenizer[0], []

    class Arrays:
        def __getattr__(self, name):
            return getattr(sp, name)

        def encode(self, text, return_type=None):
            assert return_type == "numpy"
            return sp.encode(text, return_type=return_type)

        def decode(self, ids):
            assert isinstance(ids, np.ndarray)
            return sp.decode(ids)

    class Unit(str):
        __eq__ = str.__eq__

        def __hash__(self):
            lookups.append(self)
            return str.__hash__(self)

    texts = ["to be or not to be", None, "", "日本 \U0001F600", "to be"]
    auto = piece_sampling.Automaton(Arrays())
    monkeypatch.setattr(piece_sampling, "loaded", lambda model: (Arrays(), auto))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = next(piece_sampling.encoded_rows(type("Model", (), {"value": b""}), 2, 7)(iter([batch]))).to_pylist()
    assert all(r["decodes"] for r in rows) and [r["ids"] for r in rows if not r["rank"]] == [sp.encode(t or "") for t in texts]
    auto.numbers([[Unit("\u2581to"), Unit("\u2581be"), Unit("\u2581to")]], Arrays())
    assert len(lookups) == 3


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain", "plain"),
    ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b <b>c</b></div>", "a\nb c"),
    ("<title>t</title><script>x<p></script><style>y</style><p>z</p><!-- c -->", "z"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("a<br>b", "a\nb"), ("<p hidden>x</p><p style='display: none'>y</p>z", "z"),
    ("&lt;b&gt; &amp;amp", "<b> &amp"), ("<b>un<i>closed", "unclosed"), ("</p></div>x", "x"), ("a < b <c", "a < b"),
    ("<h1>T</h1>t", "T\n\nt"), ("<dl><dt>k<dd>v</dl>", "k\n  v"), ("<img alt='pic'> x", "pic x"),
])
def test_rendering(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize("html,text", [
    ("a <span aria-hidden=true>x</span> b", "a x b"), ("<xmp><b>&amp;\n c</xmp>d", "<b>&amp;\n c\n\nd"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> y", "x=2 y"),
    ("<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><desc/><text>Jan</text><text>Feb</text></svg> z", "Jan Feb z"),
])
def test_drawn_text_is_visible(html, text):
    assert html_text.extract(html) == text


def test_deep_and_long_html(spark):
    assert html_text.extract("<div>" * 20000 + "x") == "x"
    assert html_text.extract("<ul><li>" * 300 + "x").endswith("x")
    rows = [(1, None, "u"), (2, "<p>a", "u"), (2, "<p>a", "u"), (None, "<p>" + "w " * 50000, "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract_text(pages)
    assert sorted(r.n_chars for r in got.collect()) == [0, 1, 1, 99999] and html_text.extract_text(pages.limit(0)).count() == 0
