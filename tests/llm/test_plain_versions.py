"""Corpus operators against plain versions of their methods, and on inputs that grow or fail."""

import hashlib
import random
import re
import time
import zipfile

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from test_operators import TEXTS, by_id, without_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from deckhand.llm import common, extraction, licences, media, packing, pii, quality, records, signatures, suffixes, vocab, wordbpe
from deckhand.llm.dom import Page


def test_frequent_strings_are_dealt_by_name(spark):
    """With every shared string taken for a frequent one, results stay those of brute force."""
    r = random.Random(4)
    footer = "this line stands below each page of the site, whatever stands above it and beside it"
    texts = TEXTS[8:40] + [f"{r.random()} {footer[r.randint(0, 9):]} {r.random()}" for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, N_Removed string").repartition(3, "doc_id")
    for often in (2, 1 << 14):
        got = by_id(suffixes.remove_repeats(docs, often_from=often))
        for k, (b, gone) in enumerate(without_repeats(texts)):
            assert (got[k].n_bytes, got[k].n_removed, bytes(got[k].kept)) == (len(b), gone.sum(), np.frombuffer(b, np.uint8)[~gone].tobytes())


def plain_feistel(key, salt, left, right, a, b, backwards=False):
    """The network number by number; its rounds in reverse undo it."""
    for i in range(1, pii.ROUNDS + 1)[:: -1 if backwards else 1]:
        f = int(hashlib.sha256(f"{key}:{salt}:{i}:{right if i % 2 else left}".encode()).hexdigest()[:13], 16)
        if i % 2:
            left = (left + (-f if backwards else f)) % a
        else:
            right = (right + (-f if backwards else f)) % b
    return left, right


def test_pseudonyms_are_those_of_a_plain_network(spark):
    texts = ["ssn 123-45-6789", "call 743-555-3824", "ip 10.0.0.255", "card 4111 1111 1111 1111", "+353 1 2345678", "+353 12345678", "born 1984-02-29"]
    got = {k: r.text for k, r in by_id(pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")).items()}
    rank, serial = plain_feistel("k", "ssn", 122 * 99 + 44, 6788, 898 * 99, 9999)
    area = rank // 99 + 1 + (rank // 99 >= 665)
    assert got[0] == f"ssn {area:03}-{rank % 99 + 1:02}-{serial + 1:04}"
    local, line = plain_feistel("k", "phone", (743 - 200) * 800 + 555 - 200, 3824, 640_000, 10_000)
    assert got[1] == f"call {local // 800 + 200}-{local % 800 + 200}-{line:04}"
    assert plain_feistel("k", "phone", local, line, 640_000, 10_000, backwards=True) == ((743 - 200) * 800 + 555 - 200, 3824)
    x, y = plain_feistel("k", "ipv4", 10 * 256, 255, 65536, 65536)
    assert got[2] == f"ip {x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    x, y = plain_feistel("k", "card4:14", 1111111, 1111111, 10**7, 10**7)
    assert re.sub("[^0-9]", "", got[3])[:15] == f"4{x:07}{y:07}"
    assert re.sub("[^0-9]", "", got[4]) == re.sub("[^0-9]", "", got[5])
    assert plain_feistel("k", "date19", *plain_feistel("k", "date19", 3, 5, 92, 397), 92, 397, backwards=True) == (3, 5)


def test_the_key_is_the_sessions(spark):
    docs = spark.createDataFrame([(1, "ssn 123-45-6789", "x", "y", "z")], "doc_id long, text string, _text string, _found string, PII_KINDS string")
    spark.conf.unset(pii.KEY_SETTING)
    first, again = by_id(pii.pseudonymize(docs))[1], by_id(pii.pseudonymize(docs))[1]
    assert first.text == again.text and (first._text, first._found, first.pii_kinds) == ("x", "y", ["ssn"])
    spark.conf.set(pii.KEY_SETTING, "a")
    assert by_id(pii.pseudonymize(docs))[1].text == by_id(pii.pseudonymize(docs, "a"))[1].text != first.text
    spark.conf.unset(pii.KEY_SETTING)


class Flaky:
    """A file that fails now and then."""

    def __init__(self, f, faults):
        self.f, self.faults = f, faults

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        if self.faults:
            what = self.faults.pop()
            if what == "error":
                raise OSError("lost")
            return self.f.read(n)[: n // 2]
        return self.f.read(n)


def test_members_are_tried_again_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    media.write_archives(spark.createDataFrame([(k, f"text {k} " * 50) for k in range(40)], "doc_id long, text string").coalesce(1), tmp_path.as_uri())
    (path,) = (str(p) for p in tmp_path.glob("*.zip"))
    fs, opened = pafs.LocalFileSystem(), []
    reader = lambda: media.ArchiveReader({"path": tmp_path.as_uri()})

    class Store:
        def open_input_file(self, p):
            opened.append(p)
            return Flaky(fs.open_input_file(p), ["short"] if len(opened) < 2 else [])

    with fs.open_input_file(path) as f:
        every = media._members(fs, f, media.ByteRange(path, 0, 1 << 40))
        few = media._members(fs, f, media.ByteRange(path, every[7].header_offset, every[9].header_offset))
    assert len(every) == 40 and few == every[7:9]
    with zipfile.ZipFile(path) as z:
        expected = [z.read(i) for i in z.infolist()]
    name, data, _ = media._member(Store(), Flaky(fs.open_input_file(path), ["error"]), path, every[5])
    assert data == expected[5] and len(opened) == 2 and name.startswith("5_")
    damaged = media.Member(every[3].header_offset, every[3].compress_size, every[3].CRC ^ 1)
    with pytest.raises(zipfile.BadZipFile, match="wrong check"):
        media._member(fs, fs.open_input_file(path), path, damaged)
    # An archive of another's making has no index; its directory serves.
    whole = pa.Table.from_batches(reader().read(media.ByteRange(path, 0, 1 << 40))).to_pylist()
    next(tmp_path.glob("*.index")).unlink()
    assert pa.Table.from_batches(reader().read(media.ByteRange(path, 0, 1 << 40))).to_pylist() == whole and [r["media"] for r in whole] == expected


def test_records_in_any_order(spark):
    path = common.scratch(spark, "shuffled")
    docs = spark.createDataFrame([(k % 7, f"some text {k} " * (k % 5)) for k in range(60)], "doc_id long, text string")
    manifest = records.write_records(docs, path)
    rows = sorted(records.read_records(spark, manifest).collect(), key=lambda r: r.start)
    at = [(r.file, k) for r in manifest.orderBy("file").collect() for k in range(r.records)]
    order = list(range(60))
    random.Random(1).shuffle(order)
    for k in order:
        doc_id, ids = records.record_at(*at[k])
        assert (doc_id, ids.astype("<u4").tobytes()) == (rows[k].doc_id, bytes(rows[k].ids))
    assert [r.doc_id for r in rows] == sorted(k % 7 for k in range(60))


def plain_detections(text):
    """All matches of all rules, less those that another one beats; pair by pair."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    joined = f" {re.sub(licences.BETWEEN, ' ', low).strip(' ')} "
    found = [(m.start() + 1, m.end() - m.start() - 1, label, rank, c) for label, p, rank, c, _, _ in licences.rules() for m in re.finditer(f" (?:{p})(?= )", joined)]

    def beats(e, d):
        a, n, b, m = e[0], e[1], d[0], d[1]
        covers = a <= b and a + n >= b + m and n > m
        return a < b + m and b < a + n and (covers or (e[3] < d[3] and not (b <= a and b + m >= a + n and m > n)))

    return sorted(d for d in found if not any(beats(e, d) for e in found))


def test_detections_against_all_pairs(spark):
    lines = [p for _, _, p in (x.split(" ", 2) for x in signatures.TABLE.strip().split("\n"))]
    r = random.Random(2)
    said = [re.sub(r"\(\?:([^()|]*)\|?[^()]*\)\??", r"\1", re.sub(r"\[(.)[^]]*\]", r"\1", p)).replace(" ?", " ") for p in lines]
    texts = [" ".join(r.choices(said, k=12)) for _ in range(12)] + ["license mit " * 90, "mit license " * 90, "Licensed under the Apache License, Version 2.0; see the MIT License. " * 30, ""]
    docs = spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(texts)], "doc_id long, text string, Labels string, _words string, _found string")
    got = by_id(licences.scan(docs))
    for k, t in enumerate(texts):
        plain = plain_detections(t)
        assert sorted((d.at, d.size, d.label, d.priority, d.confidence) for d in got[k].detections) == plain
        assert got[k].score == max((d[4] for d in plain), default=0) and set(filter(None, got[k].labels.split(","))) >= {d[2] for d in plain}
        assert (got[k]._words, got[k]._found) == ("b", "c")
    assert len(signatures.signatures()) > 200


def test_long_texts_take_time_in_proportion(spark):
    took = []
    for n in (8_000, 32_000):
        docs = spark.createDataFrame([(1, "mit license " * n)], "doc_id long, text string")
        began = time.time()
        assert licences.licence_digest(docs).first().n_base == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5
    model = extraction.trained()
    for source in ("<div>" * 40_000, "<a " * 60_000 + '"', '<p "' * 40_000, "<p>some words, and more of them.</p>" * 5000):
        began = time.time()
        extraction.main_texts([source], model)
        assert time.time() - began < 20


PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a> <a href=/b>Boats</a></nav><main><article><h1>On the tides of the bay</h1><p>The water rises twice a day, and it falls twice a day, as everyone who lives here knows.</p>"
    "<p>Boats leave with the ebb, when the channel is deep, and they come home with the flood.</p></article></main><footer><p>Copyright 2020 The Bay. <a href=/x>Terms</a></p></footer></body></html>":
        "On the tides of the bay\nThe water rises twice a day, and it falls twice a day, as everyone who lives here knows.\nBoats leave with the ebb, when the channel is deep, and they come home with the flood.",
    "<body><header><h2>The Daily Net</h2><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></header><div class=content><article><h1>A harbour wall</h1><p>Let <math><mi>x</mi></math> be the <object>height</object> of the wall, and <noscript>y</noscript> its width, in metres.</p>"
    "<p>Then it stands, as the builders of it have shown &amp; proved.</p></article></div><aside class=sidebar><p>Most read</p><a href=3>Ten boats</a></aside><script>var a='</p>'</script></body>":
        "A harbour wall\nLet x be the height of the wall, and y its width, in metres.\nThen it stands, as the builders of it have shown & proved.",
}


def test_pages_of_another_making():
    assert extraction.main_texts(list(PAGES), extraction.trained()) == list(PAGES.values())


def test_controls_and_footers_within_an_article():
    second = "<p>The second paragraph is here, and it says more than the first one did.</p><p>And a third, which ends the page with some words.</p>"
    text = "The second paragraph is here, and it says more than the first one did.\nAnd a third, which ends the page with some words."
    pages = {f"<article><h1>Head of it</h1><p>Pick a size <select>{x}</select> and read on.</p>{second}": f"Head of it\nPick a size and read on.\n{text}" for x in ("<option>S<option>M", "<option>S</option><option>M</option>", "<optgroup label=a><option>S<optgroup label=b><option>M")}
    pages[f"<body><article><h1>Head of it</h1>{second}<footer>Filed under boats</footer></article></body>"] = f"Head of it\n{text}"
    assert extraction.main_texts(list(pages), extraction.trained()) == list(pages.values())
    lines = lambda source: (p := Page(source)).lines([True] * len(p.tags))
    assert lines("<p>a <select><option>S<option>M<optgroup label=x><option>L</select> b</p><p>c</p>") == ["a S M L b", "c"]
    assert lines("<datalist><option>y<option>z</datalist>after") == ["y zafter"]


def test_what_a_page_shows():
    lines = lambda source: (p := Page(source)).lines([True] * len(p.tags))
    assert lines("<p>Let <math><mi>x</mi></math> be <object>shown text</object> and <noscript>plain</noscript> end.</p>") == ["Let x be shown text and plain end."]
    assert lines('<svg><title>no</title><text>drawn</text>not</svg><p>x <a href="y>z</a> e</p><template>t</template>') == ["drawn", "x z e", "t"]
    assert "head" not in "".join(lines("<title>head</title><p>a</p>"))


def test_scripts_are_split_into_words(spark):
    texts = ["中文没有空格。这是第二句，真的！１２３", "สวัสดีชาวโลก ทดสอบ", "Привет, мир! 123 мир", "한국어 텍스트 ①②", "a\x1cb \x1d c\x85d e​f", "😀😀 é \U0001fae8 Ᲊ ꟍ", "नमस्ते दुनिया नमस्ते", " \n \t 中 \n文"]
    ranks = wordbpe.encoding(vocab.default_path("byte_bpe_multi_50k.tiktoken"))
    got = by_id(wordbpe.encode_documents(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")))
    for k, t in enumerate(texts * 2):
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ranks.encode_ordinary(t)
    words, sequence, _ = wordbpe.explode([texts[0] * 20], wordbpe.unlike())
    assert len(words) < 12 and len(sequence) > 80  # each word once, not the paragraph as one


def test_conversations_bear_loss_on_the_assistants_turns(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    turns = [(c, k, role, f"{role} says {c} times {k}, " * (c % 9 + k)) for c in range(30) for k, role in enumerate(["system", "user", "assistant", "user", "assistant", None][: 2 + c % 5])]
    turns += [(99, 0, "assistant", "word " * 9000), (98, 0, "user", None), (None, 0, "assistant", "x")]
    got = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), packing.Limits(tokens=900, segments=5, loss_tokens=400)).collect()
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids) + 1
    expected = {c: (sum(size(x) for d, _, _, x in turns if d == c), sum(size(x) for d, _, role, x in turns if d == c and role == "assistant")) for c in {x[0] for x in turns}}
    assert {r.conv_id: (r.tokens, r.loss_tokens) for r in got} == expected and len(got) == len(expected)
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        assert [r.offset for r in s] == [sum(x.tokens for x in s[:k]) for k in range(len(s))]
        assert len(s) == 1 or (sum(r.tokens for r in s) <= 900 and len(s) <= 5 and sum(r.loss_tokens for r in s) <= 400)
    assert len(by) < len(expected)


def test_training_rows_are_the_same_each_time(spark):
    docs = spark.createDataFrame([(k % 20, f"Line {k}, a good one.\nAnother." if k % 2 else None) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    a, b = quality.train(docs, labels, 15), quality.train(docs.repartition(7), labels, 15)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.pairs, b.pairs)
    long = "A word, and one more of them.\n" * 60_000
    row = quality.assess(spark.createDataFrame([(1, long, "x")], "doc_id long, text string, KEPT string"), a).first()
    assert row.n_words == 420_000 and row.n_dup_lines == 59_999 and row.base_failed


def test_scratch_goes_with_its_block(spark):
    df = spark.range(3)
    with common.temporary(spark) as keep:
        first, second = common.written(df, "first"), keep(common.written(df, "second"))
    assert second.count() == 3
    with pytest.raises(Exception, match="first|exist"):
        spark.read.schema("id long").parquet(first._deckhand_path).count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, repeats, an empty text, an extra column that is named as one of an operator's."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    body = " ".join(f"word{k} stands," for k in range(60)) + " and that is all of it."
    rows = [(1, body, "en", "s", len(body), 1), (1, body, "en", "s", len(body), 2), (2, None, None, None, None, 3), (3, "", "en", "s", 0, 4), (None, body + " Call 743-555-3824.", None, "s", None, 5), (4, body + " More.", "en", None, 7, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, N_Words long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.columns
            docs = common.written(stage(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == before
        assert docs.count() == 0 or {r.doc_id for r in docs.collect()} <= {1, 2, 3, 4, None}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sum(p.start == 0 for p in pieces) == docs.count()


def check_placed(tokens, limits):
    """Whether all tokens lie in exactly one piece and all sequences keep the limits and need no padding; the sequences."""
    tokens = np.array(tokens, np.int64)
    got = packing.place(tokens, np.maximum(tokens - 1, 0), limits, cut=True)
    pieces = sorted(p for b in got for p in b)
    for k, n in enumerate(tokens.tolist()):
        own = [(s, m) for e, s, m in pieces if e == k]
        assert [s for s, _ in own] == [sum(m for _, m in own[:j]) for j in range(len(own))] and sum(m for _, m in own) == n
    for b in got:
        n = sum(m for _, _, m in b)
        assert 0 < len(b) <= limits.segments and n <= limits.tokens and n & n - 1 == 0
    return got


def test_segments_and_tokens_bind_together():
    r = random.Random(8)
    limits = packing.Limits(tokens=1024, segments=8)
    tokens = [min(1023, int(r.lognormvariate(4.6, 0.9)) + 1) for _ in range(1500)]
    got = check_placed(tokens, limits)
    assert sum(len(b) == 8 for b in got) > len(got) / 3  # the limit closes many sequences
    assert sum(sum(m for _, _, m in b) == 1024 for b in got) == sum(tokens) // 1024  # and costs no full sequence
    # Tiny documents only: the segments run out first, everywhere.
    assert len(check_placed([3] * 100, limits)) == 26  # 12 times 16 + 8, then 8 + 4
    check_placed([1], limits), check_placed([1023] * 5, limits), check_placed([1, 1023] * 20 + [512] * 7, limits)
    for k in range(60):
        check_placed([r.choice([1, 2, 5, 60, 400, 1023]) for _ in range(r.randint(1, 40))], packing.Limits(tokens=1024, segments=r.randint(1, 9)))


def test_documents_keep_the_limit_on_segments(spark):
    docs = spark.createDataFrame([(k % 50, "word " * (k % 90)) for k in range(700)] + [(None, None), (51, "long text " * 9000)], "doc_id long, text string").coalesce(2)
    by = {}
    for p in packing.pack_documents(docs).collect():
        by.setdefault(p.sequence_id, []).append(p)
    assert max(map(len, by.values())) == packing.DOCUMENT_LIMITS.segments
    assert all(n & n - 1 == 0 for n in (sum(p.length for p in s) for s in by.values()))


def test_decoding_joins_ids_with_the_table(spark):
    ranks = wordbpe.encoding(vocab.default_path("byte_bpe_multi_50k.tiktoken"))
    texts = ["one", None, "", "two words", "long text, quite. " * 20000, "", "日本 \U0001fae8", None]
    pack = lambda t: None if t is None else np.array(ranks.encode_ordinary(t), "<u4").tobytes()
    rows = [(k % 3 or None, pack(t)) for k, t in enumerate(texts * 40)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary")
    plan = wordbpe.decode_documents(df)
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in plan.collect()) == sorted((d or 0, i or b"", (texts[k % 8] or "").encode()) for k, (d, i) in enumerate(rows))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "Exchange hash" not in shown
    assert wordbpe.decode_documents(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="doesn't have"):
        wordbpe.decode_documents(spark.createDataFrame([(1, np.array([5, 1 << 30], "<u4").tobytes())], "doc_id long, ids binary")).collect()
