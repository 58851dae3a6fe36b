"""Periodic runs, token counts and ranked search against plain versions, on odd, long and repeated inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from deckhand.llm import lexical, periods, tokencounts


def plain_runs(words):
    """Place by place, lag by lag."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, size, q) for (a, size), q in found.items())


def test_runs_against_all_lags():
    r = random.Random(1)
    for _ in range(400):
        n = r.randint(0, 260)
        words = [str(r.randrange(r.choice([1, 2, 3, 5, 50]))) for _ in range(n)]
        for _ in range(r.randint(0, 4)):
            if n > 30:
                a, p = r.randrange(n), r.randint(1, 40)
                e = min(n, a + r.randint(10, 200))
                words[a:e] = [words[min(a + (i - a) % p, n - 1)] for i in range(a, e)]
                if r.random() < 0.5:
                    words[r.randrange(a, e)] = "x"
        assert periods.runs(words) == plain_runs(words)
    assert periods.runs(["a"] * 23) == [] and periods.runs(["a"] * 24) == [(0, 24, 1)]
    assert periods.runs("a b".split() * 12) == [(0, 24, 2)] and periods.runs("a b c d e f g h i".split() * 3)[0] == (0, 27, 9)


def test_runs_of_long_texts():
    r = random.Random(2)
    words = [str(r.randrange(3000)) for _ in range(300_000)]
    tail = [words[100_000 + i % 50_000] for i in range(200_000)]
    fib = ["a", "b"]
    while len(fib) < 300_000:
        fib += fib[: len(fib) * 55 // 89 or 1]
    began = time.time()
    assert periods.runs(words) == [] and periods.runs(words[:100_000] + tail) == [(100_000, 200_000, 50_000)]
    periods.runs(fib)
    assert periods.runs(["a"] * 300_000) == [(0, 300_000, 1)] and time.time() - began < 60


def test_run_query(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "a", "x " * 24, "a\x0bb\x1cb " * 30] + [" ".join(str(r.randrange(9)) for _ in range(r.randint(1, 400))) for _ in range(120)]
    rows = [(k, t, "c", 1) for k, t in enumerate(texts)] + [(7, "twice " * 30, "c", 1), (None, "z " * 40, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Collapsed string, n_words long")
    got = sorted(map(tuple, periods.run_digest(docs).collect()), key=str)
    expected = []
    for doc_id, t, _, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        own = plain_runs(words)
        gone = {i for a, size, q in own for i in range(a + q, a + size)}
        best = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        listed, left = "".join(f"{a},{size},{q}\n" for a, size, q in own), " ".join(w for i, w in enumerate(words) if i not in gone)
        expected.append((doc_id, n, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(left)))
    assert got == sorted(expected, key=str) and sum(x[2] > 0 for x in got) > 8
    assert periods.run_digest(docs.limit(0)).count() == 0
    whole = {x.doc_id: x for x in periods.periodic_runs(docs.where("doc_id = 4")).collect()}[4]
    assert (whole.n_words, whole.runs[0].asDict(), whole.collapsed) == (24, {"start": 0, "length": 24, "period": 1}, "x")


def test_every_proved_string_is_one_token():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    proved = tokencounts.prove(t)
    assert len(proved) > 50_000 and all(len(t.model.tokenize(x)) == 1 for x in list(proved)[::50])

    class Model:  # a vocabulary with a string that its merges never give
        def tokenize(self, x):
            return [x] if x != "ab" else ["a", "b"]

    class Made:
        model = Model()

        def get_vocab(self, with_added_tokens):
            return {"a": 0, "b": 1, "ab": 2}

    assert tokencounts.prove(Made()) == {"a", "b"}


def test_counts_equal_the_library(spark):
    t, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(4)
    letters = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "é", "日本", "\x1c", "\x85", "'s", "'ll", "12", "<|endoftext|>", "<|end", "!", "​", "\U0001fae8", "İ", "\xa0", ",", ".", "😀"]
    texts = [None, "", " ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y ", "word " * 50_000, "x" * 30_000, "日" * 5000] + ["".join(r.choices(letters, k=r.randint(1, 25))) for _ in range(3000)]
    rows = [(k, x, 1) for k, x in enumerate(texts)] + [(3, "again", 2), (None, "a b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens long")
    got = sorted(map(tuple, tokencounts.count_digest(docs).drop("n_whole").collect()), key=str)
    sizes = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x, _ in rows]
    assert got == sorted(((k, len((x or "").encode()), n, n > 1024) for (k, x, _), n in zip(rows, sizes)), key=str)
    assert tokencounts.count_digest(docs.limit(0)).count() == 0
    share = tokencounts.count_tokens(docs.where("doc_id = 5")).first()
    assert share.n_whole > 49_000 and share.n_tokens - share.n_whole < 5
    counts = tokencounts.Counts(P.path("byte_bpe_50k.json"))
    assert all(sum(counts.count(x or "")) == n for (_, x, _), n in zip(rows, sizes))


def test_counts_refuse_other_tokenizers():
    try:
        tokencounts.Counts(P.path("word_bpe_49k.json"))
    except ValueError as e:
        assert "byte-level" in str(e)
    else:
        raise AssertionError


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    split = [(d, terms(t)) for d, t in docs]
    n_docs, n_all = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, t in split:
            m, score = 75 + 25 * len(t) * n_docs // max(n_all, 1), 0
            for x in terms(text):
                if x in df:
                    tf = t.count(x)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, j + 1, d, -s) for j, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_against_full_scores(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: r.choice(["The", "of", "é", "日本", "x1", "__"]) if r.random() < 0.4 else f"w{int(r.expovariate(0.02))}"
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(300)] + [(k, "same words w3 here, THE same") for k in range(300, 380)]
    docs += [(400, None), (401, ""), (402, "... --"), (403, "long of " * 30_000), (None, "same w3"), (5, "a row of its own")]
    items = [(k, " ".join(word() for _ in range(r.randint(1, 25)))) for k in range(25)] + [(30, None), (31, "..."), (32, "unheard"), (33, "same same w3"), (34, "the"), (None, "w3 of")]
    table = spark.createDataFrame([(d, t, 1, "a") for d, t in docs], "doc_id long, text string, N long, terms string").repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    expected = plain_search(docs, items, 20)
    for shard, block, depth in ((1 << 21, 200_000, 32), (300, 40, 1)):
        monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        monkeypatch.setattr(lexical, "DEPTH", depth)
        assert sorted(map(tuple, lexical.search_documents(table, queries).collect()), key=str) == expected
    assert sorted(map(tuple, lexical.search_documents(table, queries, 3).collect()), key=str) == plain_search(docs, items, 3)
    assert lexical.search_documents(table.limit(0), queries).count() == lexical.search_documents(table, queries.limit(0)).count() == 0
    twice = lexical.search_documents(table, spark.createDataFrame([(1, "same"), (1, "w3")], "item_id long, text string")).collect()
    assert sorted(map(tuple, twice), key=str) == plain_search(docs, [(1, "same w3")], 20)


def test_lists_are_left_as_soon_as_the_threshold_allows():
    """With one rare, weighty term the lists of frequent ones are hardly read, and a tie at the threshold isn't cut off."""
    n = 20_000
    r = np.random.default_rng(1)
    rare = np.arange(n) % 500 == 7
    rows = np.concatenate([np.flatnonzero(rare), np.arange(n)])
    terms = np.concatenate([np.zeros(rare.sum(), np.int64), np.ones(n, np.int64)])
    impact = np.concatenate([np.full(rare.sum(), 1000), r.integers(1, 900, n)])
    order = np.lexsort((terms, rows))
    shard = lexical.Shard(list(range(n)), rows[order], terms[order], impact[order], 2)
    found, scores, depth = shard.best(np.array([0, 1]), np.array([50, 1]), 10, np.zeros(2, np.int64))
    full = np.zeros(n, np.int64)
    np.add.at(full, rows, np.where(terms == 0, 50, 1) * impact)
    best = np.lexsort((np.arange(n), -full))[:10]
    assert found.tolist() == best.tolist() and scores.tolist() == full[best].tolist() and depth < 200
    tied = lexical.Shard(list(range(n))[::-1], np.arange(n), np.zeros(n, np.int64), np.full(n, 5), 1)
    assert [tied.ids[x] for x in tied.best(np.array([0]), np.array([2]), 4, np.zeros(1, np.int64))[0]] == [0, 1, 2, 3]
