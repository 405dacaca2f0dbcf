"""Periodic runs, spelling groups and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from newsloom.llm import entry, packing, periodic_runs, spelling
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


# --- 11


def brute_runs(ws):
    n, out = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def brute_left(ws, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def random_words(r):
    k, n = r.choice([1, 2, 3, 50]), r.choice([0, 1, 5, 30, 150])
    ws = [str(r.randrange(k)) for _ in range(n)]
    if n and r.random() < 0.6:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 9)
        ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
    if r.random() < 0.4:
        q = r.randint(1, 40)
        ws += ([str(r.randrange(k)) for _ in range(q)] * 6)[: r.randint(3 * q, 6 * q)] + ws[:10]
    return ws


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(400):
        texts = [random_words(r) for _ in range(r.randint(1, 5))]
        _, runs, left = periodic_runs.analyse([" ".join(t).encode() for t in texts])
        for t, found, rest in zip(texts, runs, left, strict=True):
            want = brute_runs(t)
            assert list(map(tuple, found.tolist())) == want
            assert rest == brute_left(t, want)


def test_runs_of_a_long_text_and_of_every_period():
    r = random.Random(6)
    for q in [*range(1, 70), 127, 128, 129, 500, 4000]:
        ws = [str(r.random()) for _ in range(q)] * 4
        ws = ["a", *ws, *ws[: q // 3], "b"]
        (_, runs, _) = periodic_runs.analyse([" ".join(ws).encode()])
        want = [(1, len(ws) - 2, q)] if len(ws) - 2 >= 6 else []
        assert list(map(tuple, runs[0].tolist())) == want


def planted(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_query(spark):
    rows = {r.doc_id: r for r in entry.op11_periodic_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows.values()) > 5
    for d in docs:
        ws = planted(d.doc_id, d.text)
        got = rows[d.doc_id]
        if len(ws) > 1500:
            continue
        runs = brute_runs(ws)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
        assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == want
        assert got.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(brute_left(ws, runs).encode()).hexdigest()


def test_runs_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "x x x x x x x", 3), (2, "é é " * 7, 4), (2, "é é " * 7, 4), (3, " \t\n ", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long").withColumn("collapsed", F.lit(1)).withColumn("_words", F.lit(2))
    out = periodic_runs.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in out) == [(0, 7, 1, "x"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 7, 1, "é é"), (2, 7, 1, "é é"), (3, 0, 0, "")]
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_repeats(docs))).count() == 6
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# --- 12


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    """Near words by the strings that remain when a place is left out."""
    open_, out = {}, {}
    for w in counts:
        open_.setdefault(w, set()).add(w)
        for i in range(len(w)):
            open_.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            open_.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for w, n in counts.items():
        found = set(open_[w])
        for i in range(len(w)):
            found |= open_[i, w[:i] + w[i + 1 :]] | ({w[:i] + w[i + 1 :]} & counts.keys())
        found = {x for x in found if near(w, x)}
        best = min(found, key=lambda x: (-counts[x], x.encode()), default=None)
        out[w] = (n, len(found), best if best is not None and counts[best] >= 10 * n else None)
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {(w, f, root(w), n, k, counts[f] if f else None) for w, (n, k, f) in out.items()}


def brute_counts(docs):
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = entry.op12_spelling_groups(spark, FOLDER).collect()
    want = brute_groups(brute_counts(docs))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r.form is not None for r in got) > 5


def variants(seed, n, letters="aeiouÀÿ÷zst"):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.choice([7, 8, 9, 30]))): r.choice([2, 3, 40, 400, 5000]) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i, c = r.randrange(len(w)), r.choice(letters)
        for v in (w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[::-1], "".join(sorted(w))):
            if len(v) >= 7:
                words.setdefault(v, r.choice([2, 30, 300]))
    return words


@pytest.mark.parametrize("cell", [spelling.CELL, 60])
def test_groups_equal_brute_force(spark, monkeypatch, cell):
    """With trees of many cells too, and words of equal letter counts that are dealt to several cells."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "SAMPLE", min(cell, 16))
    monkeypatch.setattr(spelling, "LEAF", 8)
    words = variants(3, 500)
    r = random.Random(4)
    for _ in range(150):
        a = list("aabbccdde")
        r.shuffle(a)
        words.setdefault("".join(a), 3)
        words.setdefault("".join(a[:-1]), 50)
        words.setdefault("".join(a[:-1]) + "z", 700)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(x) for x in spelling.spelling_groups(df).collect()} == brute_groups(words)


def test_chains_and_ties_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "xbcdefg": 20, "ébcdefg": 20, "zzzzzzz": 5}
    got = {r.word: r for r in spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["abcdefg"].form == "abcdefgh" and got["abcdefg"].root == "abcdefghij" and got["zzzzzzz"].root == "zzzzzzz" and got["zzzzzzz"].n_near == 0
    assert {tuple(r) for r in got.values()} == brute_groups(words)


def test_words_of_nulls_and_odd_texts(spark):
    rows = [(1, None), (None, "abcdefg ABCDEFG ÀBCDEFG"), (2, ""), (3, "x" * 30_000 + " " + "x" * 30_000), (3, "İstanbulx İstanbulx"), (4, "abcdefg"), (4, "abcdefg")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == brute_counts(rows)
    assert spelling.spelling_groups(spelling.word_counts(docs)).count() == len(got)
    assert spelling.spelling_groups(spelling.word_counts(docs.limit(0))).count() == 0


# --- 13


def check_packing(rows, docs, tokenizer):
    ids = {}
    for key, text in docs:
        ids.setdefault(key, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at == own[0].tier and at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    groups = {}
    for s, own in by_sequence.items():
        groups.setdefault(own[0].step_group, []).append(own[0].tier)
    assert sorted(groups) == list(range(len(groups)))
    assert all(len(set(t)) == 1 and sum(t) <= packing.STEP for t in groups.values())
    assert by_doc.keys() == ids.keys()
    for key, own in by_doc.items():
        if len(ids[key]) > 1:
            continue
        (all_ids,) = ids[key]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(all_ids)
            assert r.ids_crc32 == zlib.crc32(np.array(all_ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(all_ids)
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.vocabulary())


def test_packing_query(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = entry.op13_packing(spark, FOLDER).collect()
    check_packing(rows, docs, tokenizer)
    tiers = [r.tier for r in rows if r.offset == 0]
    assert sum(t for t in tiers if t >= packing.SHORTEST) > 0.99 * sum(tiers)
    assert len(rows) < 1.5 * len(docs) + len(tiers)


def test_packing_of_odd_texts(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "it's <|endoftext|> x"), (4, " two  blanks \n\n and\ta tab "), (5, "日本 語 x"), (6, "w" * 9000 + " " + "z y " * 3000), (7, "same"), (7, "same"), (8, " lead"), (9, "trail ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("tier", F.lit(2)).repartition(2)
    check_packing(packing.pack(docs).collect(), rows, tokenizer)
    assert packing.pack(docs.limit(0)).count() == 0


def test_ids_are_those_of_whole_texts(tokenizer):
    r = random.Random(9)
    bits = ["the", "don't", " ", "  ", "\n", ".", "é", "12", "x'll", " ", "\x1c", "!", "<|endoftext|>", "日本"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(2000)]
    got = packing.Encoder(packing.vocabulary()).encode(pa.array(texts, pa.large_string()))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_vocabulary_without_the_order_of_ranks_is_encoded_by_the_tokenizer(tokenizer):
    import json

    spec = json.loads(packing.vocabulary())
    merges = spec["model"]["merges"]
    merges[500], merges[900] = merges[900], merges[500]
    odd = json.dumps(spec)
    from tokenizers import Tokenizer

    texts = ["the quick brown foxes", "", "an other day"]
    assert packing.byte_ranks(spec) is None
    got = packing.Encoder(odd).encode(pa.array(texts, pa.large_string()))
    assert [g.tolist() for g in got] == [Tokenizer.from_str(odd).encode(t, add_special_tokens=False).ids for t in texts]
