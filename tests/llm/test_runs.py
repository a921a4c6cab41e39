"""Periodic runs against a search by every period."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import runs


def plain(s, least=6, exponent=4):
    out, n = set(), len(s)
    for p in range(1, n):
        i = 0
        while i + p < n:
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, exponent * p) and not any(all(s[i + k] == s[i + k + q] for k in range(length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_equals_plain(texts):
    for s, found in zip(texts, runs.runs_of_texts(texts), strict=True):
        assert [tuple(r) for r in found.tolist()] == plain(s)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=30))
def test_other_exponents(s):
    assert [tuple(r) for r in runs.runs(np.array([*s, 9]), 2, 2).tolist()] == plain(s, 2, 2)
    assert [tuple(r) for r in runs.runs(np.array([*s, 9]), 1, 3).tolist()] == plain(s, 1, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40))
def test_next_smaller(v):
    want = [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]
    assert runs.next_smaller(np.array(v)).tolist() == want


def row(doc_id, text):
    """The contract's columns, written out plainly."""
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in found)]
    head = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def texts():
    r = np.random.default_rng(0)
    out = [(i, " ".join(str(x) for x in r.integers(0, 1 + i % 7, r.integers(1, 60)))) for i in range(400)]
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a\x0bb\x0ca b a b a\rb a b"), (1004, "é è " * 9), (None, "x y " * 10), (None, None)]
    return out + [(1005, "go " * 7), (1005, "go " * 7), (1005, "other text"), (1006, "a b " * 4 + "c d " * 4), (1007, "no cut no cut " * 3)]


@pytest.mark.parametrize("group", [runs._WORDS, 20])
def test_rows(spark, monkeypatch, group):
    monkeypatch.setattr(runs, "_WORDS", group)
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_runs int, start string")
    got = sorted(map(tuple, runs.periodic_runs(df).collect()), key=str)
    assert got == sorted((row(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 6000").select("doc_id", "text")
    want = sorted((row(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted(map(tuple, runs.periodic_runs(docs).collect()), key=str) == want


def test_very_long_text(spark):
    words = ["begin"] + ["la", "di", "da"] * 100_000 + ["end"]
    df = spark.createDataFrame([(3, " ".join(words))], "doc_id bigint, text string")
    assert zlib.crc32(b"3") % 10
    r = runs.periodic_runs(df).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 1, 300_000, 3, 100_000_000)
    assert r.collapsed_sha256 == hashlib.sha256(b"begin la di da end").hexdigest()


def test_find(spark):
    df = spark.createDataFrame([(1, "so so so so so so far"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.text) for r in runs.find(df).collect()}
    assert got == {1: ([(0, 6, 1)], "so far"), 2: ([], "")}
