"""Removal of repeated strings against a count of every window."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffixes


def plain(texts, size):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + size] for t in data for i in range(len(t) - size + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def compare(spark, rows, size):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, sha string, n_bytes int")
    got = sorted(map(tuple, suffixes.removal(df, size=size).collect()), key=str)
    want = [(i, n, r, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, r, s, k) in zip(rows, plain([t for _, t in rows], size))]
    assert got == sorted(want, key=str)
    return got


def corpus(seed=0):
    """Random texts with shared passages of many lengths, copies, periods, nulls and repeats."""
    r = np.random.default_rng(seed)
    word = lambda n: " ".join("".join(chr(97 + c) for c in r.integers(0, 20, r.integers(1, 8))) for _ in range(n))
    shared = [word(k) for k in (3, 8, 15, 40, 80)]
    rows = []
    for i in range(150):
        parts = [word(int(r.integers(1, 40)))]
        for _ in range(int(r.integers(0, 3))):
            parts += [shared[int(r.integers(5))], word(int(r.integers(1, 30)))]
        rows.append((i, " ".join(parts)))
    copy = word(60)
    rows += [(200 + i, copy) for i in range(20)] + [(300 + i, f"{word(2)} {copy[: 30 + i]}|{copy[30 + i :]}") for i in range(30)]
    rows += [(400, None), (401, ""), (402, "a" * 3000), (403, "ab" * 900 + "c"), (404, "é" * 500), (405, "x" + "a" * 199), (None, copy), (None, None), (406, word(300)), (406, word(300))]
    return rows


@pytest.mark.parametrize("size", [200, 40, 7])
def test_equals_plain(spark, size):
    got = compare(spark, corpus(), size)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("most,windows,at_once", [(1, 100, 1 << 20), (3, 1 << 17, 700), (1, 1, 250)])
def test_hot_hashes_and_pieces(spark, monkeypatch, most, windows, at_once):
    """Hashes with many stretches are dealt out by longer ones; texts are read in pieces; arrays hold few windows."""
    monkeypatch.setattr(suffixes, "MOST", most)
    monkeypatch.setattr(suffixes, "_WINDOWS", windows)
    monkeypatch.setattr(suffixes, "_BYTES", at_once)
    compare(spark, corpus(1), 60)


def test_small_tables(spark):
    compare(spark, [(1, "z" * 200)], 200)
    compare(spark, [(1, "z" * 201)], 200)
    compare(spark, [(1, None), (1, None)], 200)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffixes.removal(empty).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=60), min_size=1, max_size=5))
def test_two_stage_order(texts):
    """The wanted suffixes come in the order of the whole string, and their common prefixes are right."""
    pieces = [t.encode() for t in texts]
    whole, wanted = b"".join(pieces), []
    for p in pieces:
        wanted += [True] * (len(p) - 3) + [False] * 3
    array = suffixes.TwoStage(whole, np.array(wanted), 4)
    order = array.order.tolist()
    assert sorted(order) == [i for i, w in enumerate(wanted) if w]
    heads = [whole[i : i + 4] for i in order]
    assert heads == sorted(heads)
    assert array.common().tolist() == [next((k for k in range(4) if a[k] != b[k]), 4) for a, b in zip(heads, heads[1:])]
    seen = Counter(p[i : i + 4] for p in pieces for i in range(len(p) - 3))
    assert [f.tolist() for f in suffixes.repeated(pieces, 4)] == [[seen[p[i : i + 4]] > 1 for i in range(len(p) - 3)] for p in pieces]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=80), min_size=1, max_size=4), st.sampled_from([3, 8, 20]))
def test_windows_belong_to_one_anchor(texts, size):
    data = [t.encode() for t in texts]
    for k in suffixes._levels(size):
        first, count, h = suffixes.anchors(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(t) for t in data]), k, size)
        own, at = {}, 0
        for a, n, x in zip(first.tolist(), count.tolist(), h.tolist()):
            own |= {i: x for i in range(a, a + n)}
        by_string = {}
        for t in data:
            for i in range(len(t) - size + 1):
                assert by_string.setdefault(t[i : i + size], own.pop(at + i)) is not None
                # equal windows have the same hash
            at += len(t)
        assert not own


def test_deduplicated(spark):
    rows = [(1, "p" * 30 + "0123456789" * 3 + "q"), (2, "0123456789" * 3), (3, "alone"), (4, None)]
    df = spark.createDataFrame([(*r, "s", "k") for r in rows], "doc_id bigint, body string, spans string, kept string")
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in suffixes.deduplicated(df, "body", 25).collect()}
    want = plain([t for _, t in rows], 25)
    assert {i: k for i, (k, _) in got.items()} == {i: w[3] for (i, _), w in zip(rows, want)}
    assert {i: len(s) for i, (_, s) in got.items()} == {i: w[2] for (i, _), w in zip(rows, want)}
