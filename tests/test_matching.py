"""First patterns by automata against a search of every pattern."""

import random

import pytest

from tessera.operators import matching, routing


def naive(path, patterns):
    if path is None:
        return None
    hits = [(a, b, m) for a, b, m, p in patterns if p is not None and p.replace("\\", "/") in path.replace("\\", "/")]
    return min(hits)[2] if hits else None


def rows(n, seed=0):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("ab/\\") for _ in range(k))
    return [(r.randrange(50), i, f"m{i}", word(r.randrange(1, 9))) for i in range(n)], [word(r.randrange(0, 40)) for _ in range(400)]


@pytest.mark.parametrize("n", [0, 1, 30, 2000])
@pytest.mark.parametrize("bound", [matching.AUTOMATON, 40])
def test_equals_search(spark, monkeypatch, n, bound):
    monkeypatch.setattr(matching, "AUTOMATON", max(bound, n * 2) if bound == 40 else bound)
    patterns, paths = rows(n)
    patterns += [(3, 3, "x", None)] if n else []
    paths += [None, "", "aa", "aa"]
    df = spark.createDataFrame(patterns, "module_ord int, path_ord int, module string, pattern string")
    got = {r.path: r.module for r in routing.by_pattern(spark.createDataFrame([(p,) for p in paths], "path string"), df).collect()}
    assert got == {p: m for p in set(paths) if (m := naive(p, patterns)) is not None}


def test_an_empty_pattern_is_everywhere(spark):
    df = spark.createDataFrame([(1, 0, "all", ""), (0, 0, "first", "b"), (2, 0, "last", "a")], "module_ord int, path_ord int, module string, pattern string")
    got = {r.path: r.module for r in routing.by_pattern(spark.createDataFrame([("a",), ("ab",), ("",), (None,)], "path string"), df).collect()}
    assert got == {"a": "all", "ab": "first", "": "all"}


def test_twenty_thousand_patterns(spark):
    patterns = [(i % 9, i, f"m{i}", f"/p{i}/" if i % 2 else f"p{i}") for i in range(20_000)]
    paths = [f"src/p{i * 7 % 25_000}/f{i}.java" for i in range(3000)]
    df = spark.createDataFrame(patterns, "module_ord int, path_ord int, module string, pattern string")
    got = {r.path: r.module for r in routing.by_pattern(spark.createDataFrame([(p,) for p in paths], "path string"), df).collect()}
    by_digits = {}  # the patterns that may be in a path: p and the beginnings of its number, with or without slashes
    for a, b, m, p in patterns:
        by_digits[p] = (a, b, m)
    for path in paths:
        number = path.split("/")[1][1:]
        hits = [by_digits[x] for x in [f"/p{number}/", *[f"p{number[:k]}" for k in range(1, len(number) + 1)]] if x in by_digits]
        assert got.get(path) == (min(hits)[2] if hits else None)


def test_patterns_that_hold_an_earlier_one_go():
    kept = dict((p, r) for p, r in matching.automaton([(0, "b"), (1, "abc"), (2, "c"), (3, "cd"), (4, "xy"), (5, "x")]).items())
    assert kept == {"b": 0, "c": 2, "xy": 4, "x": 5}


def test_patterns_past_an_automaton_stay_a_table(spark, monkeypatch):
    """More patterns than an automaton takes are neither collected nor dealt into automata; bytes and ends of texts are right."""
    monkeypatch.setattr(matching, "AUTOMATON", 50)
    monkeypatch.setattr(matching, "AT_ONCE", 30)
    monkeypatch.setattr(matching, "first_rank", None)
    patterns = [(i % 7, i, f"m{i}", p) for i, p in enumerate(["é", "aé", "日本", "本/", "x" * 40, "zz", "/z", "a", "b" * 9, "src/é/日", "\ufffd", "q\\q", *[f"p{k}" for k in range(30)]])]
    paths = ["é", "é/日本/z", "src/é/日本", "aéa", "x" * 39, "y" + "x" * 40, "z", "zzz", "b" * 8, "", "q/q", "q\\q", "日", "p1", "p12", "xp29p3", None, *[f"f{k}/p{k}" for k in range(60)]]
    for more in ([], [(2, 0, "all", "")]):
        df = spark.createDataFrame(patterns + more, "module_ord int, path_ord int, module string, pattern string")
        got = {r.path: r.module for r in routing.by_pattern(spark.createDataFrame([(p,) for p in paths], "path string"), df).collect()}
        assert got == {p: m for p in set(paths) if (m := naive(p, patterns + more)) is not None}
