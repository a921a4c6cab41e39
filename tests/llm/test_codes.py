"""Vector codes against a plain version in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tessera.llm import codes


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label); (vec_id, code, error, label_error, digest) of each, by the contract's words."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][j * w : (j + 1) * w] for r in first] for j in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for j, book in enumerate(books):
            own = [r[1][j * w : (j + 1) * w] for r in kept]
            at = [nearest(x, book)[0] for x in own]
            for k in set(at):
                mine = [x for x, a in zip(own, at) if a == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(r[1][j * w : (j + 1) * w], b) for j, b in enumerate(books)] for r in kept]
    errors = [sum(d for _, d in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for k, _ in f), e, sum(x for x, y in zip(errors, kept) if y[2] == r[2]), digest) for r, f, e in zip(kept, found, errors)]


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")


def rows_of(n, seed=0, dim=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 5] * 0.3 + r.normal(size=dim) * 0.05], int(i % 3)) for i in range(n)]


def compare(spark, rows, kind="float"):
    got = sorted(map(tuple, codes.compress(table(spark, rows, kind)).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    return got


@pytest.mark.parametrize("n", [1, 7, 16, 17, 300])
def test_equals_plain(spark, n):
    assert len(compare(spark, rows_of(n))) == n


def test_nulls_ties_and_repeats(spark):
    rows = rows_of(60, 3)
    rows += [rows[5], rows[5], (5, [0.25] * 16, None), (None, [0.5] * 16, 1), (None, [-0.5] * 16, None), (70, [0.0] * 16, None)]
    rows += [(71, None, 1), (72, [None] + [0.1] * 15, 1), (73, [float("nan")] + [0.1] * 15, 1), (74, [float("inf")] + [0.1] * 15, 1)]
    got = compare(spark, rows)
    assert len(got) == 66
    # Equal vectors only: every entry ties, index 0 wins; the others stay as they began.
    same = compare(spark, [(i, [0.1] * 8, None) for i in range(40)], "double")
    assert {c for _, c, *_ in same} == {"00" * 8}


def test_masks_drop_only_what_cannot_win():
    r = np.random.default_rng(1)
    for k, width in ((16, 8), (3, 1), (16, 5)):
        x, book = r.integers(-50, 50, (500, width)), r.integers(-50, 50, (k, width))
        code, error = codes.nearest_entries(x, book)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_empty_and_clashing_columns(spark):
    assert codes.compress(table(spark, [])).collect() == []
    assert codes.compress(table(spark, [(1, None, 2)])).collect() == []
    assert [tuple(r)[:4] for r in codes.compress(table(spark, [(1, [], 2), (2, [], 2)])).orderBy("vec_id").collect()] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    rows = rows_of(20)
    named = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, v string, error int")
    assert sorted(map(tuple, codes.compress(named).collect())) == sorted(plain(rows))


def test_lengths_and_sizes_are_checked(spark):
    with pytest.raises(ValueError, match="length"):
        codes.compress(table(spark, [(1, [0.1] * 8, 0), (2, [0.1] * 16, 0)]))
    with pytest.raises(ValueError, match="length"):
        codes.compress(table(spark, [(1, [0.1] * 9, 0)]))
    with pytest.raises(ValueError, match="large"):
        codes.compress(table(spark, [(1, [1e30] * 8, 0)]))


def test_decode(spark):
    rows = codes.integers(table(spark, rows_of(50)))
    books = codes.train(rows)
    for r in codes.encode(rows, books).join(rows, "vec_id").collect():
        assert sum((a - b) ** 2 for a, b in zip(codes.decode(r.code, books), r.v)) == r.error
