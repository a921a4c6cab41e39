"""Periodic runs of words, by the runs theorem.

The words of many texts form one integer sequence, each text closed by a symbol
that occurs once. For both orders of the alphabet the longest Lyndon word that
begins at a place ends where the inverse suffix array next takes a smaller
(larger, for the reversed order) value; each run has such a word as its root.
A root (i, j) is extended to the right by the longest common prefix of the
suffixes i and j, to the left by that of the reversed sequence: minima of the
adjacent common prefixes over a sparse table.

Rows are independent; tasks work on groups of texts of about a bounded number
of words, a longer text alone in its group (some 400 bytes of memory a word).

Defined results: a null text has no words; texts without a run have null
columns for the greatest run and the digest of nothing for the list. Words are
cut at space and U+0009 to U+000D and compared by their bytes. Of runs with
equal exponents the first, then the one of smaller period is the greatest. A
null id (whose crc32 is unknown) leaves the words of ``spread`` as they are.
Repeated rows give repeated results, an empty table gives an empty one; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

#: A run has at least LEAST words and EXPONENT periods. Words worked on at once.
LEAST, EXPONENT, _WORDS = 6, 4, 30_000


class Suffixes:
    """Suffix array, its inverse and adjacent common prefixes of an integer sequence that ends in a symbol of its own."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        # A rank is the number of suffixes that are smaller by the symbols looked at so far.
        values, of = np.unique(s, return_inverse=True)
        size = np.bincount(of, minlength=len(values))
        rank = (np.cumsum(size) - size)[of].astype(np.int32)
        open_ = np.flatnonzero(size[of] > 1)
        levels, width = [rank], 1
        while len(open_):  # doubling: only suffixes that share their rank are sorted on
            rank = rank.copy()
            open_ = self._refine(rank, open_, levels[-1], width)
            levels.append(rank)
            width *= 2
        self.inverse = rank
        self.array = np.empty(n, np.int32)
        self.array[rank] = np.arange(n, dtype=np.int32)
        self.lcp = self._adjacent(levels)
        self.minima = [self.lcp]
        while (1 << len(self.minima)) <= n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _refine(rank: np.ndarray, open_: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
        """Sets ``rank`` at the places ``open_`` by twice as many symbols; the places that still share a rank."""
        key = before[open_].astype(np.int64) << 32 | before[open_ + width]  # the closing symbol is unique, so no place is past the end
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        at = np.arange(len(key))
        new_key, new_rank = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_rank[1:] = key[1:] >> 32 != key[:-1] >> 32
        start = np.maximum.accumulate(np.where(new_rank, at, 0))
        rank[open_] = (key >> 32) + (np.maximum.accumulate(np.where(new_key, at, 0)) - start)
        alone = new_key & np.append(new_key[1:], True)
        return open_[~alone]

    def _adjacent(self, levels: list[np.ndarray]) -> np.ndarray:
        """lcp[k]: symbols that the suffixes of places k - 1 and k share; lcp[0] = 0."""
        a, b = self.array[:-1].copy(), self.array[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][a] == levels[k][b]).astype(np.int32) << k
            a += same
            b += same
        return np.concatenate([np.zeros(1, np.int32), a - self.array[:-1]])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes i and j (i != j) share."""
        x, y = self.inverse[i].astype(np.int64), self.inverse[j].astype(np.int64)
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for level in np.unique(k):
            m = k == level
            t = self.minima[level]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << int(level)) + 1])
        return out


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the next place with a smaller value (length where there is none), by a sparse table of minima."""
    n = len(v)
    tables = [v]
    while (1 << len(tables)) <= n:
        last, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[:-half], last[half:]))
    at = np.arange(n, dtype=np.int64) + 1
    for k in range(len(tables) - 1, -1, -1):
        t = tables[k]
        live = np.flatnonzero(at + (1 << k) <= n)
        skip = live[t[at[live]] >= v[live]]
        at[skip] += 1 << k
    return at


def runs(s: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period), sorted by start and period, of the maximal runs of ``s`` whose length is at least
    ``least`` and ``exponent`` (2 or more) periods. ``s``: integers, the last of which occurs once."""
    n = len(s)
    none = np.zeros((0, 3), np.int64)
    if n < 2:
        return none
    forward = Suffixes(s)
    i = np.arange(n, dtype=np.int64)
    ends = [next_smaller(forward.inverse), next_smaller(-forward.inverse)]
    i, j = np.concatenate([i, i]), np.concatenate(ends)
    i, j = i[j < n], j[j < n]
    same = s[i] == s[j]  # else nothing to extend
    i, j = i[same], j[same]
    right = forward.common(i, j)
    # The first root of a run begins within its first period, so it meets exponent - 2 more periods on the right.
    keep = right > (exponent - 2) * (j - i)
    i, j, right = i[keep], j[keep], right[keep]
    if not len(i):
        return none
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    if len(inner):
        # Reversed, place x is n - 1 - x; a symbol of its own closes it.
        backward = Suffixes(np.concatenate([s[::-1], [s.max() + 1]]))
        left[inner] = backward.common(n - i[inner], n - j[inner])
    period = j - i
    found = np.unique(np.stack([i - left, right + left + period, period], axis=1), axis=0)
    long_enough = (found[:, 1] >= least) & (found[:, 1] >= exponent * found[:, 2])
    found = found[long_enough]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def spread(words: list, doc_id: int | None) -> list:
    """The words with a repeated tail for every id whose crc32 ends in 0: word i >= a becomes word a + (i - a) % p."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def runs_of_texts(texts: list[list]) -> list[np.ndarray]:
    """For each list of words its runs, all in one sequence."""
    ids: defaultdict = defaultdict(itertools.count().__next__)
    sequence = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in texts]
    closed = [x for k, s in enumerate(sequence) for x in (s, [len(ids) + k])]
    found = runs(np.concatenate(closed)) if closed else np.zeros((0, 3), np.int64)
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequence])]).astype(np.int64)
    cuts = np.searchsorted(found[:, 0], starts)
    return [found[a:b] - [starts[k], 0, 0] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def collapsed(words: list, found: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(found):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


def _report(words: list, found: np.ndarray) -> tuple:
    rows = found.tolist()
    best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rows else None
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    greatest = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return len(rows), *greatest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()


_SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _grouped(df: DataFrame, id_col: str, text_col: str, change, report, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """(id, report of each text): texts go in groups of about _WORDS words."""
    target = df.select(id_col, text_col)
    names = [id_col, *[c.split()[0] for c in schema.split(", ")]]

    def done(ids, texts):
        rows = [report(w, r) for w, r in zip(texts, runs_of_texts(texts), strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks(), *map(pa.array, columns, kinds)], names=names)

    def work(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            keys = b.column(0)
            for k in range(b.num_rows):
                words = change(words_of(b.column(1)[k].as_py()), keys[k].as_py())
                if texts and size + len(words) > _WORDS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(keys.slice(k, 1))
                texts.append(words)
                size += len(words)
        if texts:
            yield done(ids, texts)

    return target.mapInArrow(work, f"`{id_col}` {target.schema[0].dataType.simpleString()}, {schema}")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<start, length, period>>, text): all runs of each whole text, and the text's words without
    the repeats, joined by one space."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def report(words, found):
        text = b" ".join(collapsed(words, found)).decode("utf-8", "replace")
        return [dict(zip(("start", "length", "period"), r)) for r in found.tolist()], text

    return _grouped(df, id_col, text_col, lambda w, _: w, report, "runs array<struct<start:bigint,length:bigint,period:bigint>>, text string", [pa.list_(kind), pa.string()])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest columns of the runs of each text after ``spread``."""
    return _grouped(df, id_col, text_col, spread, _report, _SCHEMA, [pa.int64()] * 5 + [pa.string()] * 2)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
