"""The first of many patterns that a text contains, by an Aho-Corasick automaton, or by a join where there are too many for one.

An automaton walks a text once, whatever the number of patterns. Patterns that hold an earlier one within them can never be the
first, so they are left out. It goes to the executors by broadcast and has at most ``AUTOMATON`` characters of patterns.

More patterns stay a table. A sieve of their hashes, of bounded size, goes to the executors; the substrings of a text that have the
length of some pattern and that the sieve lets pass are joined with the patterns, which decides. The work on a text is its length
times the number of lengths, whatever the number of patterns."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton (some 50 bytes of memory each).
AUTOMATON = 4_000_000
#: A sieve's bits for each pattern, and its bits at most; bytes of texts walked at once.
SIEVE, SIEVE_MOST, AT_ONCE = 12, 1 << 28, 1 << 20
_STEP = np.uint64(0x100000001B3)


def automaton(patterns: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """``patterns``: (rank, not empty pattern), each pattern once. Those that contain a pattern of a smaller rank are dropped."""
    every = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for rank, pattern in patterns:
        every.add_word(pattern, rank)
    every.make_automaton()
    few = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for rank, pattern in patterns:
        if all(other >= rank for _, other in every.iter(pattern)):
            few.add_word(pattern, rank)
    few.make_automaton()
    return few


def first_rank(texts: DataFrame, text: str, patterns: list[tuple[int, str]], name: str) -> DataFrame:
    """Adds ``name`` int: the smallest rank of a pattern that the text contains, null where there is none. ``patterns``: as for
    ``automaton``."""
    shared = texts.sparkSession.sparkContext.broadcast(patterns)

    @F.pandas_udf("int")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(shared.value)
        for batch in batches:
            yield pd.Series([min((rank for _, rank in found.iter(t)), default=None) if t else None for t in batch], dtype="Int32")

    return texts.withColumn(name, look(F.col(text)))


def _windows(data: list[bytes], lengths: set[int], whole: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row, start, hash) of the substrings of these lengths, all of a length at once; ``whole``: only of whole texts."""
    n = np.array([len(x) for x in data], dtype=np.int64)
    flat, first = np.frombuffer(b"".join(data), dtype=np.uint8), np.r_[0, np.cumsum(n)[:-1]]
    row = np.arange(len(n)) if whole else np.arange(len(n)).repeat(n)
    at = first if whole else np.arange(len(flat))
    left, h = (first + n)[row] - at, np.zeros(len(at), dtype=np.uint64)
    for length in range(1, max(lengths, default=0) + 1):
        if len(at) and left.min() < length:
            keep = left >= length
            row, at, left, h = row[keep], at[keep], left[keep], h[keep]
        if not len(at):
            return
        h = h * _STEP + flat[at + length - 1] + np.uint64(1)
        if length in lengths:
            some = left == length if whole else slice(None)
            yield length, row[some], (at - first[row])[some], h[some]


def _places(h: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of the sieve that a hash sets."""
    z = h + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (z & six) | one << (z >> np.uint64(6) & six) | one << (z >> np.uint64(12) & six)
    return (z >> np.uint64(18) & np.uint64(words - 1)).astype(np.int64), bits


def sieve(patterns: DataFrame, lengths: set[int], n: int) -> np.ndarray:
    """A Bloom filter of ``n`` patterns, a table of one column of strings of these lengths in bytes; at most SIEVE_MOST bits, 32 MB."""
    words = min(SIEVE_MOST, 1 << max(6, (SIEVE * n - 1).bit_length())) // 64

    def work(batches):
        for b in batches:
            for length, _, _, h in _windows([x.encode() for x in b.column(0).to_pylist()], lengths, whole=True):
                word, bits = _places(h, length, words)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = patterns.mapInArrow(work, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _candidates(texts: DataFrame, lengths: set[int], held: np.ndarray) -> DataFrame:
    """(text, part) of a table of one column of strings: the substrings of these lengths in bytes that the sieve lets pass."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def of(data: list[bytes]):
        held = shared.value
        for length, row, start, h in _windows(data, lengths):
            word, bits = _places(h, length, len(held))
            k = np.flatnonzero(held[word] & bits == bits)
            if len(k):
                rows, parts = row[k].tolist(), [data[i][s : s + length] for i, s in zip(row[k].tolist(), start[k].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([data[i].decode() for i in rows], pa.string()), pa.array(parts, pa.binary())], names=["text", "part"])

    def work(batches):
        for b in batches:
            data, size = [], 0
            for t in b.column(0).to_pylist():
                data.append(t.encode())
                size += len(data[-1])
                if size > AT_ONCE:
                    yield from of(data)
                    data, size = [], 0
            yield from of(data)

    return texts.mapInArrow(work, "text string, part binary")


def _joined(texts: DataFrame, text: str, firsts: DataFrame, lengths: dict[int, int], hit: Column, name: str) -> DataFrame:
    """As ``first_pattern``, of patterns (_p, _o) that may be too many for the driver; lengths in bytes with their number of patterns."""
    some = {n for n in lengths if n}
    own = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    parts = _candidates(own, some, sieve(firsts.where("_p <> ''").select("_p"), some, sum(lengths.values())))
    hits = parts.join(firsts.select(F.col("_p").cast("binary").alias("part"), hit.alias("_h")), "part").groupBy(F.col("text").alias(text)).agg(F.min("_h").alias("_h"))
    out, best = texts.join(hits, text, "left"), F.col("_h")
    if 0 in lengths:  # the empty pattern, one row
        out = out.join(F.broadcast(firsts.where("_p = ''").select(hit.alias("_e"))), F.col(text).isNotNull(), "left")
        best = F.least(best, "_e")
    return out.withColumn(name, best["v"]).select(*[c for c in texts.columns if c != name], name)


def first_pattern(texts: DataFrame, text: str, patterns: DataFrame, order: list[str], pattern: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the first pattern, by ``order`` (then by the pattern), that ``text`` contains, null where there is
    none. An empty pattern is in every text that is not null; null patterns and null texts match nothing."""
    firsts = patterns.where(F.col(pattern).isNotNull()).groupBy(F.col(pattern).alias("_p")).agg(F.min(F.struct(*order, F.col(value).alias("v"))).alias("_o"))
    hit = F.struct(*[F.col(f"_o.{c}").alias(f"k{i}") for i, c in enumerate(order)], F.col("_p").alias("p"), F.col("_o.v").alias("v"))
    sizes = firsts.groupBy(F.octet_length("_p").alias("bytes")).agg(F.count("*").alias("n"), F.sum(F.length("_p") + 1).alias("size")).collect()
    if sum(r["size"] for r in sizes) > AUTOMATON:
        return _joined(texts, text, firsts, {r.bytes: r.n for r in sizes}, hit, name)
    kind = patterns.schema[value].dataType.simpleString()
    rows = [r.h for r in firsts.select(hit.alias("h")).orderBy("h").collect()]
    if not rows:
        return texts.withColumn(name, F.lit(None).cast(kind)).select(*[c for c in texts.columns if c != name], name)
    out = first_rank(texts, text, [(k, r.p) for k, r in enumerate(rows) if r.p], "_r")
    empty = next((k for k, r in enumerate(rows) if not r.p), None)
    rank = F.col("_r") if empty is None else F.when(F.col(text).isNotNull(), F.least("_r", F.lit(empty)))
    # The value itself comes from the list of ranks, which is as bounded as the automaton.
    ranks = texts.sparkSession.createDataFrame([(k, r.v) for k, r in enumerate(rows)], f"_n int, _v {kind}")
    out = out.join(F.broadcast(ranks), rank == F.col("_n"), "left")
    return out.withColumn(name, F.col("_v")).select(*[c for c in texts.columns if c != name], name)
