"""Exact links between sets of hashes by prefix filtering, beyond links that are known already.

Two sets link if their Jaccard similarity is ``least`` or more. What is known is
a group for each set (the component that a search by fingerprints found); only
links between different groups are looked for, so copies and near copies that
are joined already cost next to nothing. No step leaves a link out:

1. A set of s hashes shares at least a = ceil(least * s) of them with a partner.
   In one global order two partners share their first ``spare`` common hashes
   within their first s - a + spare, the head. Heads are range-sorted by hash; a
   hash whose sets are all of one group counts for nothing, and a set with
   fewer counting hashes than its least partner would share is done.
2. The others bring all their hashes, counted likewise: a set needs a of them.
   Of the sets left the first s - a + 1 hashes are entries.
3. Sets of one entry's hash meet, in cells of bounded size where there are many.
   A pair goes on if sizes, places of the hash and bitmaps allow it: the
   parities of hashes by residue differ in no more places than the sets do.
4. The pairs left are decided by their hashes.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Rows of a hash that meet in one cell; words of a bitmap; parts in which the hashes of more than FEW sets are counted.
CELL, MAP64, SLICES, FEW = 2048, 8, 4, 20_000
_MAPS = [f"m{k}" for k in range(MAP64)]
_ENTRY = "token bigint, key bigint, grp bigint, size bigint, place bigint" + "".join(f", {c} bigint" for c in _MAPS)


def fewest(size: int, least: float) -> int:
    """Hashes that a set of this size shares with any partner, at least."""
    return ceil(least * size - 1e-6)


def spare(size: int, least: float) -> int:
    return min(1 + size // 16, fewest(size, least))


def head(found: np.ndarray, least: float) -> tuple[bytes, int]:
    """The first hashes of a sorted set, and how many of them it shares with the head of any partner."""
    a = fewest(len(found), least)
    return found[: len(found) - a + spare(len(found), least)].tobytes(), max(1, spare(a, least))


def _spread(at: int, slices: int):
    """(token, grp, key) of each hash of (key, grp, hashes as bytes) that is in slice ``at``."""

    def work(batches):
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                key, grp = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                hashes = [np.frombuffer(x, dtype="<i8") for x in part.column(2).to_pylist()]
                n = np.array([len(x) for x in hashes])
                cols = [np.concatenate(hashes), grp.repeat(n), key.repeat(n)]
                mine = cols[0] % slices == at
                yield pa.RecordBatch.from_arrays([pa.array(c[mine]) for c in cols], names=["token", "grp", "key"])

    return work


def _counted(batches):
    """(key, n) over rows sorted by hash and group: how many hashes the set shares with other groups. The first and the
    last hash of a task may go on elsewhere and count as shared."""

    def told(keys: list[np.ndarray]):
        if keys and len(k := np.concatenate(keys)):
            key, n = np.unique(k, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    last, waiting, at_start = None, [], True  # the hash that may go on, with its first group; its sets while they are of one group
    for b in batches:
        if not b.num_rows:
            continue
        token, grp, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        ends, first, out = np.r_[starts[1:], len(token)], grp[starts], []
        goes_on = last is not None and last[0] == token[0]
        if goes_on:
            first[0] = last[1]
        elif last is not None:  # it ended with the batch before
            out, waiting, at_start = waiting if at_start else [], [], False
        mixed = first != grp[ends - 1]
        if len(starts) > 1 and at_start:
            mixed[0], at_start = True, False
        if mixed[0]:
            out, waiting = out + waiting, []
        elif len(starts) > 1:
            waiting = []
        out.append(key[: starts[-1]][mixed[:-1].repeat((ends - starts)[:-1])])
        (out if mixed[-1] else waiting).append(key[starts[-1] :])
        last = (token[-1], first[-1])
        yield from told(out)
    yield from told(waiting)


def shared(tokens, scratch: Scratch | None = None) -> DataFrame:
    """(key, n) of ``tokens(at, slices)``, (token, grp, key) of a slice of the hashes: see ``_counted``; n may be too high, never too
    low. With ``scratch`` the slices are counted one after the other, so that a part of all hashes is on disk at once."""

    def count(tokens: DataFrame) -> DataFrame:
        parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = tokens.repartitionByRange(parts, "token", "grp", "key").sortWithinPartitions("token", "grp", "key")
        return rows.mapInArrow(_counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))

    if scratch is None:
        return count(tokens(0, 1))
    each = [scratch.put(f"shared{k}", count(tokens(k, SLICES))) for k in range(SLICES)]
    return reduce(DataFrame.unionAll, each).groupBy("key").agg(F.sum("n").alias("n"))


def suspects(heads: DataFrame, needs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(key) of the sets that may have a partner in another group; heads (key, grp, head), needs (key, need)."""
    heads = heads.select("key", "grp", "head")
    n = shared(lambda at, slices: heads.mapInArrow(_spread(at, slices), "token bigint, grp bigint, key bigint"), scratch if needs.count() > FEW else None)
    return n.join(needs, "key").where("n >= need").select("key")


def _entries(least: float):
    """Of (key, grp, hashes in order): an entry for each hash of the prefix."""

    def work(batches):
        for b in batches:
            key, grp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for i in range(b.num_rows):
                own = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                bins = np.bincount((own.view(np.uint64) % np.uint64(64 * MAP64)).astype(np.int64), minlength=64 * MAP64)
                bitmap = np.packbits((bins & 1).astype(np.uint8), bitorder="little").view("<i8")
                n = len(own) - fewest(len(own), least) + 1
                same = [np.full(n, x, dtype=np.int64) for x in (key[i], grp[i], len(own))]
                cols = [own[:n], *same, np.arange(n), *[np.full(n, x) for x in bitmap]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "key", "grp", "size", "place", *_MAPS])

    return work


def _met(least: float):
    """Over entries sorted by (token, low, high), low and high being a cell's two shares: pairs that may link."""

    def pairs(c: list[np.ndarray], one: bool):
        """Of one cell; ``one``: both its shares are the same."""
        key, grp, size, place, share, *maps = c
        n, out = len(key), []
        step = max(1, (1 << 20) // n)
        left = size - place  # a pair's first common hash leaves so many at most
        for at in range(0, n - 1, step):
            i, j = slice(at, at + step), slice(at + 1, n)
            alpha = np.ceil(least / (1 + least) * (size[i, None] + size[j]) - 1e-6).astype(np.int64)
            ok = (grp[i, None] != grp[j]) & (np.minimum(left[i, None], left[j]) >= alpha)
            if not one:
                ok &= share[i, None] != share[j]
            a, b = np.nonzero(ok)
            a, b, alpha = a + at, b + at + 1, alpha[a, b]
            keep = a < b
            a, b, alpha = a[keep], b[keep], alpha[keep]
            differ = np.zeros(len(a), dtype=np.int64)
            for m in maps:
                differ += np.bitwise_count((m[a] ^ m[b]).view(np.uint64))
            keep = differ <= size[a] + size[b] - 2 * alpha
            out.append(np.stack([np.minimum(key[a[keep]], key[b[keep]]), np.maximum(key[a[keep]], key[b[keep]])]))
        return np.concatenate(out, axis=1)

    def work(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]
            starts = np.flatnonzero(new)
            yield from cells(cols, starts)
            held = [x[starts[-1] :].copy() for x in cols]  # the last cell may go on
        if held is not None:
            yield from cells(held, np.array([0, len(held[0])]))

    def cells(cols: list[np.ndarray], starts: np.ndarray):
        found = [pairs([x[s:e] for x in cols[3:]], bool(cols[1][s] == cols[2][s])) for s, e in zip(starts[:-1], starts[1:], strict=True) if e - s > 1]
        if found:
            u, v = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return work


def links(sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(u, v): every link between sets (key, grp, shingles) of different groups; shingles in the order of ``shingle_set``."""
    size = F.size("shingles")
    tokens = sets.select(F.explode("shingles").alias("token"), "grp", "key")
    n = shared(lambda at, slices: tokens.where(F.pmod("token", F.lit(slices)) == at), scratch if sets.count() > FEW else None)
    enough = n.join(sets.select("key", size.alias("size")), "key").where(F.col("n") >= F.ceil(least * F.col("size") - 1e-6))
    kept = scratch.put("kept", sets.join(scratch.put("enough", enough.select("key")), "key", "left_semi").select("key", "grp", "shingles"))
    rows = scratch.put("entries", kept.mapInArrow(_entries(least), _ENTRY))
    many = rows.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.count("*").alias("n")).where("a <> b")
    many = scratch.put("many", many.select("token", F.ceil(F.col("n") / CELL).alias("shares")))
    rows = rows.join(many, "token").withColumn("share", F.pmod(F.xxhash64("key", F.lit("share")), F.col("shares")).cast("bigint"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    rows = rows.select("token", F.least("share", "other").alias("low"), F.greatest("share", "other").alias("high"), "key", "grp", "size", "place", "share", *_MAPS)
    # A cell's shares have about CELL rows each, so a hash that many sets have lies in many cells.
    cells = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    pairs = scratch.put("met", cells.mapInArrow(_met(least), "u bigint, v bigint").distinct())
    a, b = (kept.select(F.col("key").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "uv")
    both = F.size(F.array_intersect("u_set", "v_set"))
    near = pairs.join(a, "u").join(b, "v").where(both + 1e-9 >= least * (F.size("u_set") + F.size("v_set") - both))
    near = scratch.put("further", near.select("u", "v"))
    scratch.drop("enough", "kept", "entries", "many", "met", *[f"shared{k}" for k in range(SLICES)])
    return near
