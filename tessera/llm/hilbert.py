"""Approximate nearest neighbours by shifted space-filling curves.

Largest inner product: vectors are lengthened by one component so that all have
the greatest norm, and queries by a zero; then the largest product is the least
distance. Lengthened vectors are projected on random orthonormal directions,
scaled by their overall spread, shifted, quantised and numbered along a Hilbert
curve; each of ``CURVES`` curves has directions and a shift of its own. All
rows are range-partitioned by (curve, key) in Spark, and each query is ranked
exactly against the rows in the key windows around it; the windows of all
curves merge.

The windows give each query its ``k``-th best score so far, a bound. Completion
(``complete``, on by default): along the first curve the query set and all rows
are cut into blocks with a centre and a radius, and blocks of rows that follow
each other into groups. A block of queries meets a group, then the group's
blocks, only where the greatest product that centres and radii allow can reach
the bound of one of its queries. Blocks that do meet are ranked by matrix
products. So no neighbour is missed, on data with structure few blocks meet,
and on data without any, as uniform directions, all do: the query set against
all rows, in blocks, each row block travelling once a block of ``QUERIES``
queries. Without completion the result is that of the windows, which end where
a range partition ends.

Scores are inner products of the original vectors in double precision, summed
in one fixed order, so equal vectors have equal scores; ties go to smaller ids.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another length than a query's are not
compared with it. Rows are told apart, not ids: each row of a repeated id is a
candidate, also for another row of its own id, and each is a query if the id is
divisible (so a repeated id has several lists). A row without an id is never a
query but may be found, with a null vec_id; such rows come last among equals.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table
from tessera.llm.egojoin import matrix, usable
from tessera.operators import scan

CURVES, DIMS, LEVELS = 4, 8, 7
#: Rows before and after a query in key order; rows of a block, queries of a block, row blocks of a group, and into how
#: many slices the groups are dealt when they meet query blocks.
WINDOW, BLOCK, QUERIES, GROUP, SLICES = 128, 1024, 4096, 64, 64
#: Copies of a query block, among which the row blocks that it meets are dealt.
COPIES = 8
SEED, SLACK = 11, 1e-9


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert numbers of integer points [n, dims] with ``bits`` bits a coordinate, all points at once.

    Coordinates become the transposed index by undoing excess rotations from
    the highest bit down and a Gray code; its bits are then dealt out in turn.
    """
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The projections, shifts and scale of all curves for vectors of one length."""

    def __init__(self, dim: int, greatest: float, spread: float, curves: int = CURVES, dims: int = DIMS, bits: int = LEVELS):
        r = np.random.default_rng([SEED, dim])
        self.greatest, self.spread, self.bits = greatest, spread, bits
        d = min(dims, dim + 1)
        self.bases = [np.linalg.qr(r.normal(size=(dim + 1, dim + 1)))[0][:, :d] for _ in range(curves)]
        self.shifts = [r.random(d) * 0.5 for _ in range(curves)]

    def keys(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        """[curves, n] keys; ``query`` rows are lengthened by zero, the others to the greatest norm."""
        norm2 = np.einsum("ij,ij->i", x, x)
        more = np.where(query, 0.0, np.sqrt(np.maximum(0.0, self.greatest**2 - norm2)))
        long = np.concatenate([x, more[:, None]], axis=1)
        out = []
        for basis, shift in zip(self.bases, self.shifts, strict=True):
            y = 0.5 + 0.2 * (long @ basis) / self.spread  # most of it in 0..1
            y = np.clip((y + shift) / 1.5, 0, 1 - 1e-12)
            out.append(hilbert_keys(np.floor(y * (1 << self.bits)).astype(np.int64), self.bits))
        return np.stack(out)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in one order whatever the batch."""
    return (q * x).sum(axis=1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score first, then smaller id, an id once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def top(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None):
    """For each query (row of q, id own) its k best rows of x, as (query place, id, score) arrays;
    ``least``: scores below it need not be found."""
    out_q, out_i, out_s = [], [], []
    s = q @ x.T
    s[own[:, None] == ids[None, :]] = -np.inf
    if least is not None and np.isfinite(least).all():
        floor = least - SLACK * (1 + np.abs(least))
    else:
        m = min(k + 8, len(ids))
        floor = np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m] - SLACK * (1 + np.abs(s).max(axis=1, initial=0, where=np.isfinite(s)))
    rows, cols = np.nonzero(s >= floor[:, None])
    ok = np.isfinite(s[rows, cols])
    rows, cols = rows[ok], cols[ok]
    exact = products(q[rows], x[cols])
    starts = np.searchsorted(rows, np.arange(len(q) + 1))
    for r in np.unique(rows):
        a, b = starts[r], starts[r + 1]
        pick = best(ids[cols[a:b]], exact[a:b], k) + a
        out_q.append(np.full(len(pick), r))
        out_i.append(ids[cols[pick]])
        out_s.append(exact[pick])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


_FOUND_SQL = "query_id bigint, vec_id bigint, score double"


def _found(own: np.ndarray, got) -> pa.RecordBatch:
    q, i, s = got
    return pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])


def _windows(k: int):
    """Over rows (curve, query, vec_id, vec) in key order: each query against the rows around it."""

    def rank(curve, query, ids, x, begin: int, end: int):
        """Queries at begin..end-1 of these rows; chunks of one curve and one length of vector."""
        for a in range(begin, end, WINDOW):
            b = min(a + WINDOW, end)
            lo, hi = max(0, a - WINDOW), min(len(ids), b + WINDOW)
            here = np.flatnonzero(query[a:b]) + a
            rows = np.flatnonzero(~query[lo:hi]) + lo
            for c in np.unique(curve[here]):
                h, r = here[curve[here] == c], rows[curve[rows] == c]
                if len(h) and len(r):
                    yield _found(ids[h], top(x[h], ids[h], ids[r], x[r], k))

    def work(batches):
        held = None
        done = 0  # queries of the held rows before this place are ranked
        for b in batches:
            if not b.num_rows:
                continue
            new = (b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy(), matrix(b.column(3)))
            held = new if held is None else tuple(np.concatenate(v) for v in zip(held, new, strict=True))
            end = len(held[0]) - WINDOW
            if end > done:
                yield from rank(*held, done, end)
                cut = max(0, end - WINDOW)
                held, done = tuple(v[cut:] for v in held), end - cut
        if held is not None:
            yield from rank(*held, done, len(held[0]))

    return work


_BLOCK_SQL = "block bigint, query boolean, n int, ids binary, vecs binary, centre array<double>, radius double, norm double, least double, bounds binary"


def _blocks(single: bool):
    """Over rows (query, vec_id, vec, bound) in key order: packed blocks."""
    return lambda batches: _packed(batches, "<f4" if single else "<f8")


def _packed(batches, kind: str):
    from pyspark import TaskContext

    task, serial, held, size = TaskContext.get().partitionId(), 0, {True: [], False: []}, {True: QUERIES, False: BLOCK}

    def pack(query: bool):
        nonlocal serial
        parts = held[query]
        ids, x, bound = (np.concatenate([p[i] for p in parts]) for i in range(3))
        held[query] = []
        for a in range(0, len(ids), size[query]):
            i, v, t = (c[a : a + size[query]] for c in (ids, x, bound))
            centre = v.mean(axis=0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))
            serial += 1
            yield pa.RecordBatch.from_pylist([{
                "block": (task << 32) + serial, "query": query, "n": len(i), "ids": i.astype("<i8").tobytes(), "vecs": v.astype(kind).tobytes(), "centre": centre.tolist(),
                "radius": radius, "norm": float(np.sqrt((v * v).sum(axis=1).max())), "least": float(t.min()), "bounds": t.astype("<f8").tobytes(),
            }], schema=_BLOCK)

    for b in batches:
        query, ids, x, bound = b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1).to_numpy(), matrix(b.column(2)), b.column(3).to_numpy(zero_copy_only=False).astype(float)
        for side in (True, False):
            m = query == side
            if m.any():
                held[side].append((ids[m], x[m], bound[m]))
                if sum(len(p[0]) for p in held[side]) >= size[side]:
                    yield from pack(side)
    for side in (True, False):
        if held[side]:
            yield from pack(side)


_BLOCK = pa.schema([
    ("block", pa.int64()), ("query", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("centre", pa.list_(pa.float64())),
    ("radius", pa.float64()), ("norm", pa.float64()), ("least", pa.float64()), ("bounds", pa.binary()),
])


def _meet(k: int, single: bool):
    def work(batches):
        for b in batches:
            for row in b.to_pylist():
                own, ids, bounds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ids2"], "<i8"), np.frombuffer(row["bounds"], "<f8")
                q, x = (np.frombuffer(row[c], "<f4" if single else "<f8").astype(np.float64).reshape(len(i), -1) for c, i in (("vecs", own), ("vecs2", ids)))
                for a in range(0, len(own), 512):
                    yield _found(own[a : a + 512], top(q[a : a + 512], own[a : a + 512], ids, x, k, bounds[a : a + 512]))

    return work


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, hits): the k best of a query, an id once. Its input has at most k rows of a query from
    each window or block, and from blocks only those that reach the query's bound."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    hits = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    return once.groupBy("query_id").agg(F.slice(hits, 1, k).alias("hits"))


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", complete: bool = True, curves: int = CURVES) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "hilbert")
    good = usable(df, id_col, vec_col, None).where("ok").select("vec_id", "vec", F.monotonically_increasing_id().alias("_m"))
    # Rows are known by their number in the order of ids (null last), so each row of a repeated id is a row of its own.
    numbered = scan.numbered(good, [], [F.col("vec_id").asc_nulls_last(), F.col("vec"), F.col("_m")], "row")
    names = numbered.select("row", F.col("vec_id").alias("name"))
    rows = numbered.select(F.col("row").alias("vec_id"), "vec", F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("ask"))
    dims = [r.n for r in rows.select(F.size("vec").alias("n")).distinct().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for dim in dims:
        found = _search_one(scratch, rows.where(F.size("vec") == dim), dim, k, every, complete, curves, parts)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    hit = out.select("query_id", F.posexplode("hits").alias("pos", "hit"))
    found = hit.select(F.col("query_id").alias("q"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("x"), (-F.col("hit.minus")).alias("score"))
    asked, seen = names.select(F.col("row").alias("q"), F.col("name").alias("query_id")), names.select(F.col("row").alias("x"), F.col("name").alias("vec_id"))
    return found.join(asked, "q").join(seen, "x").select("query_id", "rank", "vec_id", "score")


def _length(c) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))


def _reach() -> Column:
    """The greatest product that two balls allow; the product of the norms bounds it too."""
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.least(dot + F.col("radius") * _length("centre2") + F.col("radius2") * _length("centre") + F.col("radius") * F.col("radius2"), F.col("norm") * F.col("norm2"))


def _search_one(scratch: Scratch, rows: DataFrame, dim: int, k: int, every: int, complete: bool, curves: int, parts: int) -> DataFrame:
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    vec_type = rows.schema["vec"].dataType.simpleString()
    single = vec_type == "array<float>"
    got = rows.select(square.alias("s")).agg(F.max("s"), F.avg("s"), F.count("*")).first()
    places = Curves(dim, float(np.sqrt(got[0])), float(np.sqrt(got[1] / dim)) or 1.0, curves)

    def keyed(batches):
        """Every row once a curve, queries twice: as a query and as a candidate."""
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, x, ask = part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                for query in (False, True):
                    m = np.flatnonzero(ask) if query else np.arange(len(ids))
                    keys = places.keys(x[m], np.full(len(m), query))
                    for c in range(curves):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(keys[c]), pa.array(np.full(len(m), query)), pa.array(ids[m]), part.column(1).take(pa.array(m))], names=["curve", "key", "query", "vec_id", "vec"])

    dealt = rows.select("vec_id", "vec", "ask").mapInArrow(keyed, f"curve int, key bigint, query boolean, vec_id bigint, vec {vec_type}")
    order = ["curve", "key", "vec_id", "query"]
    sorted_rows = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    near = scratch.put(f"near{dim}", _merged(sorted_rows.select("curve", "query", "vec_id", "vec").mapInArrow(_windows(k), _FOUND_SQL), k))
    if not complete:
        return near
    bound = F.when(F.size("hits") >= k, -F.element_at("hits", k)["minus"]).otherwise(F.lit(float("-inf")))
    one = dealt.where("curve = 0").join(near.select(F.col("query_id").alias("vec_id"), bound.alias("bound"), F.lit(True).alias("query")), ["vec_id", "query"], "left")
    one = one.select("key", "query", "vec_id", "vec", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    # Queries are dealt into few partitions, so that their blocks are full.
    few = math.ceil(got[2] / every / QUERIES)
    sides = [one.where(side).repartitionByRange(n, "key", "vec_id").sortWithinPartitions("key", "vec_id") for side, n in (("query", few), ("not query", parts))]
    packed = [d.select("query", "vec_id", "vec", "bound").mapInArrow(_blocks(single), _BLOCK_SQL) for d in sides]
    blocks = scratch.put(f"blocks{dim}", packed[0].unionAll(packed[1]))
    # What the bounds rule out goes before any vector moves. Groups of row blocks come first: a group's head is
    # copied once a slice of query blocks, then an equi-join.
    heads = blocks.select("block", "query", "centre", "radius", "norm", "least")
    q = heads.where("query").drop("query").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(SLICES)))
    x = heads.where("not query").select(F.col("block").alias("block2"), F.floor(F.col("block") / GROUP).alias("group"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"), F.col("norm").alias("norm2"))
    members = x.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("block2", "centre2", "radius2", "norm2"))).alias("m"))  # at most GROUP
    middle = F.get("m", 0)["centre2"]
    wide = F.array_max(F.transform("m", lambda v: _length(F.zip_with(v["centre2"], F.col("centre2"), lambda a, b: a - b)) + v["radius2"]))
    groups = members.withColumn("centre2", middle).select("group", "centre2", wide.alias("radius2"), F.array_max(F.transform("m", lambda v: v["norm2"])).alias("norm2"))
    groups = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)).cast("array<bigint>")))
    reached = _reach() >= F.col("least") - SLACK * (1 + F.abs("least"))
    some = q.join(groups, "slice").where(reached).select("block", "centre", "radius", "norm", "least", "group")
    pairs = scratch.put(f"pairs{dim}", some.join(x, "group").where(reached).select("block", "block2"))
    payload = blocks.where("not query").select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"))
    asked = blocks.where("query").select("block", "ids", "vecs", "bounds", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)).cast("array<bigint>")).alias("copy"))
    both = pairs.join(payload, "block2").withColumn("copy", F.pmod(F.xxhash64("block2"), F.lit(COPIES))).join(asked, ["block", "copy"])
    more = scratch.put(f"more{dim}", both.mapInArrow(_meet(k, single), _FOUND_SQL))
    scratch.drop(f"blocks{dim}", f"pairs{dim}")
    seen = near.select("query_id", F.explode("hits").alias("hit")).select("query_id", F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
    return _merged(seen.unionAll(more), k)


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


#: The same rows in SQL: every query against every row. Vectors that take no part are filtered as ``usable`` does. Products
#: are added as ``products`` does it for up to 128 components, a multiple of eight: every eighth, then these eight in pairs.
OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]) AS p FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
), t AS (
  SELECT r, query_id, vec_id, list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda j: list_reduce(p[j:len(p):8], lambda a, b: a + b)) AS p FROM s
), u AS (
  SELECT r, query_id, vec_id, ((p[1] + p[2]) + (p[3] + p[4])) + ((p[5] + p[6]) + (p[7] + p[8])) AS score FROM t
), w AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM u
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score FROM w WHERE rank <= 20
"""
