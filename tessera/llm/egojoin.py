"""Embedding near-duplicates by an epsilon grid order join.

Equal vectors of a label are one node with a count from the start (told apart
by 128 bits of hash), so a vector that is copied however often is compared
once. Nodes are taken to the unit sphere, where cosine >= c means a distance of
at most eps = sqrt(2 - 2c), and are projected on the leading principal
directions of all vectors. They are sorted by label and by the cells (of width
eps) of these projections, the epsilon grid order; the sequence is cut into
blocks of bounded size. Two blocks of a label are joined only if the boxes
around their projections come within eps of each other, which they find by the
cells of the leading ``KEYS`` directions. The join of two sequences halves
the longer one again and again, skips pairs of intervals whose boxes are
farther apart than eps, and compares what is left by matrix products in double
precision. A pair of blocks gives a count for each node and at most one
connecting link for each, so a group of near copies never becomes all its pairs.

Vectors are kept in the type they come in and compared in double precision.

Defined results: a vector that is null, empty, zero, or with null or non-finite
components links with nothing, like any vector whose label is null; vectors of
different lengths do not link; a row with a null id links like any other, but
has no component of its own to name: it gets the smallest id it reaches, or
null, and is never kept. Repeated rows are vectors of their own. An empty table
gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, connected_components, table

#: Rows of a block; intervals this short are compared by a matrix product; principal directions.
BLOCK, LEAF, DIRECTIONS = 1024, 128, 6
#: Leading directions whose cells bring blocks together.
KEYS = 3
#: Room for rounding in bounds, and around the threshold, where a pair is measured again on its own.
SLACK, CLOSE = 1e-6, 1e-9


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, vec array<float> or array<double>, label, ok): ok where the vector can be compared.
    Vectors of different lengths are never compared, as their label is extended by the length."""
    v = F.col("vec")
    kind = "array<float>" if df.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    ok = F.col("vec").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    cols = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"), label.alias("label"))
    return cols.withColumn("ok", F.coalesce(ok & F.col("label").isNotNull(), F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from a list column, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal(good: DataFrame, dim: int, directions: int) -> np.ndarray:
    """Leading principal directions (columns) of all unit vectors of length ``dim``; sums only reach the driver."""

    def work(batches):
        s, n = np.zeros((dim + 1, dim)), 0
        for b in batches:
            x = unit(matrix(b.column(0)))
            s[:dim] += x.T @ x
            s[dim] += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(s.size)]), pa.array(np.r_[float(n), s.ravel()])], names=["cell", "v"])

    got = {r.cell: r.v for r in good.select("vec").mapInArrow(work, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    n = got.get(-1, 0.0)
    if n < 1:
        return np.eye(dim)[:, :directions]
    s = np.array([got[i] for i in range((dim + 1) * dim)]).reshape(dim + 1, dim)
    mean = s[dim] / n
    _, vectors = np.linalg.eigh(s[:dim] / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, :directions]


# --- blocks --------------------------------------------------------------------

_BLOCK_SQL = "label string, block bigint, dim int, vecs binary, counts binary, nodes binary, low array<double>, high array<double>"
_BLOCK = pa.schema([
    ("label", pa.string()), ("block", pa.int64()), ("dim", pa.int32()), ("vecs", pa.binary()), ("counts", pa.binary()), ("nodes", pa.binary()),
    ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
])


def _cut(basis_of: dict[int, np.ndarray], single: bool):
    """Over nodes (label, node, n, vec) in grid order: blocks of them."""

    def make(label: str, held: list, block: int) -> pa.RecordBatch:
        nodes, n, x = (np.concatenate(c) for c in zip(*held, strict=True))
        p = unit(x) @ basis_of[x.shape[1]]
        row = {
            "label": label, "block": block, "dim": x.shape[1], "vecs": x.astype("<f4" if single else "<f8").tobytes(), "counts": n.astype("<i8").tobytes(),
            "nodes": nodes.astype("<i8").tobytes(), "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    def work(batches):
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        label, held, size = None, [], 0
        for b in batches:
            labels = b.column(0).to_pylist()
            nodes, n = (b.column(i).to_numpy() for i in (1, 2))
            ends = [k for k in range(1, len(labels)) if labels[k] != labels[k - 1]] + [len(labels)]
            at = 0
            for end in ends if labels else []:
                while at < end:
                    if size and (labels[at] != label or size >= BLOCK):
                        yield make(label, held, (task << 32) + serial)
                        serial, held, size = serial + 1, [], 0
                    to = min(end, at + BLOCK - size)
                    label = labels[at]
                    held.append((nodes[at:to], n[at:to], matrix(b.column(3).slice(at, to - at))))
                    size, at = size + to - at, to
        if size:
            yield make(label, held, (task << 32) + serial)

    return work


# --- the join ------------------------------------------------------------------


class _Tree:
    """Boxes over halves of a block's sequence, made as they are asked for."""

    def __init__(self, p: np.ndarray):
        self.p, self.boxes = p, {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = (self.p[a:b].min(axis=0), self.p[a:b].max(axis=0))
        return self.boxes[a, b]


def gap(low1, high1, low2, high2) -> float:
    """Squared distance of two boxes."""
    d = np.maximum(0.0, np.maximum(low1 - high2, low2 - high1))
    return float(d @ d)


def join_intervals(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, cosine: float):
    """Yields (rows of x, rows of y) arrays of linked entries; y None: of x with itself, each pair once."""
    px, same = _Tree(x @ basis), y is None
    py, other = (px, x) if same else (_Tree(y @ basis), y)
    eps2 = (np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK) ** 2
    todo = [(0, len(x), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        if gap(*px.box(a, b), *py.box(c, d)) > eps2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            s = x[a:b] @ other[c:d].T
            for i, j in zip(*np.nonzero(np.abs(s - cosine) < CLOSE), strict=True):
                s[i, j] = float(np.dot(x[a + i], other[c + j]))
            near = s >= cosine
            if same and a == c:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield i + a, j + c
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _spanning(n: int, pairs) -> np.ndarray:
    """Row pairs that join what ``pairs`` join, at most n - 1 of them."""
    mark, out = np.arange(n), []
    for i, j in pairs:
        while True:
            apart = np.flatnonzero(mark[i] != mark[j])
            if not len(apart):
                break
            # One link for each group that meets a smaller one, then the marks go down.
            lo, hi = np.minimum(mark[i[apart]], mark[j[apart]]), np.maximum(mark[i[apart]], mark[j[apart]])
            order = np.lexsort((lo, hi))
            hi_u, k = np.unique(hi[order], return_index=True)
            pick = apart[order[k]]
            out.append(np.stack([i[pick], j[pick]]))
            to = np.arange(n)
            to[hi_u] = lo[order[k]]
            while (to[to] != to).any():
                to = to[to]
            mark = to[mark]
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)


_OUT_SQL = "node bigint, links bigint, node2 bigint"


def _joined(basis_of: dict[int, np.ndarray], cosine: float, single: bool):
    """Over pairs of blocks: links counted for each node, and connecting links."""

    def load(row: dict, k: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(row["vecs" + k], dtype="<f4" if single else "<f8").astype(np.float64).reshape(-1, row["dim"])
        return unit(x), np.frombuffer(row["counts" + k], dtype="<i8"), np.frombuffer(row["nodes" + k], dtype="<i8")

    def work(batches):
        for b in batches:
            for row in b.to_pylist():
                same = row["block"] == row["block2"]
                x, nx, nodes = load(row, "")
                y, ny = None, nx
                if not same:
                    y, ny, more = load(row, "2")
                    nodes = np.concatenate([nodes, more])
                shift = 0 if same else len(x)
                links, pairs = np.zeros(len(nodes), dtype=np.int64), []
                for i, j in join_intervals(x, y, basis_of[row["dim"]], cosine):
                    np.add.at(links, i, ny[j])
                    np.add.at(links, j + shift, nx[i])
                    pairs.append((i, j + shift))
                k = np.flatnonzero(links)
                span = _spanning(len(links), pairs)
                cols = [
                    pa.array(np.concatenate([nodes[k], nodes[span[0]]])), pa.concat_arrays([pa.array(links[k]), pa.nulls(span.shape[1], pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(k), pa.int64()), pa.array(nodes[span[1]])]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "links", "node2"])

    return work


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98, directions: int = DIRECTIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "ego")
    given = usable(df, id_col, vec_col, label_col).withColumn("label", F.concat_ws(":", F.size("vec").cast("string"), "label"))
    given = given.select("vec_id", "label", "ok", F.when(F.col("ok"), F.col("vec")).alias("vec"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"))
    single = given.schema["vec"].dataType.simpleString() == "array<float>"
    rows = scratch.put("rows", given.drop("vec"))
    # Nodes; their numbers are written, so they stay whatever is run again.
    key = ["label", "h1", "h2"]
    distinct = given.where("ok").groupBy(*key).agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    distinct = scratch.put("distinct", distinct.withColumn("node", F.monotonically_increasing_id()))
    dims = [r.d for r in distinct.select(F.size("vec").alias("d")).distinct().collect()]
    basis_of = {d: principal(distinct.where(F.size("vec") == d), d, min(d, directions)) for d in dims}
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) or SLACK

    def keyed(batches):
        for b in batches:
            lengths = np.diff(b.column(3).offsets.to_numpy())
            for d in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == d)))
                cells = np.floor(unit(matrix(part.column(3))) @ basis_of[int(d)] / eps).astype(np.int64)
                cells = np.pad(cells, ((0, 0), (0, directions - cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in cells.T]], names=[*part.schema.names, *cell_names])

    cell_names = [f"c{i}" for i in range(directions)]
    vec_type = distinct.schema["vec"].dataType.simpleString()
    grid = distinct.select("label", "node", "n", "vec").mapInArrow(keyed, f"label string, node bigint, n bigint, vec {vec_type}, " + ", ".join(f"{c} bigint" for c in cell_names))
    order = ["label", *cell_names, "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = grid.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = scratch.put("blocks", dealt.select("label", "node", "n", "vec").mapInArrow(_cut(basis_of, single), _BLOCK_SQL))
    out = scratch.put("out", _met(blocks, basis_of, eps, cosine, single, min([KEYS, directions, *dims])))

    told = distinct.select("node", *key, "n", "least")
    counts = out.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    edges = out.where("links is null").select(F.col("node").alias("u"), F.col("node2").alias("v"))
    comp = scratch.put("components", connected_components(edges, scratch))
    least = comp.join(told.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("c"))
    of_node = comp.join(least, "component").select("node", "c")
    told = told.join(counts, "node", "left").join(of_node, "node", "left").where("n > 1 or links is not null")
    told = scratch.put("told", told.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("c")).alias("c")))
    scratch.drop("distinct", "blocks", "out")
    # Only nodes of several rows, or with links, are told; both inputs of the join are scans.
    out = rows.where("ok").join(told, key, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("c")).alias("component_id"))
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _met(blocks: DataFrame, basis_of: dict[int, np.ndarray], eps: float, cosine: float, single: bool, keys: int) -> DataFrame:
    """What pairs of blocks give whose boxes come within eps: an equi-join on label and the cells of the leading
    directions that a block's box covers, on one side widened by one, then the boxes themselves."""

    def cells(side: str, k: int) -> Column:
        return F.floor(F.element_at(side, k + 1) / eps).cast("bigint")

    heads = blocks.select("label", "block", "low", "high")
    left, right = heads, heads.select("label", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    for k in range(keys):
        left = left.withColumn(f"first{k}", cells("low", k) - 1).withColumn(f"k{k}", F.explode(F.sequence(cells("low", k) - 1, cells("high", k) + 1)))
        right = right.withColumn(f"other{k}", cells("low2", k)).withColumn(f"k{k}", F.explode(F.sequence(cells("low2", k), cells("high2", k))))
    apart = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))),
        F.lit(0.0), lambda s, d: s + d * d,
    )
    near = left.join(right, ["label", *[f"k{k}" for k in range(keys)]]).where((F.col("block") <= F.col("block2")) & (apart <= (eps + SLACK) ** 2))
    for k in range(keys):  # two boxes may share many cells: the least of them counts
        near = near.where(F.col(f"k{k}") == F.greatest(f"first{k}", f"other{k}"))
    payload = blocks.select("block", "dim", "vecs", "counts", "nodes")
    pairs = near.select("block", "block2")
    meet = pairs.join(payload, "block").join(payload.drop("dim").toDF("block2", "vecs2", "counts2", "nodes2"), "block2")
    return meet.mapInArrow(_joined(basis_of, cosine, single), _OUT_SQL)


def op2_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same rows in SQL: all pairs of a label, then links followed to the smallest id. Vectors that do not
#: take part are filtered as ``usable`` does.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, (SELECT min(r) FROM reach WHERE reach.vec_id = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(r) FROM reach WHERE reach.vec_id = v.vec_id) AS kept FROM v
"""
