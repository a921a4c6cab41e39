"""Vector code compression: product quantisation with an exact partial-distance search.

Components become integers floor(4096 * x). Vectors are cut into equal parts;
each part position has a codebook of up to 16 integer entries. An assignment
goes through the entries in order, keeping each row's best complete distance;
dimensions are added in descending variance of the codebook, and a row leaves
an entry's mask once its accumulated integer distance strictly exceeds its
best. Ties so go to the lower index and every distance is exact.

Spark shares out the rows: each round is one pass over the integers, each task
sums what it assigned (one row a part and entry), and the driver sees parts x
entries sums, whatever the number of vectors. The codebooks travel with the
next round's tasks; their size is fixed by the dimension.

Defined results: rows whose vector is null or holds a null or non-finite
component are left out; an empty table gives an empty result. Rows that repeat
an id each count and each get a row. The starting entries are the 16 smallest
by (vec_id, vector), rows without an id last; with fewer rows there are fewer
entries. Empty vectors have codes of zeros. Vectors must have one length, divisible by the number of parts, and
components below 2**15 in size (their squares fill 64 bits); otherwise an error
says so. Columns other than the id, vector and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_LARGEST, _ROWS = 2**27, 4_000


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v array<bigint>): the rows that take part, floor(scale * x) of each component."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(x.isNotNull() & ~F.coalesce(bad, F.lit(False)), scaled).alias("v"))
    return rows.where("v is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x components; ``column`` has no nulls and vectors of one length."""
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(values) else np.zeros((len(column), 0), np.int64)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of its nearest entry and the squared distance, both int64.

    Dimensions go in descending variance of the codebook (times its size squared, so in integers;
    ties by position). Rows that an entry can no longer win leave its mask between dimensions."""
    k = len(book)
    spread = [k * sum(c * c for c in col) - sum(col) ** 2 for col in map(list, book.T.tolist())]
    order = sorted(range(len(spread)), key=lambda d: (-spread[d], d))
    best, code = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    columns = np.ascontiguousarray(x.T)
    for e in range(k):
        alive, so_far, limit = np.arange(len(x)), np.zeros(len(x), np.int64), best
        for d in order:
            gap = columns[d][alive] - book[e, d]
            so_far = so_far + gap * gap
            stays = so_far <= limit
            if not stays.all():
                alive, so_far, limit = alive[stays], so_far[stays], limit[stays]
        won = so_far < limit
        best[alive[won]], code[alive[won]] = so_far[won], e
    return code, best


def _assign(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes rows x parts, errors rows)."""
    width = books[0].shape[1]
    found = [nearest_entries(v[:, j * width : (j + 1) * width], b) for j, b in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), sum(d for _, d in found)


def _summed(books: list[np.ndarray]):
    """Each task's counts and component sums of every part and entry, as one row each."""

    def work(batches):
        parts, (k, width) = len(books), books[0].shape
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                v = _matrix(b.slice(at, _ROWS).column(0))
                codes, _ = _assign(v, books)
                for j in range(parts):
                    own = v[:, j * width : (j + 1) * width]
                    part = np.zeros((k, width), np.int64)
                    np.add.at(part, codes[:, j], own)
                    total[j] += part
                    count[j] += np.bincount(codes[:, j], minlength=k)
        at = np.argwhere(count)
        text = [[str(s) for s in total[j, e]] for j, e in at]
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0], pa.int64()), pa.array(text, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return work


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """The codebooks (entries x width, int64) of each part position, or None without rows. ``rows``: see ``integers``."""
    shape = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("top")).first()
    if shape.lo is None:
        return None
    if shape.lo != shape.hi or shape.lo % parts:
        raise ValueError(f"vectors must have one length that {parts} divides; lengths are {shape.lo} to {shape.hi}")
    if (shape.top or 0) >= _LARGEST:
        raise ValueError("a component is too large for 64-bit distances")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = shape.lo // parts
    start = np.array([r.v for r in first], np.int64).reshape(len(first), shape.lo)
    books = [start[:, j * width : (j + 1) * width].copy() for j in range(parts)]
    for _ in range(rounds):
        each = rows.select("v").mapInArrow(_summed(books), "part int, entry int, n bigint, sums array<string>")
        cells = each.select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
        cells = cells.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        for c in cells.collect():  # parts x entries x width cells
            books[c.part][c.entry, c.place] = int(c.s) // c.n
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, squared distances summed over parts."""
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                codes, error = _assign(_matrix(part.column(2)), books)
                digits = codes.astype(np.uint8).tobytes().hex()
                n = 2 * len(books)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([digits[i * n : (i + 1) * n] for i in range(len(codes))], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(work, f"vec_id {id_kind}, label {label_kind}, code string, error bigint")


def decode(code: str, books: list[np.ndarray]) -> list[int]:
    """The integer vector that a code stands for."""
    return [int(c) for e, b in zip(bytes.fromhex(code), books, strict=True) for c in b[e]]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all decimal components by part, entry, place."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row that takes part."""
    scratch = Scratch(df.sparkSession, "codes")
    rows = scratch.put("rows", integers(df, id_col, vec_col, label_col))
    books = train(rows, parts, entries, rounds)
    if books is None:
        books, coded = [], rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        coded = encode(rows, books)
    coded = scratch.put("coded", coded)
    scratch.drop("rows")
    sums = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round spelt out: all distances, the least of each part, floored means."""
    steps = ["""v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r, vec_id, label, e FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        "p AS (SELECT r, j, CAST(len(e) / 8 AS BIGINT) AS w, e[(j * (len(e) // 8) + 1):((j + 1) * (len(e) // 8))] AS x FROM v, range(8) t(j))",
        "b0 AS (SELECT j, r - 1 AS k, x AS c FROM p WHERE r <= 16)",
    ]
    for n in range(7):
        steps.append(f"""a{n} AS (
  SELECT r, j, x, k, d FROM (
    SELECT r, p.j, x, k, CAST(list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS BIGINT) AS d FROM p JOIN b{n} b ON p.j = b.j)
  QUALIFY row_number() OVER (PARTITION BY r, j ORDER BY d, k) = 1)""")
        if n < 6:
            steps.append(f"""b{n + 1} AS (
  SELECT b.j, b.k, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (
    SELECT j, k, list(c ORDER BY i) AS c FROM (
      SELECT j, k, i, CAST((s - ((s % n) + n) % n) / n AS BIGINT) AS c FROM (
        SELECT j, k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, range(1, 1 + (SELECT max(w) FROM p)) u(i) GROUP BY j, k, i))
    GROUP BY j, k) m ON b.j = m.j AND b.k = m.k)""")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM b6)")
    steps.append("o AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h
"""


OP12_SQL = _sql()
