"""A ZIP archive of a table of documents, deflated on executors.

Each task deflates its documents and makes their local records. Where a record begins in the archive is the sum of the lengths of
those before it, in the order of paths; the central directory is made of these offsets. The driver only joins stored pieces, one
piece of bounded length at a time, so its memory does not grow with the archive. Records are in ZIP64 form where they need it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources.scratch import stored

#: Bytes of a stored piece; larger documents are several.
PIECE = 1 << 20
# The format's signatures, versions, flag for UTF-8 names, method and the time 1980-01-01.
LOCAL, CENTRAL, END64, LOCATOR, END = 0x04034B50, 0x02014B50, 0x06064B50, 0x07064B50, 0x06054B50
VERSION, UTF8, DEFLATE, TIME, DATE, MOST, MANY = 45, 0x800, 8, 0, 33, 0xFFFFFFFF, 0xFFFF


def _sizes(size: int, packed: int, offset: int | None = None) -> tuple[int, int, int, bytes]:
    """The 32-bit fields and the extra field that has those which do not fit."""
    wide = [v for v in (size, packed, offset) if v is not None and v >= MOST]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    return min(size, MOST), min(packed, MOST), min(offset or 0, MOST), extra


def local_record(name: bytes, crc: int, packed: int, size: int) -> bytes:
    if max(size, packed) >= MOST:  # a local record has both lengths or none
        return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATE, TIME, DATE, crc, MOST, MOST, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, size, packed)
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATE, TIME, DATE, crc, packed, size, len(name), 0) + name


def central_record(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    s, p, o, extra = _sizes(size, packed, offset)
    return struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, VERSION, VERSION, UTF8, DEFLATE, TIME, DATE, crc, p, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra


def end_records(entries: int, start: int, length: int) -> bytes:
    out = b""
    if entries >= MANY or max(start, length) >= MOST:
        out = struct.pack("<IQHHIIQQQQ", END64, 44, VERSION, VERSION, 0, 0, entries, entries, length, start) + struct.pack("<IIQI", LOCATOR, 0, start + length, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(entries, MANY), min(entries, MANY), min(length, MOST), min(start, MOST), 0)


def entries(documents: DataFrame, prefix: str = "") -> DataFrame:
    """(path, place, crc, packed, size, length, data): each document's local record in pieces of PIECE bytes, in order of ``place``;
    the first has the lengths. ``documents``: (path, content string or binary); null contents are empty, null paths an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw, name = content.as_py() or b"", (prefix + path).encode()
                if len(name) > MANY:
                    raise ValueError(f"a path of {len(name)} bytes")
                pack = zlib.compressobj(wbits=-15)
                data = pack.compress(raw) + pack.flush()
                crc = zlib.crc32(raw)
                head = local_record(name, crc, len(data), len(raw))
                whole = head + data
                for k, at in enumerate(range(0, len(whole), PIECE)):
                    one = [pa.array([v], t) for v, t in ((path, pa.string()), (k, pa.int32()), (crc, pa.int64()), (len(data), pa.int64()), (len(raw), pa.int64()), (len(whole), pa.int64()), (whole[at : at + PIECE], pa.binary()))]
                    yield pa.RecordBatch.from_arrays(one, names=["path", "place", "crc", "packed", "size", "length", "data"])

    rows = documents.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(work, "path string, place int, crc bigint, packed bigint, size bigint, length bigint, data binary")


def write_zip(documents: DataFrame, target: str | Callable[[], BinaryIO], prefix: str = "knowledge/") -> int:
    """Writes the archive of (path, content), in the order of paths, to a file or to what ``target()`` opens; the number of entries.
    Repeated paths are an error: an archive that unpacks to fewer files would lose one."""
    if documents.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("a path occurs twice")
    pieces = stored(entries(documents, prefix), "archive")
    heads = pieces.where("place = 0").drop("place", "data")
    directory = stored(scan.running(heads, [], ["path"], sums={"offset": "length"}, inclusive=False), "directory")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with open(target, "wb") if isinstance(target, str) else target() as out:
        start = 0
        for r in pieces.select("path", "place", "data").repartitionByRange(parts, "path", "place").sortWithinPartitions("path", "place").toLocalIterator():
            start += out.write(r.data)
        n, length = 0, 0
        for r in directory.orderBy("path").toLocalIterator():
            length += out.write(central_record((prefix + r.path).encode(), r.crc, r.packed, r.size, r.offset))
            n += 1
        out.write(end_records(n, start, length))
    return n
