"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``size`` bytes that covers it also begins anywhere
else, in the same text or another. Only repeats matter, so the corpus is cut
into suffix arrays that need not know each other:

1. Equal texts count once, with their number of copies.
2. Every window of ``size`` bytes belongs to the place of its least k-byte hash
   (leftmost of equals), so equal windows belong to places of equal hash. A
   place (anchor) and the windows that belong to it are one row, about one for
   70 bytes. Anchors whose hash occurs once have no repeat and go.
3. Of each hash the distinct stretches of text that its windows span meet in
   one task, each once with the number of its occurrences. Hashes with more
   than ``MOST`` distinct stretches (a phrase that is everywhere) are dealt out
   by longer hashes first, at last by whole windows, so none is too large.
4. A task joins the stretches of many hashes to one sequence and builds its
   suffix array by two-stage sorting: suffixes smaller than their successors
   are sorted directly by their first ``size`` bytes, the rest is induced by a
   scan of the buckets in order. Windows next to each other in it with
   a common prefix of ``size`` bytes are repeats.
5. The repeats go back to all places of the stretches, and by text to its rows.

Texts are read in pieces of bounded length; one text's spans are its largest
group. Nothing but counts reaches the driver.

Defined results: a null text is an empty text; texts below ``size`` bytes are
kept whole. Repeated rows, with or without an id, repeat each other's bytes and
lose them all. An empty table gives an empty result. Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

SIZE = 200
#: Distinct stretches that a hash may have; bytes read at once; windows that one suffix array holds.
MOST, _BYTES, _WINDOWS = 2_000, 1 << 20, 1 << 17
_BASE = 0x100000001B3
_PLACE = 24  # bits of a place within the bytes read at once, and of the hashes that are compared


def _levels(size: int) -> list[int]:
    """Lengths of the hashed strings: for all, for hashes with many stretches, whole windows."""
    return [max(1, size * 4 // 25), max(1, size * 3 // 5), size]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of MurmurHash3: spreads 64 bits over 64 bits, one to one."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def anchors(data: np.ndarray, ends: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of each anchor. ``data``: the bytes of texts one after another,
    ``ends``: where each ends; windows that cross an end belong to nothing."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none
    # The hash of a string: its bytes times the powers of the base from 0 on.
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=prefix[1:])
    hashes = _mixed((prefix[k:] - prefix[: n - k + 1]) * _powers(pow(_BASE, -1, 1 << 64), n - k + 1) + np.uint64(k))
    bits = np.uint64(_PLACE)
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    w, width = size - k + 1, 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = n - size + 1
    least = np.minimum(least[:windows], least[w - width : w - width + windows])
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int32)
    whole = ends - begins >= size
    inside[begins[whole]] += 1
    inside[ends[whole] - size + 1] -= 1
    own = np.flatnonzero(np.cumsum(inside)[:windows])
    if not len(own):
        return none, none, none
    cut = np.flatnonzero((np.diff(place[own]) != 0) | (np.diff(own) != 1)) + 1
    first = own[np.concatenate([[0], cut])]
    return first, np.diff(np.concatenate([[0], cut, [len(own)]])), hashes[place[first]].view(np.int64)


def _pieces(texts, size: int):
    """Groups of (number, offset, bytes): texts in pieces of up to _BYTES windows, pieces in groups of about as many bytes."""
    group, held = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - size + 1), _BYTES):
            piece = text[at : at + _BYTES + size - 1]
            if group and held + len(piece) > _BYTES:
                yield group
                group, held = [], 0
            group.append((number, at, piece))
            held += len(piece)
    if group:
        yield group


def _anchored(texts, k: int, size: int):
    """For each group of pieces (text numbers, first windows within the text, numbers of windows, hashes, whole bytes,
    first windows within those)."""
    for group in _pieces(texts, size):
        data = b"".join(p for _, _, p in group)
        ends = np.cumsum([len(p) for _, _, p in group])
        first, count, h = anchors(np.frombuffer(data, np.uint8), ends, k, size)
        piece = np.searchsorted(ends, first, side="right")
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        number, offset = (np.array([g[x] for g in group], np.int64)[piece] for x in (0, 1))
        yield number, first - begins[piece] + offset, count, h, data, first


def _stretch(data: bytes, at: int, count: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(data[at : at + count + size - 1], digest_size=8).digest(), "little", signed=True)


def _blobs(column: pa.Array) -> list[memoryview | bytes]:
    return column.cast(pa.binary()).to_pylist()


def _counted(k: int, size: int):
    def work(batches):
        for b in batches:
            copies = b.column(1).to_numpy()
            for number, _, _, h, _, _ in _anchored(_blobs(b.column(0)), k, size):
                values, at = np.unique(h, return_inverse=True)
                n = np.zeros(len(values), np.int64)
                np.add.at(n, at, copies[number])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["h", "n"])

    return work


_ANCHOR_SQL = "h bigint, seg bigint, d1 bigint, d2 bigint, first bigint, count int, times int, copies bigint"
_ANCHOR_NAMES = [c.split()[0] for c in _ANCHOR_SQL.split(", ")]


def _rows(number, first, count, h, seg, d1, d2, copies) -> pa.RecordBatch:
    """Anchors as rows; equal stretches that follow each other without a gap (a period) are one row, ``times`` over."""
    n = len(h)
    if n:
        goes_on = np.zeros(n, bool)
        goes_on[1:] = (h[1:] == h[:-1]) & (seg[1:] == seg[:-1]) & (count[1:] == count[:-1]) & (number[1:] == number[:-1]) & (first[1:] == first[:-1] + count[:-1])
        head = np.flatnonzero(~goes_on)
        times = np.diff(np.append(head, n))
        number, first, count, h, seg = (x[head] for x in (number, first, count, h, seg))
    else:
        times = count
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(d1[number]), pa.array(d2[number]), pa.array(first, pa.int64()), pa.array(count, pa.int32()), pa.array(times, pa.int32()), pa.array(copies[number])], names=_ANCHOR_NAMES)


def _listed(k: int, size: int):
    """All anchors of texts (d1, d2, text, copies)."""

    def work(batches):
        for b in batches:
            d1, d2, copies = (b.column(i).to_numpy() for i in (0, 1, 3))
            for number, first, count, h, data, at in _anchored(_blobs(b.column(2)), k, size):
                seg = np.array([_stretch(data, a, c, size) for a, c in zip(at.tolist(), count.tolist())], np.int64)
                yield _rows(number, first, count, h, seg, d1, d2, copies)

    return work


def _finer(k: int, size: int):
    """Anchors by longer hashes for the windows listed in ``parts`` (first, count) of each text."""

    def work(batches):
        for b in batches:
            for r in range(b.num_rows):
                d1, d2, copies = (b.column(i).slice(r, 1).to_numpy() for i in (0, 1, 3))
                text = _blobs(b.column(2).slice(r, 1))[0]
                edge = np.zeros(len(text) + 1, np.int32)
                for p in b.column(4)[r].as_py():
                    edge[p["first"]] += 1
                    edge[p["first"] + p["count"] * p["times"]] -= 1
                wanted = np.cumsum(edge) > 0
                border = np.cumsum(np.concatenate([[0], wanted[1:] != wanted[:-1]]))
                for _, first, count, h, data, at in _anchored([text], k, size):
                    # An anchor's windows are cut where the wanted ones begin and end.
                    own = np.repeat(np.arange(len(first)), count)
                    window = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                    keep = wanted[window]
                    own, window = own[keep], window[keep]
                    if not len(own):
                        continue
                    cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(border[window]) != 0)) + 1
                    head = np.concatenate([[0], cut])
                    n, f, o = np.diff(np.append(head, len(own))), window[head], own[head]
                    seg = np.array([_stretch(data, a, c, size) for a, c in zip((at[o] + f - first[o]).tolist(), n.tolist())], np.int64)
                    yield _rows(np.zeros(len(f), np.int64), f, n, h[o], seg, d1, d2, copies)

    return work


def _stretches(size: int):
    """(h, seg, n, piece) of each text's stretches that stand for all equal ones."""

    def work(batches):
        for b in batches:
            texts, listed = _blobs(b.column(0)), b.column(1).to_pylist()
            out = [(s["h"], s["seg"], s["n"], t[s["first"] : s["first"] + s["count"] + size - 1]) for t, found in zip(texts, listed, strict=True) for s in found]
            for at in range(0, len(out), 10_000):
                h, seg, n, piece = zip(*out[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(n, pa.int64()), pa.array(piece, pa.binary())], names=["h", "seg", "n", "piece"])

    return work


class TwoStage:
    """Suffixes of a byte string in order by their first ``size`` bytes at least: those of ``wanted`` places, and what
    their order rests on."""

    def __init__(self, text: bytes, wanted: np.ndarray, size: int):
        # A byte in front, and a last suffix smaller than its successor, so that every chain of larger ones ends.
        self.data, self.size = b"\x00" + text + b"\x00\xff", size
        t = self.t = np.frombuffer(self.data + bytes(8), np.uint8)[: len(self.data)]
        n = len(t)
        step = np.sign(np.diff(t.astype(np.int16)))
        at = np.where(step != 0, np.arange(n - 1), n - 2)
        step = step[np.minimum.accumulate(at[::-1])[::-1]]
        self.small = np.append(step > 0, False)  # smaller than the successor
        # Places from each wanted one to the next small one.
        own = np.concatenate([[False], wanted, [False, False]])
        small_at = np.minimum.accumulate(np.where(self.small, np.arange(n), n)[::-1])[::-1]
        edge = np.zeros(n + 1, np.int32)
        where = np.flatnonzero(own)
        np.add.at(edge, where, 1)
        np.add.at(edge, small_at[where] + 1, -1)
        self.active = np.cumsum(edge[:-1]) > 0
        order = self._induced(self._sorted())
        self.order = order[own[order]] - 1

    def _sorted(self) -> np.ndarray:
        data, size = self.data, self.size
        places = np.flatnonzero(self.active & self.small).tolist()
        return np.array(sorted(places, key=lambda i: data[i : i + size]), np.int64)

    def _induced(self, direct: np.ndarray) -> np.ndarray:
        """All active places in order: each bucket holds first what lower buckets put there, then larger suffixes of
        the same byte, then those sorted directly; its predecessors of a larger byte go to their buckets."""
        t, active = self.t, self.active
        cuts = np.searchsorted(t[direct], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []
        for c in range(256):
            put = waiting[c]
            wave = np.concatenate(put) if put else np.zeros(0, np.int64)
            bucket = [wave]
            while len(wave):
                before = wave - 1
                wave = before[active[before] & (t[before] == c)]
                bucket.append(wave)
            bucket.append(direct[cuts[c] : cuts[c + 1]])
            full = np.concatenate(bucket)
            if not len(full):
                continue
            out.append(full)
            before = full - 1
            before = before[active[before] & (t[before] > c)]
            byte = t[before]
            before = before[np.argsort(byte, kind="stable")]
            edges = np.cumsum(np.bincount(byte, minlength=256))
            for x in np.unique(byte).tolist():
                waiting[x].append(before[edges[x - 1] : edges[x]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def common(self) -> np.ndarray:
        """For each wanted place but the first in order, bytes shared with the one before, ``size`` at most. Wanted
        places must have ``size`` bytes."""
        words = np.ndarray((len(self.t),), "<u8", self.t.base, 0, (1,))
        a, b = self.order[:-1] + 1, self.order[1:] + 1
        shared, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for at in range(0, self.size, 8):
            gap = words[a[live] + at] ^ words[b[live] + at]
            low = gap & (~gap + np.uint64(1))
            same = np.where(gap == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            shared[live] += same
            live = live[gap == 0]
        return np.minimum(shared, self.size)


def repeated(pieces: list[bytes], size: int) -> list[np.ndarray]:
    """For each piece which of its windows are also elsewhere in these pieces."""
    windows = np.array([len(p) - size + 1 for p in pieces], np.int64)
    begins = np.cumsum([0, *[len(p) for p in pieces]])
    wanted = np.zeros(begins[-1], bool)
    for b, w in zip(begins.tolist(), windows.tolist()):
        wanted[b : b + w] = True
    array = TwoStage(b"".join(pieces), wanted, size)
    twice = np.flatnonzero(array.common() >= size)
    found = np.zeros(begins[-1], bool)
    found[array.order[twice]] = True
    found[array.order[twice + 1]] = True
    return [found[b : b + w] for b, w in zip(begins.tolist(), windows.tolist())]


def _decided(size: int):
    """(h, seg, bits) of stretches that hold a repeat; rows come sorted by h, a suffix array holds whole hashes."""

    def done(rows):
        found = repeated([r[3] for r in rows], size)
        out = [(h, seg, np.packbits(np.ones(len(f), bool) if n > 1 else f).tobytes()) for (h, seg, n, _), f in zip(rows, found, strict=True) if n > 1 or f.any()]
        h, seg, bits = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(bits, pa.binary())], names=["h", "seg", "bits"])

    def work(batches):
        rows, held = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held > _WINDOWS and r[0] != rows[-1][0]:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3]) - size + 1
        if rows:
            yield done(rows)

    return work


def _covered(length: int, places: list[dict], size: int) -> np.ndarray:
    edge = np.zeros(length + 1, np.int32)
    for p in places:
        first, count, times = p["first"], p["count"], p["times"]
        bits = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=count)
        if bits.all():
            edge[first] += 1
            edge[first + count * times - 1 + size] -= 1
            continue
        at = np.flatnonzero(bits)
        at = (first + at[None, :] + count * np.arange(times)[:, None]).ravel()
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(size: int):
    """(d1, d2, spans, kept_sha256) of texts with repeats."""

    def work(batches):
        for b in batches:
            spans, digests = [], []
            for text, places in zip(_blobs(b.column(2)), b.column(3).to_pylist(), strict=True):
                gone = _covered(len(text), places, size)
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": a, "end": e} for a, e in turns.reshape(-1, 2).tolist()])
                digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind), pa.array(digests, pa.string())], names=["d1", "d2", "spans", "kept_sha256"])

    return work


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with sha (hex) of the text's bytes and d1, d2, its first 128 bits."""
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    df = df.withColumn("sha", F.sha2(whole, 256)).withColumn("n_bytes", F.octet_length(whole).cast("bigint"))
    return df.withColumns({d: F.conv(F.substring("sha", at, 16), 16, -10).cast("bigint") for d, at in (("d1", 1), ("d2", 17))})


def repeats(df: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(d1, d2, spans, kept_sha256) of each distinct text with repeated strings: 128 bits of its SHA-256, the spans of bytes
    to remove, and the SHA-256 of the others."""
    spark = df.sparkSession
    scratch = Scratch(spark, "suffixes")
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    once = _keyed(df.select(F.col(text_col).alias("text")), "text").where(F.col("n_bytes") >= size)
    once = once.groupBy("d1", "d2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # Bucketed by text, so that no later join moves the texts.
    once.write.bucketBy(parts, "d1", "d2").sortBy("d1", "d2").option("path", scratch.path("texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    try:
        texts, text = spark.table(name), ["d1", "d2"]
        levels = _levels(size)
        total = texts.select("text", "copies").mapInArrow(_counted(levels[0], size), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
        often = scratch.put("often", total.where("n > 1").select("h"))
        places = texts.select("d1", "d2", "text", "copies").mapInArrow(_listed(levels[0], size), _ANCHOR_SQL)
        places = scratch.put("places0", places.join(often, "h", "left_semi"))
        all_places, all_stretches = None, None
        for level in range(len(levels)):
            one = F.min(F.struct("d1", "d2", "first", "count")).alias("one")
            stretches = scratch.put(f"stretches{level}", places.groupBy("h", "seg").agg(F.sum(F.col("times") * F.col("copies")).alias("n"), one))
            hot = None
            if level + 1 < len(levels):
                hot = scratch.put(f"hot{level}", stretches.groupBy("h").count().where(F.col("count") > MOST).select("h"))
                hot = None if hot.isEmpty() else hot
            calm = places if hot is None else places.join(hot, "h", "left_anti")
            few = stretches if hot is None else stretches.join(hot, "h", "left_anti")
            all_places = calm if all_places is None else all_places.unionAll(calm)
            all_stretches = few if all_stretches is None else all_stretches.unionAll(few)
            if hot is None:
                break
            listed = places.join(hot, "h", "left_semi").groupBy(*text).agg(F.collect_list(F.struct("first", "count", "times")).alias("parts"))
            finer = texts.join(listed.hint("merge"), text).select("d1", "d2", "text", "copies", "parts").mapInArrow(_finer(levels[level + 1], size), _ANCHOR_SQL)
            finer = scratch.put(f"finer{level}", finer)
            again = finer.groupBy("h").agg(F.sum(F.col("times") * F.col("copies")).alias("n")).where("n > 1").select("h")
            places = scratch.put(f"places{level + 1}", finer.join(again, "h", "left_semi"))
        stands = all_stretches.select("h", "seg", "n", "one.*").groupBy(*text).agg(F.collect_list(F.struct("h", "seg", "n", "first", "count")).alias("found"))
        pieces = texts.join(stands.hint("merge"), text).select("text", "found").mapInArrow(_stretches(size), "h bigint, seg bigint, n bigint, piece binary")
        decided = pieces.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_decided(size), "h bigint, seg bigint, bits binary")
        decided = scratch.put("decided", decided)
        found = all_places.join(decided, ["h", "seg"]).groupBy(*text).agg(F.collect_list(F.struct("first", "count", "times", "bits")).alias("places"))
        gone = texts.join(found.hint("merge"), text).select("d1", "d2", "text", "places").mapInArrow(_removed(size), "d1 bigint, d2 bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
        return scratch.put("removed", gone)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop("texts", "often", "decided", *(f"{t}{k}" for t in ("places", "stretches", "hot", "finer") for k in range(3)))


def removal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = _keyed(df.select(F.col(id_col), F.col(text_col).alias("_t")), "_t").drop("_t")
    lost = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    gone = repeats(df, text_col, size).select("d1", "d2", lost.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
    out = rows.join(gone, ["d1", "d2"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def deduplicated(df: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``df`` with kept (binary: the text's bytes without repeats) and spans (what went); columns of these names give way."""
    kind = "array<struct<start:bigint,end:bigint>>"
    own = df.drop("kept", "spans", "d1", "d2", "sha", "n_bytes") if text_col not in ("kept", "spans") else df
    rows = _keyed(own, text_col).join(repeats(df, text_col, size).drop("kept_sha256"), ["d1", "d2"], "left").drop("d1", "d2", "sha", "n_bytes")
    spans = F.coalesce("spans", F.array().cast(kind))
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # What lies between the spans, from the end of one to the start of the next.
    edges = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(whole).cast("bigint")))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    kept = F.aggregate(F.arrays_zip(before.alias("a"), edges.alias("b")), F.lit(b""), lambda out, x: F.concat(out, F.substring(whole, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))))
    return rows.withColumn("kept", kept).withColumn("spans", spans)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))


#: The same in SQL: every window of 200 bytes by its digest, the places of those that occur twice, and what they leave. Texts
#: are written in hexadecimal digits and cut into slices first, so that no window is taken from a long string.
OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents
), s AS (
  SELECT r, b * 1000 AS base, substr(t, 2000 * b + 1, 2398) AS p FROM (SELECT r, t, unnest(range((length(t) // 2 + 999) // 1000)) AS b FROM d)
), w AS (
  SELECT r, base + i AS i, md5(substr(p, 2 * i + 1, 400)) AS h FROM (SELECT r, base, p, unnest(range(length(p) // 2 - 199)) AS i FROM s WHERE length(p) >= 400)
), m AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), c AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w SEMI JOIN m USING (h)
), g AS (
  SELECT r, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM c
), e AS (
  SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, k
), f AS (
  SELECT r, a, b, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM e
), o AS (
  SELECT f.r, sum(b - a) AS n_removed, count(*) AS n_spans, substr(any_value(t), 1, 2 * CAST(min(a) AS BIGINT))
    || string_agg(substr(t, 2 * b + 1, 2 * (coalesce(next, length(t) // 2) - b)), '' ORDER BY a) AS kept
  FROM f JOIN d USING (r) GROUP BY f.r
)
SELECT doc_id, CAST(length(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, t))) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""
