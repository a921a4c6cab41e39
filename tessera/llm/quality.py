"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled bad (0) or good (1). A line's features are shares of byte
classes, length, words that repeat the word before, lines that repeat an
earlier line, each in a few steps, for the line itself and the lines before and
after it. The chain has weights for pairs of neighbouring labels. It is fitted
to lines that carry their document's label, by gradient steps on the
conditional likelihood. Scoring runs forward-backward over the lines; the
marginals, averaged with line lengths as weights, together with the marginal of
the worst stretch and the document's length, go through a fitted logistic
curve: the document's quality.

Fitting takes at most ``SAMPLE`` labelled documents. The chain learns from the
lines of a text, or where it has more than ``TRAIN_LINES`` from stretches of
``STRETCH`` lines of it that a hash picks all over the text; the curve learns
from whole texts. Scoring takes whole texts.

Defined results: a null text is an empty text, which is one empty line; rows
are scored each, null ids included; with no labelled row, or only one class,
every score is the share of good labels (1 if none); a score of just the least
value asked for is kept; a line of any length is one line; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fold, labelled_sample, labelled_texts, table

#: Labelled documents to fit on; lines of each that the chain learns from, in stretches of so many.
SAMPLE, TRAIN_LINES, STRETCH = 3000, 400, 40
#: Characters worked on at once; longer texts are walked in pieces of whole lines, longer lines in pieces whose sums are added.
AT_ONCE = 2_000_000
#: Weight of a good document against a bad one in the curve: losing a good one is the worse error.
KEEP = 8.0

# Byte classes.
_CLASS = np.zeros((6, 256), dtype=np.int8)
_CLASS[0, [*range(97, 123), *range(128, 256)]] = 1  # lower-case letters and bytes of other scripts
_CLASS[1, 65:91] = 1  # capitals
_CLASS[2, 48:58] = 1  # digits
_CLASS[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = 1  # symbols
_CLASS[4, [9, 11, 12, 13, 32]] = 1  # blanks
_CLASS[5, [33, 124]] = 1  # ! and |
_MIX = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.int64)
STEPS = (0.02, 0.1, 0.3, 0.6)
AGAIN = 4  # place of the feature of repeated lines


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a byte array, which ends with a line feed."""
    ends = np.flatnonzero(data == 10)
    return np.r_[0, ends[:-1] + 1], ends


def _pieces(text: str | None) -> Iterator[str]:
    """The text in pieces of at most AT_ONCE characters that end at line feeds, and longer lines on their own."""
    text, at = text or "", 0
    while len(text) - at > AT_ONCE:
        end = text.rfind("\n", at, at + AT_ONCE)
        if end < at:
            end = text.find("\n", at + AT_ONCE)
            if end < 0:
                break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def line_statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of each line, its length in bytes, lines of each text)."""
    pieces = [(k, p) for k, t in enumerate(texts) for p in _pieces(t)]
    got = [_long_line(g[0]) if len(g[0]) > AT_ONCE else _statistics(g) for g in groups([p for _, p in pieces])]
    own, length, lines, words, line_hash = (np.concatenate(x) for x in zip(*got, strict=True))
    per_text = np.bincount([k for k, _ in pieces], weights=lines, minlength=len(texts)).astype(np.int64)
    # Lines that repeat an earlier line of their text.
    doc = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((np.arange(len(doc)), line_hash, doc))
    own[order[1:], AGAIN] = (doc[order[1:]] == doc[order[:-1]]) & (line_hash[order[1:]] == line_hash[order[:-1]]) & (words[order[1:]] > 1)
    return own, length, per_text


def _statistics(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(features but for AGAIN, lengths, lines of each text, words of each line, hash of each line)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    starts, ends = _lines(data)
    per_text = np.array([r.count(b"\n") + 1 for r in raw])
    sums = np.stack([np.add.reduceat(c[data], starts, dtype=np.int64) for c in _CLASS])
    # Words: hash of each, to see whether it repeats the one before on its line.
    h, at = _word_hashes(data)
    words, repeats, line_hash = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
    if len(at):
        line = np.searchsorted(ends, at)
        same = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])]
        words = np.bincount(line, minlength=len(starts))
        repeats = np.bincount(line[same], minlength=len(starts))
        line_hash = np.bincount(line, weights=_weighed(h, np.arange(len(h)) - np.searchsorted(line, line)), minlength=len(starts))
    return _features(ends - starts, words, repeats, sums), ends - starts, per_text, words, line_hash


def _word_hashes(data: np.ndarray, inside: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: a sum over its bytes and their places. ``inside``: so many bytes of the first word came before."""
    blank = (_CLASS[4][data] | (data == 10)).astype(bool)
    at = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(at):
        return np.zeros(0, dtype=np.int64), at
    place = np.arange(len(data)) - np.repeat(np.r_[0, at], np.diff(np.r_[0, at, len(data)]))
    if inside and at[0] == 0:
        place[: at[1] if len(at) > 1 else len(data)] += inside
    mixed = _MIX[data] * (2 * place.astype(np.int64) + 1)
    mixed[blank] = 0
    return np.add.reduceat(mixed, at), at


def _weighed(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (h % 1000003) * (1.0 + place % 97)


def _long_line(text: str) -> tuple[np.ndarray, ...]:
    """What ``_statistics`` gives for one line, whose sums are added over pieces of it; a word may go on in the next piece."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    sums, words, repeats, line_hash = np.zeros((len(_CLASS), 1), dtype=np.int64), 0, 0, 0.0
    last, part, inside = None, np.int64(0), 0  # the last whole word's hash; that of a word that goes on, and its bytes so far
    for k in range(0, len(raw), AT_ONCE):
        data = raw[k : k + AT_ONCE]
        sums[:, 0] += [int(c[data].sum(dtype=np.int64)) for c in _CLASS]
        h, at = _word_hashes(data, inside)
        goes_on = inside > 0 and len(at) > 0 and at[0] == 0
        if goes_on:
            h[:1] += part  # wraps around like the sums of whole words
        elif inside:
            h, at = np.r_[part, h], np.r_[-1, at]
        part, inside, open_ = np.int64(0), inside if goes_on else 0, _CLASS[4][data[-1]] == 0
        if open_:
            part, inside = h[-1], (inside if len(at) == 1 and goes_on else 0) + len(data) - int(at[-1])
            h = h[:-1]
        else:
            inside = 0
        if len(h):
            repeats += int((h[1:] == h[:-1]).sum()) + int(last is not None and h[0] == last)
            line_hash += float(_weighed(h, words + np.arange(len(h))).sum())
            words, last = words + len(h), h[-1]
    if inside:
        repeats += int(last is not None and part == last)
        line_hash, words = line_hash + float(_weighed(np.array([part]), np.array([words]))[0]), words + 1
    one = lambda v: np.array([v])
    return _features(one(len(raw)), one(words), one(repeats), sums), one(len(raw)), one(1), one(words), one(line_hash)


def _features(length: np.ndarray, words: np.ndarray, repeats: np.ndarray, sums: np.ndarray) -> np.ndarray:
    share, w = sums / np.maximum(length, 1), np.maximum(words, 1)
    columns = [np.ones(len(length)), np.log1p(length) / 6, np.log1p(words) / 4, np.minimum(length / w, 30) / 10, np.zeros(len(length)), words == 0]
    for s in [*share, repeats / w, share[5] * length / w]:
        columns += [s, *[(s > k).astype(float) for k in STEPS]]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line after (zeros at a text's ends)."""
    ends = np.cumsum(per_text)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[(ends - per_text)], after[ends - 1] = 0, 0
    return np.concatenate([own, before, after], axis=1)


class Field:
    """The chain: weights of features for label 1 (label 0 has none) and of label pairs."""

    def __init__(self, width: int):
        self.w, self.pair = np.zeros(width), np.zeros((2, 2))

    def marginals(self, x: np.ndarray, per_text: np.ndarray, gradient: bool = False):
        """P(line is good) by forward-backward over all texts at once, longest first;
        with ``gradient`` also the expected label pairs."""
        score = x @ self.w.astype(x.dtype)
        emit = np.stack([np.zeros_like(score), score], axis=1).astype(float)
        emit -= emit.max(axis=1, keepdims=True)
        e, t = np.exp(emit), np.exp(self.pair - self.pair.max())
        starts = np.cumsum(per_text) - per_text
        order = np.argsort(-per_text, kind="stable")
        starts, sizes = starts[order], per_text[order]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
        f, b = np.empty_like(e), np.empty_like(e)
        for k, m in enumerate(live):  # texts that have a line k
            i = starts[:m] + k
            v = e[i] if k == 0 else (f[i - 1] @ t) * e[i]
            f[i] = v / v.sum(axis=1, keepdims=True)
        for k in range(len(live) - 1, -1, -1):
            m = live[k]
            i = starts[:m] + k
            b[i] = 1.0
            if k + 1 < len(live):
                j = i[: live[k + 1]]
                v = (b[j + 1] * e[j + 1]) @ t.T
                b[j] = v / v.sum(axis=1, keepdims=True)
        p = f * b
        p /= p.sum(axis=1, keepdims=True)
        if not gradient:
            return p[:, 1]
        inner = np.ones(len(e), dtype=bool)
        inner[starts] = False
        i = np.flatnonzero(inner)
        q = f[i - 1][:, :, None] * t[None] * (e[i] * b[i])[:, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
        return p[:, 1], q, i

    def fit(self, x: np.ndarray, y: np.ndarray, per_text: np.ndarray, weight: np.ndarray, rounds: int = 70, rate: float = 0.15, l2: float = 1e-3) -> None:
        total = weight.sum()
        state = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros((2, 2)), np.zeros((2, 2))]
        for k in range(1, rounds + 1):
            p, q, i = self.marginals(x, per_text, gradient=True)
            gw = x.T @ (weight * (y - p)) / total - l2 * self.w
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[i - 1], y[i]), weight[i])
            gp = (seen - (q * weight[i, None, None]).sum(axis=0)) / total - l2 * self.pair
            for a, (value, g) in enumerate(((self.w, gw), (self.pair, gp))):
                m, v = state[2 * a], state[2 * a + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)


def aggregate(p: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Per text: logit of the length-weighted mean marginal, the weighted share of lines that look bad, log length, 1."""
    starts = np.cumsum(per_text) - per_text
    w = length + 1.0
    whole = np.add.reduceat(w, starts)
    mean = np.add.reduceat(w * p, starts) / whole
    bad = np.add.reduceat(w * (p < 0.5), starts) / whole
    z = np.log((mean + 0.01) / (1.01 - mean))
    return np.stack([z, bad, np.log1p(whole) / 8, np.exp(-whole / 60), np.ones(len(z))], axis=1)


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    c = np.zeros(a.shape[1])
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a / weight.sum() + l2 * np.eye(len(c))
        c += np.linalg.solve(h, a.T @ (weight * (y - p)) / weight.sum() - l2 * c)
    return c


class Quality:
    """A fitted model: the chain and the curve of documents."""

    def __init__(self, field: Field | None, curve: np.ndarray | None, prior: float):
        self.field, self.curve, self.prior = field, curve, prior

    @classmethod
    def fit(cls, x: list[np.ndarray], sizes: list[list[int]], labels: list[int]) -> Quality:
        """The chain, from the features of each document's lines (with neighbours) in stretches of the given sizes;
        ``fit_curve`` is to follow. Without two classes there is nothing to fit."""
        if len(set(labels)) < 2:
            return cls(None, None, float(np.mean(labels)) if labels else 1.0)
        y_doc, lines = np.array(labels), np.array([len(v) for v in x])
        per_text, y = np.array([n for s in sizes for n in s]), np.repeat(y_doc, lines)
        # Each document weighs the same, and so does each class.
        share = np.where(y_doc == 1, 0.5 / max(1, (y_doc == 1).sum()), 0.5 / max(1, (y_doc == 0).sum()))
        field = Field(x[0].shape[1])
        field.fit(np.concatenate(x).astype(np.float64), y, per_text, np.repeat(share / lines, lines) * len(y))
        return cls(field, None, float(y_doc.mean()))

    def fit_curve(self, a: np.ndarray, labels: np.ndarray) -> None:
        """The curve, from ``places`` of labelled documents."""
        self.curve = _logistic(a, labels, np.where(labels == 1, KEEP, 1.0))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.field is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.places(texts) @ self.curve, -30, 30)))

    def places(self, texts: list[str | None]) -> np.ndarray:
        """What the curve takes of each whole text."""
        own, length, per_text = line_statistics(texts)
        # Long documents go through forward-backward in groups, so that the arrays stay small.
        out = []
        ends = np.cumsum(per_text)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50_000)))
            a, b = (ends[at - 1] if at else 0), ends[to - 1]
            x = with_neighbours(own[a:b], per_text[at:to])
            out.append(aggregate(self.field.marginals(x, per_text[at:to]), length[a:b], per_text[at:to]))
            at = to
        return np.concatenate(out)


def stretches(lines: int, key: int) -> list[tuple[int, int]]:
    """The lines that training takes of a text: all, or TRAIN_LINES in stretches that a hash picks all over it."""
    if lines <= TRAIN_LINES:
        return [(0, lines)]
    starts = range(0, lines - lines % STRETCH, STRETCH)
    picked = sorted(starts, key=lambda s: zlib.crc32(f"{key} {s}".encode()))[: TRAIN_LINES // STRETCH]
    return [(s, s + STRETCH) for s in sorted(picked)]


def groups(texts: list[str | None], most: int | None = None) -> Iterator[list[str | None]]:
    """Texts that together have at most ``most`` (AT_ONCE) characters, or one text."""
    part, size, most = [], 0, most or AT_ONCE
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep=None, bound: int = SAMPLE) -> Quality:
    """Fits on at most ``bound`` labelled documents; executors turn texts into numbers, of which the driver gets at most
    TRAIN_LINES rows a document for the chain, then one row a document for the curve."""
    sample = labelled_sample(labels, id_col, label_col, F.lit(True) if keep is None else keep, bound)
    scratch = Scratch(docs.sparkSession, "quality")
    few = scratch.put("few", labelled_texts(docs, sample, id_col, text_col))

    def lines(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                own, _, n = line_statistics([text])
                x, taken = with_neighbours(own, n), stretches(len(own), zlib.crc32(text.encode("utf-8", "replace")))
                rows = np.concatenate([x[i:j] for i, j in taken]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([[j - i for i, j in taken]], pa.list_(pa.int32()))], names=["y", "x", "sizes"])

    few = few.select(F.col("_y").cast("int").alias("_y"), "t")
    rows = few.mapInArrow(lines, "y int, x binary, sizes array<int>").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.x)))  # whatever order the tasks came in
    model = Quality.fit([np.frombuffer(r.x, dtype="<f4").reshape(sum(r.sizes), -1) for r in rows], [list(r.sizes) for r in rows], [r.y for r in rows])
    if model.field is not None:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def placed(batches):
            for b in batches:
                a = np.concatenate([shared.value.places(g) for g in groups(b.column(1).to_pylist())]) if b.num_rows else np.zeros((0, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["y", "a"])

        got = sorted((r.y, list(r.a)) for r in few.mapInArrow(placed, "y int, a array<double>").collect())
        model.fit_curve(np.array([a for _, a in got]), np.array([y for y, _ in got]))
    scratch.drop("few")
    return model


def score(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    target = docs.select(id_col, text_col)

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                scores = [shared.value.score(g) for g in groups(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[id_col, "score"])

    return target.mapInArrow(work, f"`{id_col}` {target.schema[0].dataType.simpleString()}, score double")


def kept(docs: DataFrame, model: Quality, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores at least ``least``."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                scores = [shared.value.score(g) for g in groups(part.column(place).to_pylist())]
                yield part.filter(pa.array(np.concatenate(scores) >= least if scores else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(work, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, keep=fold("_id", 4) != 2)
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
