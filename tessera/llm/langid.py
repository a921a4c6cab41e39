"""Language identification by string kernels.

Blended-spectrum presence kernel: two texts share so many distinct character
n-grams (1 to ``N``, lower-cased, hashed to ``BUCKETS``), divided by the root
of the product of their own numbers. Nyström: the kernel against a few landmark
texts of every language stands for a text's place; one-versus-rest kernel ridge
regression in that space gives a score for each language, and both steps fold
into one matrix. Texts are scored by two matrix products a batch.

Fitting takes at most ``SAMPLE`` documents with a language, each text from a row
that has the language it stands for (of several rows of an id the greatest
language, and of its texts the least); scoring takes whole texts, a very long text piece by piece into the same presence row.

Defined results: texts that are null or hold no letter (``\\p{L}``) are ``und``
with score 0; of languages with one score the first by name is told; with no row
to learn from every text is ``und``; rows are scored each, null ids included; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, labelled_sample, labelled_texts, table

N, BUCKETS = 3, 1 << 16
#: Documents to fit on, landmarks, ridge, and how sharply scores become shares.
SAMPLE, LANDMARKS, RIDGE, SHARP = 2000, 160, 0.1, 8.0
#: Texts and characters of a batch.
ROWS, AT_ONCE = 256, 1_000_000
#: A letter: the same test for what is learnt from and what is told.
_LETTER = r"\p{L}"
_STEP = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)]


def presence(texts: list[str | None]) -> np.ndarray:
    """One row of n-gram presences (uint8) for each text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.uint8)
    flat = out.reshape(-1)
    low = [(t or "").lower() for t in texts]
    at = 0
    while at < len(low):
        to, size = at, 0
        while to < len(low) and (to == at or size + len(low[to]) <= AT_ONCE):
            size += len(low[to])
            to += 1
        if to == at + 1 and size > AT_ONCE:  # overlapping pieces of one long text
            for k in range(0, size, AT_ONCE):
                _mark(flat, [low[at][k : k + AT_ONCE + N - 1]], at)
        else:
            _mark(flat, low[at:to], at)
        at = to
    return out


def _mark(flat: np.ndarray, texts: list[str], first: int) -> None:
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return
    row = np.repeat(np.arange(first, first + len(texts), dtype=np.int64) * BUCKETS, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the text's end
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, N + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ (codes[n - 1 :] + np.uint32(n))) * _STEP[n - 1]
        h ^= h >> np.uint32(15)
        ok = left[:m] >= n
        flat[row[:m][ok] + (h[ok] >> np.uint32(16))] = 1


class Language:
    """Landmarks over the n-grams they hold, and the folded regression."""

    def __init__(self, names: list[str], columns: np.ndarray, marks: np.ndarray, weights: np.ndarray):
        self.names, self.columns, self.marks, self.weights = names, columns, marks, weights

    @classmethod
    def fit(cls, grams: list[np.ndarray], labels: list[str]) -> Language | None:
        """``grams``: the sorted buckets of each text."""
        if not labels:
            return None
        names = sorted(set(labels))
        y = np.array([names.index(v) for v in labels])
        per = max(1, LANDMARKS // len(names))
        chosen = np.concatenate([np.flatnonzero(y == k)[np.linspace(0, (y == k).sum() - 1, min(per, (y == k).sum())).astype(int)] for k in range(len(names))])
        columns = np.unique(np.concatenate([grams[i] for i in chosen]))

        def rows(which) -> np.ndarray:
            x = np.zeros((len(which), len(columns)), dtype=np.float32)
            for r, i in enumerate(which):
                k = np.searchsorted(columns, grams[i])
                k[k == len(columns)] = 0
                x[r, k[columns[k] == grams[i]]] = 1
            return x

        own = np.sqrt(np.array([max(1, len(g)) for g in grams], dtype=float))
        marks = rows(chosen) / own[chosen][:, None].astype(np.float32)
        k_nm = np.concatenate([rows(range(a, min(a + 500, len(grams)))) @ marks.T for a in range(0, len(grams), 500)]) / own[:, None]
        k_mm = k_nm[chosen]
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = k_nm @ root
        # Each language weighs the same, so that a common one does not take the doubtful texts.
        w = 1.0 / np.bincount(y)[y]
        w *= len(y) / w.sum()
        target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
        beta = np.linalg.solve((phi * w[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]), (phi * w[:, None]).T @ target)
        return cls(names, columns, np.ascontiguousarray(marks.T), (root @ beta).astype(np.float32))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A share for each language, rows summing to one."""
        seen = presence(texts)
        own = np.sqrt(np.maximum(1, seen.sum(axis=1, dtype=np.int64)))
        k = (seen[:, self.columns].astype(np.float32) @ self.marks) / own[:, None]
        z = SHARP * (k @ self.weights)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep=None, bound: int = SAMPLE) -> Language | None:
    """Fits on at most ``bound`` documents; the driver gets their n-gram buckets, not their texts."""
    sample = labelled_sample(docs, id_col, lang_col, F.lit(True) if keep is None else keep, bound)

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                p = presence(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.flatnonzero(r).astype("<u2").tobytes() for r in p], pa.binary())], names=["y", "grams"])

    few = labelled_texts(docs.where(F.col(text_col).rlike(_LETTER)), sample, id_col, text_col, lang_col)
    rows = few.select("_y", "t").mapInArrow(work, "y string, grams binary").collect()
    rows = sorted((r.y, bytes(r.grams)) for r in rows)
    return Language.fit([np.frombuffer(g, dtype="<u2").astype(np.int64) for _, g in rows], [y for y, _ in rows])


def identify(docs: DataFrame, model: Language | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    target = docs.select(id_col, text_col, F.coalesce(F.col(text_col).rlike(_LETTER), F.lit(False)).alias("_letter"))

    def work(batches):
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                known = part.column(2).to_numpy(zero_copy_only=False).astype(bool) & (m is not None)
                lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
                if known.any():
                    s = m.scores([t for t, k in zip(texts, known, strict=True) if k])
                    lang[known] = np.array(m.names, dtype=object)[s.argmax(axis=1)]
                    score[known] = s.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return target.mapInArrow(work, f"`{id_col}` {target.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, keep=fold("_id", 4) != 2)
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
