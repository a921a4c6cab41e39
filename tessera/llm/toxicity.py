"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Input of a word: a learnt vector of the word (hashed) plus the mean of learnt
vectors of its character n-grams, which include its beginnings and end; most
words of a batch learn without the former (``WORD_DROP``). Windows
of ``WINDOW`` words overlap by a quarter; a GRU reads each forwards and another
backwards, attention weighs the word states, and a logistic unit scores the
window. A document's score is that of its worst window, brought to scale by a
logistic curve with the number of windows. Everything is trained in numpy by
back-propagation: a labelled document passes its label to its worst window.

Fitting takes at most ``SAMPLE`` labelled documents, all windows of each, or
where it has more than ``TRAIN_WINDOWS`` so many that a hash picks all over the
text; scoring reads all windows of whole texts.

Defined results: a null or empty text is one window of no words; rows are scored
each, null ids included; with no labelled row, or one class only, every score
is that share; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, labelled_sample, labelled_texts, table

WINDOW, STRIDE = 32, 24
#: Hashed rows of the word and n-gram tables; input and state widths.
WORDS, GRAMS, INPUT, STATE = 1 << 13, 1 << 13, 12, 8
#: Labelled documents to fit on and windows of each of them; passes over them.
SAMPLE, TRAIN_WINDOWS, EPOCHS = 3000, 120, 8
#: Share of a batch's words that learn from their characters alone; the word table is weighed by the rest at the end,
#: as in training on average. Words that fitting has not seen are then told by the characters they share.
WORD_DROP = 0.5
#: Words a worker remembers; windows scored at once; characters of a piece of a long text.
MEMORY, AT_ONCE, PIECE, BATCH = 300_000, 2048, 1_000_000, 64
#: Windows of a long text that are worked on together.
CHUNK = 8_000
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Row of the word table, then rows of the n-gram table (shifted by WORDS): beginnings, ends and the middle."""
    w = f"<{word}>"
    n = len(w)
    grams = [w[:4], w[:5], w[:6], w[:7], w[-4:], w[-5:], w[n // 2 - 2 : n // 2 + 2]]
    return [zlib.crc32(word.encode()) % WORDS] + [WORDS + zlib.crc32(g.encode()) % GRAMS for g in grams]


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words: each word is in one at least."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n > WINDOW else np.zeros(1, dtype=int)


def _chunks(text: str):
    """The words of a long text in lists whose windows together are those of the whole text."""
    found, shared = (m[0] for m in _WORD.finditer(text.lower())), WINDOW - STRIDE
    words = list(islice(found, CHUNK * STRIDE + shared))
    yield words
    while len(words) == CHUNK * STRIDE + shared and (more := list(islice(found, CHUNK * STRIDE))):
        words = words[-shared:] + more
        yield words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights in float32. ``e``: both tables; for each direction gates' input and state weights."""

    NAMES = ("e", "wf", "uf", "bf", "wb", "ub", "bb", "a", "v", "o", "c")

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.normal(size=s) * k).astype(np.float32)
        self.e = f(WORDS + GRAMS, INPUT, k=0.1)
        self.e[:WORDS] = 0  # a word without training adds nothing
        self.wf, self.uf, self.bf = f(INPUT, 3 * STATE), f(STATE, 3 * STATE), np.zeros(3 * STATE, np.float32)
        self.wb, self.ub, self.bb = f(INPUT, 3 * STATE), f(STATE, 3 * STATE), np.zeros(3 * STATE, np.float32)
        self.a, self.v = f(2 * STATE, STATE), f(STATE)
        self.o, self.c = f(2 * STATE), np.zeros(1, np.float32)
        self.curve = np.array([1.0, 0.0, 0.0])
        self.prior: float | None = None

    # Inputs are word vectors [words, INPUT]; ids index them, the last row stands for "no word":
    # its update gate is shut, so the state passes it unchanged. Gates are arrays of their own,
    # and those of update and reset are halved for sigmoid(x) = tanh(x / 2) / 2 + 1 / 2.
    def project(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """For each direction the gates' inputs [words, STATE]."""
        out = []
        for w, b in ((self.wf, self.bf), (self.wb, self.bb)):
            g = [np.ascontiguousarray(v) for v in np.split(x @ w + b, 3, axis=1)]
            g[0] *= 0.5
            g[1] *= 0.5
            g[0][-1] = -30.0
            out.append(g)
        return out

    def _run(self, p: list[np.ndarray], u: np.ndarray, ids: np.ndarray, backwards: bool, trace: list | None = None) -> np.ndarray:
        """States [steps, n, STATE]; ids [steps, n]."""
        steps, n = ids.shape
        uz, ur, uq = (np.ascontiguousarray(v) for v in np.split(u, 3, axis=1))
        uz, ur = uz * np.float32(0.5), ur * np.float32(0.5)
        h, out, half = np.zeros((n, STATE), np.float32), np.empty((steps, n, STATE), np.float32), np.float32(0.5)
        for t in range(steps - 1, -1, -1) if backwards else range(steps):
            i = ids[t]
            z = h @ uz
            z += p[0][i]
            np.tanh(z, out=z)
            z += 1
            z *= half
            r = h @ ur
            r += p[1][i]
            np.tanh(r, out=r)
            r += 1
            r *= half
            gq = h @ uq
            q = gq * r
            q += p[2][i]
            np.tanh(q, out=q)
            new = out[t]
            np.subtract(q, h, out=new)
            new *= z
            new += h
            if trace is not None:
                trace.append((t, h, z, r, q, gq))
            h = new
        return out

    def forward(self, proj: list, ids: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logit of each window; ids [n, steps]."""
        ids = np.ascontiguousarray(ids.T)
        tf, tb = ([], []) if trace is not None else (None, None)
        hf, hb = self._run(proj[0], self.uf, ids, False, tf), self._run(proj[1], self.ub, ids, True, tb)
        m = hf @ self.a[:STATE]
        m += hb @ self.a[STATE:]
        np.tanh(m, out=m)
        s = m @ self.v
        s[ids == len(proj[0][0]) - 1] -= 30
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        # The output is linear in the states, so it can be taken before they are pooled.
        logit = (w * (hf @ self.o[:STATE] + hb @ self.o[STATE:])).sum(axis=0) + self.c[0]
        if trace is not None:
            h = np.concatenate([hf, hb], axis=2)
            trace.update(tf=tf, tb=tb, h=h, m=m, w=w, pooled=np.einsum("tn,tnk->nk", w, h))
        return logit

    def logits(self, proj: list, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(proj, ids[a : a + AT_ONCE]) for a in range(0, len(ids), AT_ONCE)])

    def backward(self, g: np.ndarray, tr: dict, ids: np.ndarray, x: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the word vectors, from those of the logits."""
        d = {"o": tr["pooled"].T @ g, "c": np.array([g.sum()], np.float32)}
        dp = g[:, None] * self.o
        dw = np.einsum("nk,tnk->tn", dp, tr["h"])
        dh = tr["w"][:, :, None] * dp
        ds = tr["w"] * (dw - (tr["w"] * dw).sum(axis=0))
        d["v"] = np.einsum("tn,tnk->k", ds, tr["m"])
        dm = ds[:, :, None] * self.v * (1 - tr["m"] ** 2)
        d["a"] = np.tensordot(tr["h"], dm, axes=([0, 1], [0, 1]))
        dh = dh + dm @ self.a.T
        dx, flat = np.zeros_like(x), np.ascontiguousarray(ids.T)
        order = np.argsort(flat.ravel(), kind="stable")
        at, first = np.unique(flat.ravel()[order], return_index=True)
        for side, trace, w, u in (("f", tr["tf"], self.wf, self.uf), ("b", tr["tb"], self.wb, self.ub)):
            part = dh[:, :, :STATE] if side == "f" else dh[:, :, STATE:]
            all_gates, du, back = np.empty((len(flat), len(g), 3 * STATE), np.float32), np.zeros_like(u), np.zeros((len(g), STATE), np.float32)
            for t, h, z, r, q, gq in reversed(trace):
                dn = part[t] + back
                dz, dq = dn * (q - h) * z * (1 - z), dn * z * (1 - q * q)
                dr = dq * gq * r * (1 - r)
                all_gates[t] = np.concatenate([dz, dr, dq], axis=1)
                dg = np.concatenate([dz, dr, dq * r], axis=1)
                du += h.T @ dg
                back = dn * (1 - z) + dg @ u.T
            dproj = np.zeros((len(x), 3 * STATE), np.float32)
            dproj[at] = np.add.reduceat(all_gates.reshape(-1, 3 * STATE)[order], first, axis=0)
            dproj[-1] = 0
            d["w" + side], d["u" + side], d["b" + side] = x.T @ dproj, du, dproj.sum(axis=0)
            dx += dproj @ w.T
        return d, dx

    def vectors(self, feats: list[list[int]], share: float | np.ndarray = 1.0) -> np.ndarray:
        """Word vectors, and the zero vector of "no word" at the end; ``share``: weight of the word table's part."""
        x = np.zeros((len(feats) + 1, INPUT), np.float32)
        if feats:
            n = np.array([len(f) - 1 for f in feats])
            flat = np.concatenate([f[1:] for f in feats]).astype(int)
            x[:-1] = np.add.reduceat(self.e[flat], np.cumsum(n) - n, axis=0) / n[:, None] + np.float32(share) * self.e[[f[0] for f in feats]]
        return x


def taken(n: int, key: int) -> np.ndarray:
    """Starts of the windows over n words that training takes: all, or TRAIN_WINDOWS that a hash picks all over the text."""
    s = windows(n)
    return s if len(s) <= TRAIN_WINDOWS else np.sort(s[np.argsort([zlib.crc32(f"{key} {a}".encode()) for a in s], kind="stable")[:TRAIN_WINDOWS]])


def fit(texts: list[list[str]], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """``texts``: the words of each document."""
    return fit_windows([[t[a : a + WINDOW] for a in windows(len(t))] for t in texts], [len(windows(len(t))) for t in texts], labels, epochs, seed)


def fit_windows(texts: list[list[list[str]]], counts: list[int], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """``texts``: windows of each document, each a list of words; ``counts``: how many windows it has in all."""
    net = Network()
    if len(set(labels)) < 2:
        net.prior = float(np.mean(labels)) if labels else 0.0
        return net
    vocabulary = sorted({w for t in texts for x in t for w in x})
    index = {w: i for i, w in enumerate(vocabulary)}
    feats = [features(w) for w in vocabulary]
    nothing, y = len(vocabulary), np.array(labels)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ids = np.full((len(owner), WINDOW), nothing, dtype=np.int32)
    for row, x in zip(ids, (x for t in texts for x in t), strict=True):
        row[: len(x)] = [index[w] for w in x]
    grad2 = {n: np.full_like(getattr(net, n), 1e-6) for n in Network.NAMES}
    rng, weight = np.random.default_rng(seed), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), 0.15 * (1 - epoch / epochs) + 0.01
        # The worst window of each document learns, and of clean documents one more at random.
        logit = net.logits(net.project(net.vectors(feats, 1 - WORD_DROP)), ids)
        by = np.lexsort((logit if epoch else rng.random(len(owner)), owner))
        last = np.flatnonzero(np.r_[owner[by][1:] != owner[by][:-1], True])
        begin = np.r_[0, last[:-1] + 1]
        worst, more = by[last], by[begin + (rng.random(len(y)) * (last - begin + 1)).astype(int)]
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            pick = np.concatenate([worst[docs], more[docs][y[docs] == 0]] if epoch else [worst[docs], more[docs]])
            used, local = np.unique(ids[pick], return_inverse=True)
            used = used if used[-1] == nothing else np.r_[used, nothing]
            local = local.reshape(len(pick), WINDOW)
            mine = [feats[i] for i in used[:-1]]
            kept = (rng.random((len(mine), 1)) >= WORD_DROP).astype(np.float32)
            x = net.vectors(mine, kept)
            tr: dict = {}
            p = _sigmoid(net.forward(net.project(x), local, tr))
            w = weight[owner[pick]]
            d, dx = net.backward((w * (p - y[owner[pick]]) / w.sum()).astype(np.float32), tr, local, x)
            if mine:
                rows_ = np.concatenate(mine).astype(int)
                n = np.array([len(f) for f in mine])
                part = np.repeat(dx[:-1] / (n[:, None] - 1), n, axis=0)
                part[np.cumsum(n) - n] = dx[:-1] * kept
                at, inverse = np.unique(rows_, return_inverse=True)
                de = np.zeros((len(at), INPUT), np.float32)
                np.add.at(de, inverse, part)
                grad2["e"][at] += de**2
                net.e[at] -= rate * de / np.sqrt(grad2["e"][at])
            for name in Network.NAMES[1:]:
                value, s = getattr(net, name), grad2[name]
                s += d[name] ** 2
                value -= rate * d[name] / np.sqrt(s)
    net.e[:WORDS] *= 1 - WORD_DROP
    # The curve of documents: the worst logit and the number of windows.
    logit = net.logits(net.project(net.vectors(feats)), ids)
    top = np.full(len(y), -1e9)
    np.maximum.at(top, owner, logit)
    a = np.stack([np.clip(top, -15, 15), np.log(counts), np.ones(len(y))], axis=1)
    c = np.array([1.0, 0.0, 0.0])
    for _ in range(60):
        p = _sigmoid(np.clip(a @ c, -30, 30))
        h = (a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a / len(y) + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, a.T @ (y - p) / len(y) - 1e-3 * (c - [1.0, 0.0, 0.0]))
        c = c + np.clip(step, -2, 2)
    net.curve = c
    return net


class Scorer:
    """Executor side: remembers the projected input of words."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.proj = [[np.zeros((1024, STATE), np.float32) for _ in range(3)] for _ in range(2)]

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.index))
        if len(self.index) + len(new) > MEMORY and self.index:
            self.index.clear()
            new = list(words)
        start, end = len(self.index), len(self.index) + len(new)
        self.index.update(zip(new, range(start, end), strict=True))
        if end + 1 > len(self.proj[0][0]):
            self.proj = [[np.concatenate([g, np.zeros((max(end + 1, 2 * len(g)) - len(g), STATE), np.float32)]) for g in side] for side in self.proj]
        for a in range(0, len(new) + 1, 20_000):  # the row after the last is that of "no word"
            got = self.net.project(self.net.vectors([features(w) for w in new[a : a + 20_000]]))
            for side, more in zip(self.proj, got, strict=True):
                for g, m in zip(side, more, strict=True):
                    g[start + a : start + a + len(m)] = m

    def score(self, texts: list[str | None]) -> np.ndarray:
        net = self.net
        if net.prior is not None:
            return np.full(len(texts), net.prior)
        top, count = np.full(len(texts), -1e9), np.zeros(len(texts), dtype=np.int64)
        short = [k for k, t in enumerate(texts) if len(t or "") <= PIECE]
        if short:
            top[short], count[short] = self._worst([_WORD.findall((texts[k] or "").lower()) for k in short])
        for k in set(range(len(texts))).difference(short):
            for words in _chunks(texts[k]):
                a, n = self._worst([words])
                top[k], count[k] = max(top[k], a[0]), count[k] + n[0]
        z = np.stack([np.clip(top, -15, 15), np.log(np.maximum(count, 1)), np.ones(len(texts))], axis=1) @ net.curve
        return _sigmoid(np.clip(z, -30, 30))

    def _worst(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Greatest logit and number of windows of each list of words."""
        net = self.net
        self._learn({w for t in words for w in t})
        nothing = len(self.index)
        flat, starts, owner, at = [], [], [], 0
        for k, t in enumerate(words):
            flat.append(np.fromiter(map(self.index.__getitem__, t), dtype=np.int64, count=len(t)))
            flat.append(np.full(WINDOW, nothing))
            s = windows(len(t))
            starts.append(s + at)
            owner.append(np.full(len(s), k))
            at += len(t) + WINDOW
        flat, starts, owner = np.concatenate(flat), np.concatenate(starts), np.concatenate(owner)
        proj = [[g[: nothing + 1] for g in side] for side in self.proj]
        top, count = np.full(len(words), -1e9), np.bincount(owner, minlength=len(words))
        steps = np.arange(WINDOW)
        for a in range(0, len(starts), AT_ONCE):
            np.maximum.at(top, owner[a : a + AT_ONCE], net.forward(proj, flat[starts[a : a + AT_ONCE, None] + steps]))
        return top, count


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep=None, bound: int = SAMPLE) -> Network:
    """Fits on at most ``bound`` labelled documents, of which the driver gets at most TRAIN_WINDOWS windows each."""
    sample = labelled_sample(labels, id_col, label_col, F.lit(True) if keep is None else keep, bound)
    few = labelled_texts(docs, sample, id_col, text_col).select(F.col("_y").cast("int").alias("_y"), "t")

    def cut(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py().lower()
                words = _WORD.findall(text)
                # Words hold no blank, so a window travels as one string.
                found = [" ".join(words[a : a + WINDOW]) for a in taken(len(words), zlib.crc32(text.encode("utf-8", "replace")))]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([found], pa.list_(pa.string())), pa.array([len(windows(len(words)))], pa.int32())], names=["y", "windows", "n"])

    rows = sorted((r.y, list(r.windows), r.n) for r in few.mapInArrow(cut, "y int, windows array<string>, n int").collect())
    return fit_windows([[w.split() for w in t] for _, t, _ in rows], [n for *_, n in rows], [y for y, *_ in rows])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    target = docs.select(id_col, text_col)

    def work(batches):
        s = Scorer(shared.value)
        for b in batches:
            at = 0
            while at < b.num_rows:
                to, size = at, 0
                texts = []
                while to < b.num_rows and (not texts or size < PIECE):
                    texts.append(b.column(1)[to].as_py())
                    size += len(texts[-1] or "")
                    to += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(s.score(texts))], names=[id_col, "score"])
                at = to

    return target.mapInArrow(work, f"`{id_col}` {target.schema[0].dataType.simpleString()}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = train(docs, labels, keep=fold("_id", 5) != 0)
    return score(docs, net).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
