"""What lies late in long texts, lines and words counts like what lies early; models against plain versions."""

import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, quality, secrets, toxicity


def test_a_line_of_any_length_is_one_line(monkeypatch):
    r = np.random.default_rng(3)
    lines = [" ".join("w" * int(r.integers(1, 30)) if r.random() < 0.7 else "same" for _ in range(n)) for n in (40, 1, 90, 25)] + ["x" * 250, "a  b ", "", " lead", "é ü ß" * 30, "same " * 60]
    text = "\n".join(lines)
    whole = quality.line_statistics([text, "tail"])
    for piece in (7, 20, 64):
        monkeypatch.setattr(quality, "AT_ONCE", piece)
        got = quality.line_statistics([text, "tail"])
        assert got[2].tolist() == whole[2].tolist() == [len(lines), 1]
        assert (got[1] == whole[1]).all() and np.allclose(got[0], whole[0]), piece


def test_training_stretches_lie_all_over():
    taken = quality.stretches(10_000, 5)
    assert sum(b - a for a, b in taken) == quality.TRAIN_LINES and taken[-1][0] > 5000 and quality.stretches(30, 1) == [(0, 30)]
    starts = toxicity.taken(100_000, 5)
    assert len(starts) == toxicity.TRAIN_WINDOWS and starts.max() > 50_000


def test_toxic_words_late_in_training_texts(spark):
    """The only telling words come after the first 600, and differ from a clean word after their 40th character."""
    r = np.random.default_rng(1)
    long = "q" * 45
    bad, good = f"{long}venom", f"{long}honey"
    rows = []
    for i in range(160):
        t = [f"w{int(k)}" for k in r.integers(0, 60, 700)]
        t[int(r.integers(620, 690))] = bad if i % 2 else good
        rows.append((i, " ".join(t), i % 2))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    net = toxicity.train(df, df)
    s = toxicity.Scorer(net).score([f"w1 w2 {bad} w3", f"w1 w2 {good} w3"])
    assert s[0] > 0.5 > s[1]


def test_bad_lines_late_in_training_texts(spark):
    """Bad documents are clean for their first 300 lines."""
    clean, bad = "this is a quiet line of words\n", "BUY!!! NOW!!! $$$ ||| 999 999 999\n"
    rows = [(i, clean * 300 + (bad if i % 2 else clean) * 300, 1 - i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(df, df)
    s = model.score([clean * 100, bad * 100, clean * 300 + bad * 300])
    assert s[0] > 0.7 > max(s[1:])


def test_one_text_an_id(spark):
    """A labelled id of very many rows gives one text to the driver."""
    docs = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('w', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, toxic int")
    from tessera.llm.common import labelled_sample, labelled_texts

    assert labelled_texts(docs, labelled_sample(labels, "doc_id", "toxic", F.lit(True), 100), "doc_id", "text").count() == 2


def test_rare_labels_stay_in_the_sample(spark):
    from tessera.llm.common import labelled_sample

    labels = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 5000 = 7 THEN 'rare' ELSE 'common' END AS lang")
    got = {r._y: r["count"] for r in labelled_sample(labels, "doc_id", "lang", F.lit(True), 100).groupBy("_y").count().collect()}
    assert got["rare"] == 4 and got["rare"] + got["common"] <= 100


def test_letters(spark):
    model = langid.Language.fit([np.array([1, 2]), np.array([3])], ["a", "b"])
    texts = ["½", "① ²", "Ⅷ", "१२", "12 !?", None, "", "é", "x1", "漢", "ª"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True] * 7 + [False] * 4
    assert langid.identify(df.limit(0), model).count() == 0


def test_kernel_ridge_against_a_plain_one(monkeypatch):
    """With every text a landmark, Nyström's regression is kernel ridge regression: plain sets, a kernel matrix, one solve."""
    texts = ["the cat and the dog", "a dog of the house", "le chat et le chien", "la maison du chien", "der hund und die katze", "das haus der katze", "the end", "le jour"]
    labels, names = ["en", "en", "fr", "fr", "de", "de", "en", "fr"], ["de", "en", "fr"]
    new = ["the dog", "le chien", "die katze und der hund"]

    def grams(t):
        return set(np.flatnonzero(langid.presence([t])[0]).tolist())

    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([names.index(v) for v in labels])
    w = 1.0 / np.bincount(y)[y]
    w *= len(y) / w.sum()
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    # weighted ridge in the kernel's space: (K + ridge W^-1) alpha = target
    alpha = np.linalg.solve(k + langid.RIDGE * np.diag(1 / w), target)
    z = langid.SHARP * np.array([[kernel(grams(t), s) for s in sets] for t in new]) @ alpha
    want = np.exp(z - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    model = langid.Language.fit([np.array(sorted(s)) for s in sets], labels)
    assert np.allclose(model.scores(new), want, atol=2e-3)


def test_network_against_a_plain_one():
    """One window at a time, one step at a time."""
    net = toxicity.fit([["a", "bad", "c"], ["a", "c"], ["b", "bad"], ["b", "d"]] * 5, [1, 0, 1, 0] * 5, epochs=2)
    sig = lambda v: 1 / (1 + np.exp(-v))
    n = toxicity.STATE

    def states(xs, w, u, b):
        h, out = np.zeros(n), []
        for x in xs:
            g, c = x @ w + b, h @ u
            z, r = sig(g[:n] + c[:n]), sig(g[n : 2 * n] + c[n : 2 * n])
            h = (1 - z) * h + z * np.tanh(g[2 * n :] + r * c[2 * n :])
            out.append(h)
        return out

    def plain(text):
        words = re.findall(r"\w+", text.lower())
        logits = []
        for a in toxicity.windows(len(words)):
            f = [toxicity.features(w) for w in words[a : a + toxicity.WINDOW]]
            xs = [net.e[i[0]].astype(float) + net.e[i[1:]].astype(float).mean(axis=0) for i in f]
            h = np.array([np.r_[x, y] for x, y in zip(states(xs, net.wf, net.uf, net.bf), states(xs[::-1], net.wb, net.ub, net.bb)[::-1])])
            s = np.tanh(h @ net.a) @ net.v
            w = np.exp(s - s.max())
            logits.append((w / w.sum()) @ h @ net.o + net.c[0])
        return sig(np.array([np.clip(max(logits), -15, 15), np.log(len(logits)), 1.0]) @ net.curve)

    texts = ["a bad c", "b d", " ".join(f"w{k % 11}" for k in range(100)) + " bad"]
    assert np.allclose(toxicity.Scorer(net).score(texts), [plain(t) for t in texts], atol=1e-4)


def test_secrets_in_a_log_of_digests(spark):
    """Many spans in one text, found to the last; the model adds none that touches them."""
    n = 5000
    digests = [f"{k:032x}" for k in range(7 * 16**20, 7 * 16**20 + n)]
    text = "\n".join(f"id {d}" for d in digests)
    df = spark.createDataFrame([(1, text), (2, "Zk3Jx9QpLm2VbTyR8wNcD4")], "doc_id bigint, text string")
    ratios = secrets.train(secrets.default_samples(spark, df))
    got = {r.doc_id: r for r in secrets.scan(df, ratios).collect()}
    want = ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{24,}", text))
    assert got[1].n_hex == n and got[1].spans == want and got[2].n_markov == 1
    clean = {r.doc_id: r.text for r in secrets.redact(df, ratios).collect()}
    assert clean[1] == "\n".join(["id [SECRET]"] * n)


def test_the_ordinary_model_does_not_drift_with_the_corpus(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'some ordinary words of text' AS text")
    few, many = (np.array(secrets.train(secrets.default_samples(spark, d))) for d in (docs.limit(20), docs.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 500))))
    camel = "getUserNameFromOrderTable"
    mean = lambda m: np.mean([m[(ord(a) - 32) * 96 + ord(b) - 32] for a, b in zip(camel, camel[1:])])
    assert mean(few) < 0 and mean(many) < 0
