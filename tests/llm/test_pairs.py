"""SimHash, epsilon grid join, nearest neighbours and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import egojoin, hilbert, overlap, simhash
from tessera.llm.common import Scratch, connected_components

from .helpers import cosine_groups, groups, nearest, simhash_groups


def test_components(spark):
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5300)]
    df = spark.createDataFrame(pairs + [(7, 7), (None, 3), (3, None)], "u bigint, v bigint")
    got = {x.node: x.component for x in connected_components(df, Scratch(spark, "t")).collect()}
    want = groups({i for p in pairs for i in p}, pairs)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def naive_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("text", ["", None, "a", "A b c", "a b c d", "a b c d e \n\t f" * 30, "É x y z w v"])
def test_fingerprints(spark, monkeypatch, text):
    assert simhash.fingerprint(text, 4) == naive_fingerprint(text, 4)
    monkeypatch.setattr(simhash, "LONG", 3)
    monkeypatch.setattr(simhash, "AT_ONCE", 2)
    assert simhash.fingerprint(text, 4) == naive_fingerprint(text, 4)
    if text:
        assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h % 2**64 == xxhash.xxh64_intdigest(text.encode(), seed=42)


def fingerprints():
    r = np.random.default_rng(0)
    base, out = r.integers(0, 2**63, 30).astype(np.uint64), set()
    for i in range(900):
        c = base[0] if i < 400 else base[r.integers(30)]
        for b in r.choice(64, r.integers(0, 7), replace=False):
            c = c ^ np.uint64(1 << int(b))
        out.add(int(np.uint64(c).view(np.int64)))
    return sorted(out)


@pytest.mark.parametrize("block,searched", [(4096, None), (32, None), (32, [(list(range(22)), 1), (list(range(22, 43)), 1), (list(range(43, 64)), 0)])])
def test_simhash_links(spark, monkeypatch, block, searched):
    monkeypatch.setattr(simhash, "BLOCK", block)
    if searched:
        monkeypatch.setattr(simhash, "plan", lambda *a: searched)
    fps = fingerprints()
    ids = [int(i) for i in np.random.default_rng(2).permutation(len(fps))]
    s = Scratch(spark, "t")
    nodes = spark.createDataFrame(list(zip(fps, ids)), "fp bigint, rep bigint")
    got = {x.node: x.component for x in connected_components(simhash.links(nodes, 4, s), s).collect()}
    want = simhash_groups(fps, ids, 4)
    assert {i: got.get(i, i) for i in ids} == want


def test_thresholds_cover_every_pair():
    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (300, 64)).astype(float)
    for n in (1e3, 1e6, 1e10):
        for distance in (0, 1, 4, 6):
            chosen = simhash.plan(int(n), bits.T @ bits * n / 300, distance)
            used = sorted(b for g, _ in chosen for b in g)
            assert len(used) == len(set(used))
            assert sum(t + 1 for _, t in chosen) == distance + 1  # general pigeonhole


@pytest.mark.parametrize("block", [4096, 16])
def test_verified_links(spark, monkeypatch, block):
    """Fingerprints of short shingles find, signatures of long ones decide: as all pairs do."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(7)
    base = [[f"w{int(k)}" for k in r.integers(0, 3000, 120)] for _ in range(8)]
    texts = []
    for i in range(240):
        t = list(base[i % 8])
        for k in r.choice(120, int(r.integers(0, 9)), replace=False):
            t[int(k)] = f"x{int(r.integers(9000))}"
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, ""), (901, None)], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in simhash.components(df, shingle=2, distance=8, verify=(5, 46)).collect()}
    sigs, fps = np.stack([simhash.signature(t, 5, 4) for t in texts]), np.array([simhash.fingerprint(t, 2) for t in texts], dtype=np.uint64)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 8) & (np.bitwise_count(sigs[:, None] ^ sigs[None]).sum(axis=2, dtype=int) <= 46)
    want = groups(list(range(240)), [(int(a), int(b)) for a, b in np.argwhere(near)])
    assert {i: got[i] for i in range(240)} == want and got[901] == got[900] == 900
    assert 8 <= len(set(want.values())) < 240 and int(sigs[0][0]) == simhash.fingerprint(texts[0], 5)


def test_simhash_of_documents(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (3, text, 1), (9, text + " x", 1), (4, None, 1), (8, "", 1), (2, "one two", 1), (2, "one two", 1), (None, text, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = simhash.components(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    fps = {i: naive_fingerprint(t, 4) for i, t, _ in rows if i is not None}
    want = simhash_groups([int(np.uint64(f).view(np.int64)) for f in fps.values()], list(fps), 4)
    assert len(got) == len(rows) and {i: {c} for i, c in want.items()} == {i: c for i, c in by.items() if i is not None} and by[None] == {3}
    assert simhash.components(df.limit(0)).count() == 0


def vectors():
    r = np.random.default_rng(0)
    c = r.normal(size=(25, 8))
    v, labels = [], []
    for i in range(500):
        k = 0 if i < 200 else int(r.integers(25))
        v.append((c[k] + r.normal(size=8) * (0 if i % 3 == 0 else 0.12)).tolist())
        labels.append(k % 3)
    return v, labels, [int(i) for i in r.permutation(500)]


@pytest.mark.parametrize("block,leaf", [(1024, 128), (16, 4)])
def test_epsilon_grid_join(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "LEAF", leaf)
    v, labels, ids = vectors()
    odd = [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [float("nan")] * 8, 1), (5003, v[0], None), (5004, [1.0, 2.0], 1), (5005, [1.0, None] * 4, 1), (5006, [], 1)]
    df = spark.createDataFrame([*zip(ids, v, labels), *odd], "vec_id bigint, embedding array<double>, label int").withColumn("block", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in egojoin.near_duplicates(df).collect()}
    assert {i: got[i] for i in ids} == cosine_groups(v, labels, ids, 0.98)
    assert all(got[o[0]] == (0, o[0]) for o in odd)
    assert egojoin.near_duplicates(df.limit(0)).count() == 0


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        g = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert.hilbert_keys(g, bits)
        assert sorted(keys) == list(range(len(g)))
        assert (np.abs(np.diff(g[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block,window", [(1024, 128), (16, 8)])
def test_neighbours(spark, monkeypatch, block, window):
    monkeypatch.setattr(hilbert, "BLOCK", block)
    monkeypatch.setattr(hilbert, "WINDOW", window)
    v, _, ids = vectors()
    v[17] = [3 * x for x in v[17]]  # norms differ
    odd = [(600, None), (620, [0.0] * 8), (640, [float("inf")] * 8), (None, v[0])]
    df = spark.createDataFrame([*zip(ids, v), *odd], "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in sorted(hilbert.search(df, k=20, every=20).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == nearest(v, ids, 20, 20)
    assert hilbert.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in sorted(hilbert.search(few).collect())] == [(1, 1), (2, 2)]


def test_curve_windows_recall(spark):
    """Windows alone, on vectors with structure."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 32))
    v = [(centres[i % 60] + 0.25 * r.normal(size=32)).tolist() for i in range(1800)]
    ids = list(range(1800))
    want = nearest(v, ids, 20, 20)
    got = {}
    for x in hilbert.search(spark.createDataFrame(list(zip(ids, v)), "vec_id bigint, embedding array<double>"), complete=False).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in n}) / len(n) for q, n in want.items()]) >= 0.9


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_similarity_decides(spark, monkeypatch, block):
    """Block and scattered edits: what has 0.8 of the five-word shingles links, what has less does not."""
    monkeypatch.setattr(simhash, "WIDE", block)
    r = np.random.default_rng(11)
    texts = []
    for i in range(160):
        t = [f"w{int(k)}" for k in r.integers(0, 10**6, 250)]
        at, n = int(r.integers(220)), int(r.integers(18, 25))
        places = range(at, at + n) if i % 2 else r.choice(250, int(r.integers(4, 9)), replace=False)
        texts.append(" ".join(t))
        for k in places:
            t[int(k)] = f"x{int(r.integers(10**6))}"
        texts.append(" ".join(t))
    odd = "same " * 300  # one shingle outweighs all others: equal signatures, unlike sets
    texts += [odd + " ".join(f"p{i}" for i in range(20)), odd + " ".join(f"q{i}" for i in range(20))]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 80 < len(near) < 150
    df = spark.createDataFrame([*enumerate(texts), (900, ""), (901, None), (902, texts[0]), (None, texts[0])], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in simhash.components(df, shingle=2, distance=16, verify=(5, 80, 0.8)).collect()}
    want = groups(list(range(len(texts))), near)
    wrong = {i for i in want if got[i] != want[i]}
    assert len(wrong) <= 2 and all(got[i] == i for i in wrong)  # a candidate in a hundred may be past the distance
    assert got[901] == got[900] == 900 and got[902] == got[None] == 0


def test_pipeline_rule_is_the_exact_one(spark):
    """A block replaced at 0.82 goes, eight scattered words at under 0.75 stay."""
    import corpus_pipeline as pipeline

    r = np.random.default_rng(12)
    texts = []
    for i in range(60):
        t = [f"w{int(k)}" for k in r.integers(0, 10**6, 250)]
        texts.append(" ".join(t))
        at = int(r.integers(220))
        for k in range(at, at + 20) if i % 2 else range(5, 250, 32):
            t[k] = f"x{int(r.integers(10**6))}"
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {x.doc_id for x in pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert {i for i in range(120) if i % 4 != 3} <= kept and len(kept) <= 91


@pytest.mark.parametrize("cell", [2048, 4])
def test_no_similar_pair_is_left_out(spark, monkeypatch, cell):
    """Few words, phrases said often or once, one template for all: components are those of all pairs of 0.8 and more."""
    monkeypatch.setattr(overlap, "CELL", cell)
    r = np.random.default_rng(21)

    def words(n):
        return [f"w{int(k)}" for k in r.integers(0, 10**6, n)]

    texts, form = [], words(150)
    for _ in range(12):
        t, phrase = words(60), words(5)
        texts += [t + phrase * 2, t + phrase * 150 + words(1)]  # nearly the same set, unlike fingerprints
    for _ in range(60):
        t = words(int(r.integers(5, 14)))
        texts += [t, [*t, *words(1)]]  # 0.8 is four of five shingles
    for k in range(60):
        texts.append(form + words(25 + k % 20))  # similarities on both sides of 0.8
    texts = [" ".join(t) for t in texts]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([*enumerate(texts), (900, ""), (901, None), (902, texts[0]), (None, texts[0])], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in simhash.components(df, shingle=2, distance=16, verify=(5, 80, 0.8)).collect()}
    want = groups(list(range(len(texts))), near)
    assert 60 < len(set(want.values())) < 190 and {i for i in want if got[i] != want[i]} == set()
    assert got[901] == got[900] == 900 and got[902] == got[None] == got[0]


def test_every_missed_link_is_found(spark):
    """Sets of all sizes in groups given beforehand: the links between groups are those of all pairs."""
    r = np.random.default_rng(22)
    sets = []
    for k in range(260):
        own = r.integers(-(2**62), 2**62, int(r.integers(1, 90)))
        part = r.choice(own, int(np.ceil(len(own) * r.uniform(0.75, 1))), replace=False)
        sets += [own, np.r_[part, r.integers(-(2**62), 2**62, int(r.integers(0, 3)))]]
    sets = [np.unique(np.r_[x, 7, 8].view(np.uint64)).view(np.int64) for x in sets]
    grp = [int(r.integers(0, 30)) for _ in sets]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if grp[a] != grp[b] and (n := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    heads = [overlap.head(x.view(np.uint64), 0.8) for x in sets]
    df = spark.createDataFrame([(k, g, s.tolist(), *h) for k, (g, s, h) in enumerate(zip(grp, sets, heads, strict=True))], "key bigint, grp bigint, shingles array<bigint>, head binary, need bigint")
    some = {x.key for x in overlap.suspects(df, df.select("key", "need")).collect()}
    assert {k for pair in want for k in pair} <= some
    got = overlap.links(df.where(F.col("key").isin(sorted(some))), 0.8, Scratch(spark, "t")).collect()
    assert len(want) > 80 and {(x.u, x.v) for x in got} == want and len(got) == len(want)


def test_a_sieve_misses_no_id(spark, monkeypatch):
    ids = [*range(0, 3000, 2), -5, -(2**63), 2**63 - 1]
    table = spark.createDataFrame([(i,) for i in [*ids, None]], "least bigint")
    others = np.arange(1, 60001, 2)
    held = simhash.sieve(table)
    assert simhash.passes(held, np.array(ids)).all() and simhash.passes(held, others).mean() < 0.02
    some = simhash.in_sieve(held)
    rows = spark.createDataFrame([(i,) for i in [*ids, *others[:2000].tolist(), None]], "id bigint")
    through, rest = ([x.id for x in rows.where(c).collect()] for c in (some("id"), ~some("id")))
    assert set(ids) <= set(through) and len(through) + len(rest) == rows.count() and len(rest) > 1900
    monkeypatch.setattr(simhash, "SIEVE_MOST", 1024)  # too few bits let more pass
    held = simhash.sieve(table)
    assert len(held) == 16 and simhash.passes(held, np.array(ids)).all()
    assert not simhash.passes(simhash.sieve(table.limit(0)), others).any()


def test_only_sets_in_question_travel(spark, monkeypatch):
    """Sets of texts without a candidate stay where they are, also where the keys are too many to be broadcast; of rows
    with one id and rows without, those in question are among the ones that travel."""
    seen, made = [], simhash.shingle_sets
    monkeypatch.setattr(simhash, "shingle_sets", lambda *a: seen.append(made(*a)) or seen[-1])
    r = np.random.default_rng(23)

    def words(n):
        return [f"w{int(k)}" for k in r.integers(0, 10**6, n)]

    rows = [(i, " ".join(words(60))) for i in range(400)]
    for i in range(400, 440, 2):
        t = words(10)
        rows += [(i, " ".join(t)), (i + 1, " ".join([*t, *words(1)]))]  # five of six shingles and more
    one, two, other = " ".join(words(40)), words(60), " ".join(words(50))
    rows += [(7, one), (7, " ".join(two)), (500, " ".join([*two, "x"])), (None, other), (None, other + " y"), (501, other + " z")]
    texts = [t for _, t in rows]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = groups(list(range(len(rows))), near)
    least = {}
    for k, c in found.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, 1 << 62), rows[k][0])
    want = sorted((str(rows[k][0]), least[c]) for k, c in found.items())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = simhash.components(df, shingle=2, distance=16, verify=(5, 80, 0.8)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((str(x.doc_id), x.component_id) for x in got) == want and len(near) >= 20
    assert len(seen) == 2 and all(s.count() <= 80 for s in seen), [s.count() for s in seen]


def test_shuffle_files_go_with_the_write(spark):
    """What a scratch table's write has shuffled is gone from the disk when the next begins."""
    import glob
    import time

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{local}/*/shuffle_*"))
    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    s = Scratch(spark, "t")
    kept = s.put("a", spark.range(50_000).withColumn("k", F.col("id") % 999).groupBy("k").count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 999 and spark.conf.get(setting) == was


def test_search_in_parts(spark, monkeypatch):
    """Few probes a text are on disk at once, blocks of a bucket meet in cells of several, pairs are decided in slices and hashes
    counted in slices: the components are those of all pairs, and of no table is there more than a part."""
    monkeypatch.setattr(simhash, "WIDE", 8)
    monkeypatch.setattr(simhash, "PROBES", 3)
    monkeypatch.setattr(simhash, "PROBES_LEAST", 0)
    monkeypatch.setattr(simhash, "TOGETHER", 2)
    monkeypatch.setattr(overlap, "FEW", 0)
    monkeypatch.setattr(simhash, "plan_wide", lambda *a: [(list(range(64 * k, 64 * k + 3)), 0) for k in range(6)])
    put, sizes = Scratch.put, {}

    def counted(self, name, df):
        out = put(self, name, df)
        sizes[name] = out.count()
        return out

    entries, probes = simhash.entries, []
    monkeypatch.setattr(Scratch, "put", counted)
    monkeypatch.setattr(simhash, "entries", lambda nodes, searched, words: probes.append(sum(len(simhash.ball(len(b), t)) for b, t in searched)) or entries(nodes, searched, words))
    r = np.random.default_rng(31)
    texts = []
    for _ in range(12):
        t = [f"w{int(k)}" for k in r.integers(0, 10**6, 120)]
        for _ in range(12):
            texts.append(" ".join([*t[: int(r.integers(90, 120))], *[f"x{int(k)}" for k in r.integers(0, 10**6, int(r.integers(0, 12)))]]))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {x.doc_id: x.component_id for x in simhash.components(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"), shingle=2, distance=16, verify=(5, 80, 0.8)).collect()}
    assert got == groups(list(range(len(texts))), near) and len(near) > 300
    assert probes == [3, 3]
    assert sizes["pairs"] / sum(n.startswith("near") for n in sizes) <= len(texts) / 8 + 1
    assert {f"shared{k}" for k in range(overlap.SLICES)} <= sizes.keys()
