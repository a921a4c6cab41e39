"""Rows without an id: they join what they are like, and the pipeline decides on each of them."""

import math

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import egojoin, hilbert, langid, mixing, simhash
from tessera.llm.common import Scratch, labelled_sample, labelled_texts


def test_a_null_id_joins_its_neighbours_fingerprints(spark):
    """1 and 2 are 6 bits apart, the middle is 3 from each: with and without an id of its own it joins them."""
    for middle in (3, None):
        s = Scratch(spark, "t")
        rows = [(1, 0), (middle, 0b111), (2, 0b111111), (9, (1 << 60) - 1), (None, (1 << 60) - 1), (None, 0x3333333333333333)]
        rows = s.put("rows", spark.createDataFrame([(i, f, f) for i, f in rows], "doc_id bigint, fp bigint, rep bigint"))
        nodes = s.put("nodes", rows.groupBy("rep", "fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
        got = {(r.doc_id, r.fp, r.component_id) for r in simhash._told(rows, nodes, simhash.links(nodes, 4, s), s).collect()}
        assert got == {(1, 0, 1), (middle, 7, 1), (2, 63, 1), (9, (1 << 60) - 1, 9), (None, (1 << 60) - 1, 9), (None, 0x3333333333333333, None)}


def test_a_null_id_joins_its_neighbours_vectors(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    for middle in (3, None):
        df = spark.createDataFrame([(1, at(0), 5), (middle, at(10), 5), (2, at(20), 5), (7, at(90), 5), (None, at(180), 5)], "vec_id bigint, embedding array<double>, label int")
        got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in egojoin.near_duplicates(df).collect()}
        assert got >= {(1, 1, 1, True), (2, 1, 1, False), (7, 0, 7, True), (None, 0, None, False)}
        assert (middle, 2, 1, False) in got and len(got) == 5


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_near_duplicates_decide_on_rows_without_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (None, long), (None, long + " z"), (None, "other words here"), (None, "other words here"), (2, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == [(False, 1, long), (False, 2, "a b"), (True, None, "other words here")]


def test_mixing_decides_on_rows_without_ids(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, f"w{i} " * 20, "en", "ab"[i % 2], 1) for i in range(200)], SCHEMA)
    out = pipeline.mixing_stage(spark, docs, "")
    sizes = {r.source: 20 * r["count"] for r in out.groupBy("source").count().collect()}
    # 4,000 words in two sources of 2,000 that weigh 5 and 2 and stop at twice their size
    assert abs(sizes["a"] - 4000) <= 40 and abs(sizes["b"] - 2000) <= 40
    assert {r.text for r in out.where("doc_id is null").collect()} == {f"w{i} " * 20 for i in range(1, 200, 2)}


def test_many_copies_of_one_vector_are_one_node(spark):
    """A third of all rows are one vector: they are told, but never compared with each other."""
    n = 30_000
    df = spark.range(n + 3).selectExpr("id AS vec_id", f"CASE WHEN id < {n} THEN array(1f, 0f, 0.5f) WHEN id = {n} THEN array(1f, 0.01f, 0.5f) WHEN id = {n + 1} THEN array(0f, 1f, 0f) END AS embedding", "1 AS label")
    got = egojoin.near_duplicates(df).groupBy("n_links", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(n, 0, True, 1), (n, 0, False, n), (0, n + 1, True, 1), (0, n + 2, True, 1)}


def test_near_duplicates_decide_by_row(spark):
    """Rows of one id with different texts stay or go each for its own text."""
    a, b, p, q = (" ".join(f"{c}{i}" for i in range(40)) for c in "abpq")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(3, a), (7, a), (7, b), (9, p), (9, q), (9, q)]], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == [(3, a), (7, b), (9, p), (9, q)]


def test_no_bucket_of_the_mixture_holds_an_id(spark, monkeypatch):
    """Rows without an id, and rows of one id, spread over the buckets; the mix still reaches its targets."""
    for key in ("CAST(NULL AS BIGINT)", "5L"):
        docs = spark.range(50_000).selectExpr(f"{key} AS doc_id", "repeat('w ', 1 + CAST(id % 7 AS INT)) AS text", "'s' AS source")
        real = mixing.pivot
        folder = spark.sparkContext.accumulator(0)

        def pivot(ids, *rest, real=real, folder=folder):
            folder.add(len(ids) > 2 * mixing.FAN)
            return real(ids, *rest)

        monkeypatch.setattr(mixing, "pivot", pivot)
        rows = mixing.mix(docs, share=1.3).selectExpr("sum(size) a", "sum(taken) b", "max(target) t", "count(*) n").first()
        monkeypatch.undo()
        assert rows.n == 50_000 and abs(rows.b - rows.t) <= 7 and folder.value == 0


def test_a_very_long_text_in_the_mixture(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w w", "a"), (3, "w", "b")], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(docs).collect()}
    assert got[1][0] == 300_000 and all(taken <= 2 * size for size, taken in got.values())


def test_every_row_is_a_candidate(spark):
    """The second vector of a repeated id and a row without an id are found; a repeated query id has two lists."""
    rows = [(0, [1.0, 0.0]), (5, [0.9, 0.0]), (5, [2.0, 0.0]), (7, [0.1, 0.1]), (None, [1.5, 0.0]), (20, [0.5, 0.5]), (20, [0.0, 3.0]), (9, None), (8, [0.0, 0.0])]
    rows = [(i, v and v + [0.0] * 6) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = hilbert.search(df, k=3).collect()
    lists = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=str)
    assert [x for x in lists if x[0] == 0] == [(0, 1, 5, 2.0), (0, 2, None, 1.5), (0, 3, 5, 0.9)]
    assert len([r for r in got if r.query_id == 20]) == 6
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    want = sorted(con.execute(hilbert.OP4_SQL).fetchall(), key=str)
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert.search(df).collect()), key=str) == want


def test_a_language_is_learnt_from_its_own_rows(spark):
    """Rows of one id with several languages, or with none: text and language come from one row."""
    rows = [(1, "zz bonjour", "fr"), (1, "aa hello", "en"), (3, "mm tekst", None), (3, "nn guten", "de"), (4, None, "es")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = labelled_sample(docs, "doc_id", "lang", F.lit(True), 100)
    got = sorted((r._y, r.t) for r in labelled_texts(docs.where("text is not null"), sample, "doc_id", "text", "lang").collect())
    assert got == [("de", "nn guten"), ("fr", "zz bonjour")]
    model = langid.train(docs)
    assert model.names == ["de", "fr"]
    assert {r.lang_pred for r in langid.identify(docs, model).where("score > 0").collect()} == {"de", "fr"}
