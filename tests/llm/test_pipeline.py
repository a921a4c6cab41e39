"""The pipeline's stages against what their operators decide, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import bpe, mixing, quality, secrets, simhash
from tessera.llm.common import Scratch, fold, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "pipeline"), table(spark, SF, "documents"), {}
    for name, stage in pipeline.STAGES:
        out[name] = (docs, scratch.put(name, stage(spark, docs, SF)))
        docs = out[name][1]
    return out


def test_columns(stages):
    for name, (_, out) in list(stages.items())[:-1]:
        assert out.columns == pipeline.COLUMNS, name


def test_quality(spark, stages):
    docs, out = stages["quality"]
    model = quality.train(docs, table(spark, SF, "labels"), keep=fold("_id", 4) != 2)
    want = {r.doc_id for r in quality.score(docs, model).where("score >= 0.7").collect()}
    assert {r.doc_id for r in out.collect()} == want and out.count() == len(want)


def test_near_duplicates(stages):
    docs, out = stages["near_duplicates"]
    groups = {}
    for r in simhash.components(docs, shingle=pipeline.SHINGLE, distance=pipeline.DISTANCE, verify=pipeline.VERIFY).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(r.doc_id for r in out.collect()) == sorted(groups)


def test_edited_copies_go_and_clean_documents_stay(spark):
    """Copies with a shingle similarity of 0.8 and more leave one, but for a few near 0.8; unlike texts all stay."""
    import random

    r = random.Random(5)
    texts, kinds = [], []
    for k in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(150)]
        for c in range(4):
            t = list(base)
            for _ in range(c):
                t[r.randrange(150)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(t))
            kinds.append(k)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [x.doc_id for x in pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted({kinds[i] for i in kept}) == list(range(12)) and len(kept) <= 16 and not any(i % 4 == 1 for i in kept)


def test_secrets(spark, stages):
    docs, out = stages["secrets"]
    assert out.count() == docs.count()
    ratios = secrets.train(secrets.default_samples(spark, out))
    assert secrets.scan(out, ratios).where("n_assign + n_access + n_hex > 0").count() == 0
    assert out.where("n_chars <> length(text)").count() == 0


def test_mixing(stages):
    docs, out = stages["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_tokens(stages):
    docs, out = stages["byte_bpe"]
    assert out.count() == docs.count() and out.where("not exact or n_tokens <> size(ids)").count() == 0
    assert bpe is not None


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 3), (1, "a b c d e f g", "en", "s", 3), (2, None, None, None, None), (None, "x y", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    scratch, at = Scratch(spark, "edges"), docs.withColumn("component_id", F.lit(1))
    for name, stage in pipeline.STAGES:
        at = scratch.put(name, stage(spark, at, SF))
        if name == "near_duplicates":
            assert at.where("doc_id = 1").count() == 1
    empty = table(spark, SF, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        empty = scratch.put(f"{name}0", stage(spark, empty, SF))
        assert empty.count() == 0
