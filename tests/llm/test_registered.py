"""The registered queries, called by their names: columns, types, folds and SQL."""

import zlib

import duckdb
import pytest

from tessera.llm import registry

SF = "/root/testdata/sf0.001"
FOLD = {"op3_quality": (4, 2), "op5_langid": (4, 2), "op9_toxicity": (5, 0)}
LEAST = {"op3_quality": 0.7, "op9_toxicity": 0.5}
COLUMNS = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_ego_join": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_hilbert_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_contract(spark, name):
    df = registry.QUERIES[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    assert {c.split()[0]: c.split()[1] for c in COLUMNS[name].split(", ")}.items() <= types.items()
    rows = df.collect()
    table = spark.read.parquet(f"{SF}/{'embeddings' if 'vec_id' in types else 'documents'}.parquet")
    if name not in ("op4_hilbert_ann", "op8_chat"):
        assert len(rows) == table.count()
    if name in FOLD:
        modulus, held = FOLD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == int(r.score >= LEAST[name]) for r in rows if name in LEAST)
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        got = con.execute(registry.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(got.fetchall())
