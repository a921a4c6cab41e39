import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import chat, mixing


def test_turn_rows_round_trip(spark):
    rows = [(1, 1, "user", "hi <s>[INST] &lt; </s>\n"), (1, 2, "assistant", None), (1, None, "system", "be\nkind"), (2, 0, None, ""), (2, 0, None, ""), (None, 3, "assistant", "é😀"), (3, 0, "a\nb", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit("clash"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.to_turns(df))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("system", "be\nkind"), ("user", "hi <s>[INST] &lt; </s>\n"), ("assistant", "")]
    assert [(t.role, t.text) for t in back[2].turns] == [("", ""), ("", "")] and back[3].turns[0].role == "a\nb"
    m = back[None].loss_mask
    assert [back[None].formatted[x.start : x.end] for x in m] == ["é😀"]
    assert back[1].formatted.count("<s>") == 3 and back[1].formatted.count("</s>") == 3
    assert chat.to_turns(df.limit(0)).count() == 0


def test_records_of_any_layout(spark):
    j = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":3}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"instruction":"q","output":"a"}', '{"prompt":"q","completion":"a","extra":{"b":1}}', '{"prompt":"q","response":"a"}', '{"question":"q","answer":"a"}',
    ]
    got = chat.json_to_turns(spark.createDataFrame([*enumerate([*j, '{"z":1}', "no", None])], "id bigint, j string"), "j", "id").collect()
    for r in got[: len(j)]:
        assert [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    assert [r.turns for r in got[len(j) :]] == [None] * 3
    table = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "k bigint, messages array<struct<role:string,content:string>>")
    assert chat.layout_of(table) == "messages" and chat.to_turns(table, "k").first().turns[1].text == "a"
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)


def test_op8_against_model(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect() + [None]
    by = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows[:-1]:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in chat.op8_chat(spark, sf).collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        lost = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())


def test_pivot_keeps_the_total_and_the_expectation():
    sizes = np.sort(np.random.default_rng(0).integers(1, 400, 300))[::-1].astype(float)
    p = np.full(300, 0.37)
    kept = np.zeros(300)
    for seed in range(300):
        out = mixing.pivot(np.arange(300), sizes, p, seed)
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6
        kept += out
    assert abs(kept.mean() / 300 - 0.37) < 0.02 and np.abs(kept / 300 - 0.37).max() < 0.15


def fill(sizes, weights, share, most):
    left, target = dict(sizes), {}
    total = sum(sizes.values()) * share
    while left:
        level = (total - sum(target.values())) / sum(weights[s] for s in left)
        over = [s for s in left if most * sizes[s] <= level * weights[s] + 1e-12]
        if not over:
            return target | {s: level * weights[s] for s in left}
        for s in over:
            target[s] = most * sizes[s]
            del left[s]
    return target


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 20)
    r = np.random.default_rng(3)
    rows = []
    for i in range(700):
        s = ["b", "a", None, "é", "hot", "hot", "hot"][i % 7]
        rows.append((i, " ".join(["w"] * int(r.integers(0, 40))) if i % 50 else None, s))
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, source string").withColumn("target", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) + 3
    sizes, taken, target, largest = {}, {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source], largest[x.source] = x.target, max(largest.get(x.source, 0), x.size)
        assert x.taken <= 2 * x.size and x.taken == x.copies * x.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in sizes) and all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda x: (x.doc_id, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_small_sources_are_closed_beside_a_hot_one(spark, monkeypatch):
    """A source of one bucket is closed over all its documents, not over the one row that a larger source's levels leave."""
    monkeypatch.setattr(mixing, "FAN", 20)
    r = np.random.default_rng(8)
    rows = [(i, "w " * int(r.integers(1, 60)), "hot") for i in range(500)]
    for k in range(25):
        rows += [(1000 * (k + 1) + i, "w " * int(r.lognormal(4, 1)), f"s{k:02d}") for i in range(int(r.integers(4, 12)))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), most=3.0).toPandas()
    assert len(got) == len(rows)
    for name, g in got[got.source != "hot"].groupby("source"):
        ratio = g.target / g.source_size
        want = mixing._root(g.assign(base=np.floor(ratio).astype(int), p=np.where(g["size"] > 0, ratio - np.floor(ratio), 0.0)))
        assert dict(zip(want.doc_id, want.base + want.p.astype(int))) == dict(zip(g.doc_id, g.copies)), name
