"""Layouts are told apart by the hash of a record's own paths."""

import json

from tessera.llm import chat


def test_the_registry_is_one_table(spark):
    got = {r.fingerprint: r.layout for r in chat.registry(spark).collect()}
    assert got == chat.by_fingerprint() and all(got[k] == v for k, v in chat.BY_FINGERPRINT.items())


def test_clashing_paths(spark):
    records = [
        ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "a"}], "prompt": "p"}, "messages", [("user", ""), ("assistant", "a")]),
        ({"messages": [], "system": "s"}, "messages", []),
        ({"messages": [{"x": 1}], "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "response": "r", "system": "s"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "response": "r", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "output": "o", "question": "q"}, "instruction_output", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p"}, None, None),
        ({"messages": "no list", "question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(records)], "id int, j string")
    got = {r.conv_id: r for r in chat.json_to_turns(df, "j", "id").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout, i
        assert (got[i].turns and [(t.role, t.text) for t in got[i].turns]) == turns, i
    assert len({r.fingerprint for r in got.values()}) == len(records)


def test_tables_by_their_own_hash(spark):
    a = spark.createDataFrame([("p", "r")], "prompt string, response string")
    b = spark.createDataFrame([("p", "r", "s")], "prompt string, response string, system string")
    c = spark.createDataFrame([(1, 1, "u", "t", "p", "r", "s", "i")], "conv_id int, turn int, role string, text string, prompt string, response string, system string, other string")
    assert [chat.layout_of(x) for x in (a, b, c)] == ["prompt_response", "system_prompt_response", "turn_rows"]


def test_a_very_long_conversation(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '<') AS text")
    back = chat.read_back(chat.format_turns(chat.to_turns(df))).first()
    assert len(back.turns) == n and back.turns[777].text == "t777<"
    assert [back.formatted[m.start : m.end] for m in back.loss_mask[:2]] == ["t1&lt;", "t3&lt;"] and len(back.loss_mask) == n // 2


def test_the_registry_grows_with_the_layouts(spark):
    assert chat.registry(spark).count() == len(chat.LAYOUTS)


def test_parents_and_structured_texts(spark):
    records = [
        ({"data": {"messages": [{"role": "user", "content": "q"}, {"role": "gpt", "content": "a"}]}}, "data_messages", [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "one"}, "two", {"type": "image"}]}]}, "messages", [("user", "one\ntwo\n{\"type\":\"image\"}")]),
        ({"messages": [{"role": "user", "content": {"parts": ["x", "y"]}}, {"role": "user", "content": {"k": 1}}]}, "messages", [("user", "x\ny"), ("user", "{\"k\":1}")]),
        ({"messages": [{"role": "user", "content": []}, {"role": "user", "content": 5}]}, "messages", [("user", ""), ("user", "5")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(records)], "id int, j string")
    got = {r.conv_id: r for r in chat.json_to_turns(df, "j", "id").collect()}
    assert [(got[i].layout, [(t.role, t.text) for t in got[i].turns]) for i in range(len(records))] == [(layout, turns) for _, layout, turns in records]
    nested = spark.createDataFrame([(1, ([("user", "q")],))], "k bigint, data struct<messages: array<struct<role:string,content:string>>>")
    assert chat.layout_of(nested) == "data_messages" and chat.to_turns(nested, "k").first().turns[0].text == "q"
