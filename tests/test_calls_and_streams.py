"""Completions over HTTP, call logs, stand-in sources, autosaves over a stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from tessera.operators import prompts
from tessera.sources import files, sinks
from tessera.streaming import usage


def served(replies):
    """A local service that gives ``replies`` in order, and what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = replies[min(len(asked), len(replies)) - 1]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}/v1/", asked


GOOD = '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":1}}'


def test_http_call(spark):
    server, url, asked = served([(503, "busy"), (200, GOOD)])
    df = spark.createDataFrame([("x", "m")], "prompt string, mock string")
    reply = prompts.complete(df, prompts.http_call(url, "k", "model", tries=2, pause=0)).first().reply
    server.shutdown()
    assert (reply.text, reply.input_tokens, reply.ok) == ("hi", 3, True) and len(asked) == 2
    assert asked[1] == ("/v1/chat/completions", "Bearer k", {"model": "model", "stream": False, "messages": [{"role": "user", "content": "x"}]})


def test_failed_calls_give_the_mock_text(spark):
    df = spark.createDataFrame([("x", "m")], "prompt string, mock string")
    server, url, asked = served([(400, "bad")])
    reply = prompts.complete(df, prompts.http_call(url, "k", "model", tries=3, pause=0)).first().reply
    server.shutdown()
    assert (reply.text, reply.ok) == ("m", False) and "400" in reply.error and len(asked) == 1
    for body in ("{}", "no json", '{"choices":[]}'):
        reply = prompts.complete(df, lambda p, b=body: (200, b)).first().reply
        assert (reply.text, reply.ok) == ("m", False) and reply.error
    server.server_close()
    assert not prompts.complete(df, prompts.http_call(url, "k", "model", limit=2)).first().reply.ok


def test_call_logs(spark, tmp_path):
    rows = spark.createDataFrame([(7, 3, "gpt", "hello", 99), (7, 4, "gpt", None, 99)], "task_id int, chunk_id int, model_name string, t string, at_ms long")
    logs = sinks.call_logs(rows.selectExpr("*", "named_struct('text', t) AS reply"))
    sinks.write_documents(logs, str(tmp_path))
    at = tmp_path / "ai_logs" / "task_7"
    assert json.loads((at / "call_3_99_req.json").read_text()) == {"chunkId": 3, "model": "gpt"}
    assert (at / "call_3_99_resp.txt").read_text() == "hello" and (at / "call_4_99_resp.txt").read_text() == ""


def test_stand_in_source(spark, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"f{k}.txt").write_text("x" * k)
    monkeypatch.setattr(files, "BYTES_AT_ONCE", 3)
    df, why = files.tree_or_stand_in(spark, str(tmp_path))
    assert why is None and {r.path: r.content for r in df.collect()} == {f"f{k}.txt": "x" * k for k in range(5)}
    df, why = files.tree_or_stand_in(spark, "git@nowhere:a.git", lambda url: str(tmp_path))
    assert why is None and df.count() == 5

    def away(url):
        raise OSError("no network")

    df, why = files.tree_or_stand_in(spark, "git@nowhere:a.git", away)
    assert (df.count(), why) == (4, "no network")
    assert files.tree_or_stand_in(spark, "/no/such/folder")[0].count() == 4


def test_autosaves_live_for_a_span_of_their_own(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "draft_id int, content string, at timestamp_ntz"

    def state():
        stream = spark.readStream.schema(schema).parquet(source)
        usage.keep_autosaves(stream, out, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
        return {r.draft_id: r.content for r in spark.read.parquet(f"{out}/batch={last}").collect()}

    def write(*rows):
        spark.createDataFrame(rows, "draft_id int, content string, at string").selectExpr("draft_id", "content", "cast(at AS timestamp_ntz) AS at").coalesce(1).write.mode("append").parquet(source)

    write((1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-03 00:00:00"), (2, "c", "2024-01-02 00:00:00"), (None, "d", "2024-01-02 00:00:00"))
    assert state() == {1: "b", 2: "c"}
    write((3, "e", "2024-01-09 12:00:00"), (1, "late", "2024-01-02 00:00:00"))
    assert state() == {1: "b", 3: "e"}
    write((2, "f", "2024-01-10 00:00:00"))
    assert state() == {2: "f", 3: "e"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=1", "batch=2"]
