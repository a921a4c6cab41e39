"""Parser, chunks, drafts and rules against plain-Python models and fixtures of our own."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit, chunking, lifecycle, parser, prompts, publish, routing
from tessera.sources import files as sources
from tessera.sources import sinks

CONTROLLER = '''package com.acme.shop;

@RestController
@RequestMapping("/api/v1/items")
public class ItemController {
    private final ItemService itemService;
    private String label;

    // a comment { with a brace
    @GetMapping("/all")
    public List<Item> all(@RequestParam String name) {
        return itemService.find(name);
    }

    @PostMapping(value = "/new")
    public void add(Item item) {
        String q = "SELECT i.id, i.name AS n FROM shop.item i JOIN kind k ON k.id = i.kind WHERE i.open = 1 ORDER BY i.id";
        jdbc.update("UPDATE item SET name = 1, x.kind = 2 WHERE id = 3");
        String z = "INSERT INTO audit_log (who, `what`) VALUES (1, 2)";
    }
}
'''


def test_parser_fixture():
    p = parser.parse_source(CONTROLLER)
    assert (p["class_name"], p["package_name"], p["type"], p["request_mapping"]) == ("ItemController", "com.acme.shop", "CONTROLLER", "/api/v1/items")
    assert [(m["name"], m["return_type"], m["http_method"], m["request_mapping"]) for m in p["methods"]] == [("all", "List<Item>", "GET", "/all"), ("add", "void", "POST", "/new")]
    assert p["dependencies"] == ["itemService:ItemService"]
    assert [(c["caller"], c["dependency"], c["target"], c["line"]) for c in p["method_calls"]] == [("all", "ItemService", "find", 12)]
    assert p["tables"] == ["item", "kind", "audit_log"]
    assert [s["operation"] for s in p["sql"]] == ["SELECT", "UPDATE", "INSERT"]
    assert p["sql"][0]["selected"] == ["id", "name"] and p["sql"][0]["joined"] == ["kind"] and p["sql"][0]["conditions"] == ["open"]
    assert p["sql"][1]["updated"] == ["name", "kind"] and p["sql"][1]["conditions"] == ["id"] and p["sql"][2]["inserted"] == ["who", "what"]


def test_types_by_name_and_declaration():
    kinds = [parser.parse_source(s)["type"] for s in ("class UserDTO {}", "class UserVO {}", "enum A {}", "@Configuration\nclass B {}", "public @interface C {}", "class NightJob {}", "interface Plain {}", "")]
    assert kinds == ["DTO", "VO", "ENUM", "CONFIG", "ANNOTATION", "JOB", "UNKNOWN", "UNKNOWN"]


def test_parse_files_keeps_classes_only(spark):
    f = spark.createDataFrame([("a/A.java", CONTROLLER), ("b.txt", "class X {}"), ("c.java", None), ("d.java", "int x;")], "path string, content string")
    assert [r.path for r in parser.parse_files(f).collect()] == ["a/A.java"]


def greedy(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    est = lambda s: max(5, -(-len(s) // 3) if s.strip() else 0)
    parts, cur, first = [], [], 1
    for line in lines:
        if cur and (len(cur) + 1 > 80 or est("\n".join([*cur, line])) > 1200):
            parts.append((first, first + len(cur) - 1, len("\n".join(cur))))
            first, cur = first + len(cur), []
        cur.append(line)
    return [*parts, (first, first + len(cur) - 1, len("\n".join(cur)))]


def test_splitter_against_model(spark):
    r = random.Random(3)
    texts = ["", "\n", "x" * 9000, "a\r\nb\rc", "\n" * 200] + ["\n".join("y" * r.choice([0, 3, 40, 300, 4000]) for _ in range(r.randint(1, 200))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: [(p.first, p.last, p.chars) for p in x.p] for x in df.select("i", chunking.split_parts(F.col("t")).alias("p")).collect()}
    assert got == {i: greedy(t) for i, t in enumerate(texts)}


def method_range(lines, name):
    for i, line in enumerate(lines):
        if name in line and "(" in line:
            if line.strip().endswith(";"):
                return (i + 1, i + 1)
            depth, opened = 0, False
            for j in range(i, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                opened |= "{" in lines[j]
                if opened and depth <= 0:
                    return (i + 1, j + 1)
            return (i + 1, 1 if i == 0 else min(len(lines), i + 4))
    return (1, 1)


def test_method_ranges_against_model(spark):
    r = random.Random(5)
    bits = ["void run() {", "}", "x;", "run(1);", "if (a) {", "{ }", "", "  go run (", "abstract run();"]
    sources_ = [[r.choice(bits) for _ in range(r.randint(1, 12))] for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources_)], "i int, s array<string>")
    got = {x.i: (x.m.start, x.m.end) for x in df.select("i", chunking.method_range(F.col("s"), F.lit("run")).alias("m")).collect()}
    assert got == {i: method_range(s, "run") for i, s in enumerate(sources_)}


def test_chunks_of_small_large_and_missing_files(spark):
    long = "class Long {\n  public void big() {\n" + "".join(f"    int v{i} = {i}; // padding padding padding\n" for i in range(120)) + "  }\n}\n"
    f = spark.createDataFrame([("S.java", CONTROLLER), ("L.java", long), ("gone.java", None), ("n.txt", "")], "path string, content string")
    rows = chunking.chunks(f).collect()
    kinds = lambda p: sorted({r.chunk_type for r in rows if r.path == p})
    assert kinds("S.java") == ["CLASS", "FILE", "METHOD"] and kinds("L.java") == ["CLASS_PART", "FILE_PART", "METHOD_PART"] and kinds("n.txt") == ["FILE"]
    assert [(r.status, r.error_reason) for r in rows if r.path == "gone.java"] == [("FAILED", "Snapshot file does not exist: gone.java")]
    assert [(r.start_line, r.end_line) for r in rows if r.path == "S.java" and r.method_name == "all"] == [(10, 13)]  # the annotation above already holds the name and a parenthesis
    parts = sorted((r.method_name, r.start_line, r.end_line) for r in rows if r.chunk_type == "METHOD_PART")
    assert parts[0][:2] == ("big#part1", 2) and parts[-1][2] == 124  # one past the end, from the last line feed
    assert all(r.token_estimate <= 1200 for r in rows)
    code = chunking.chunk_content(spark.createDataFrame([("S.java", "A", 11, 12), ("x", "B", 1, 1)], "path string, class_name string, start_line int, end_line int"), f)
    assert {r.path: r.code.count("\n") for r in code.collect()} == {"S.java": 2, "x": 0}


def test_redaction(spark):
    s = "my password='abc1' and bearer x.y and jdbc:pg://h?u=1&password=zz and http://10.1.2.3/api"
    assert spark.range(1).select(T.redact(F.lit(s)).alias("r")).first().r == "my password=*** and bearer *** and jdbc:***password=*** and http://***/api"


def test_string_hash(spark):
    def model(s):
        h = 0
        for c in s:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    names = ["", "a", "CoreModule", "DemoModule", "接口访问层 (Controller)", "ß" * 40]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.h for r in df.select(T.string_hash(F.col("n")).alias("h")).collect()] == [model(n) for n in names]


def test_cost_rounds_half_up(spark):
    from decimal import ROUND_HALF_UP, Decimal

    pairs = [(i, o) for i in (0, 1, 24, 25, 49, 75, 333, 12345) for o in (0, 1, 8, 17, 999)]
    df = spark.createDataFrame(pairs, "i bigint, o bigint")
    want = [Decimal(str(round(i * 2e-6 + o * 6e-6, 12))).quantize(Decimal("0.000001"), ROUND_HALF_UP).quantize(Decimal("0.0001"), ROUND_HALF_UP) for i, o in pairs]
    assert [r.c for r in df.select(audit.cost(F.col("i"), F.col("o")).alias("c")).collect()] == want


def test_routes(spark):
    paths = {"src/main/java/com/demo/controller/UserController.java": "DemoModule", "a/modules/system/entity/X.java": "SystemModule", "A.java": None, "x/A.java": "XModule", "x/y/A.java": "XModule", "a/modules/B.java": "AModule", "README.md": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.m for r in df.select("p", routing.package_rule(F.col("p")).alias("m")).collect()} == paths
    routes = {"/api/auth/x": "AuthModule", "api": "ApiModule", "//": None, "": None, "/orders": "OrdersModule"}
    df = spark.createDataFrame([(p,) for p in routes], "p string")
    assert {r.p: r.m for r in df.select("p", routing.route_rule(F.col("p")).alias("m")).collect()} == routes


def test_module_maps():
    assert sources.module_map_yaml("# c\nA: # x\n  - 'p/q'\n  - r\n\nB:\n\t- \"s\"\n") == [(0, 0, "A", "p/q"), (0, 1, "A", "r"), (1, 0, "B", "s")]
    assert sources.module_map_json('{"modules": [{"name": "A", "paths": ["x"]}, {"id": "B", "paths": ["y"]}, {}]}') == [(0, 0, "A", "x"), (1, 0, "B", "y")]
    assert sources.module_map_yaml("") == [] and sources.module_map_json("") == []


def test_state_matrix(spark):
    pairs = [(a, b) for a in lifecycle.STATES for b in lifecycle.STATES]
    df = spark.createDataFrame(pairs, "current string, target string")
    by_join = {(r.current, r.target) for r in lifecycle.checked(df).where("valid").collect()}
    by_column = {(r.current, r.target) for r in df.where(lifecycle.allowed(F.col("current"), F.col("target"))).collect()}
    assert by_join == by_column and len(by_join) == 52
    assert ("DRAFT", "PENDING") in by_join and ("PENDING", "PUSHED") not in by_join


def test_quota_boundary(spark):
    rows = [(1, 1, 99_000, 1_000, 1), (2, 1, 1, 1_001, 2), (3, 1, 5, 0, 3)]
    df = spark.createDataFrame(rows, "id int, task_id int, total_tokens bigint, estimate bigint, created_at int")
    got = {r.id: (r.blocked, r.first_violation) for r in audit.quota_gate(df, ["task_id"], 100_000).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, False)}


def test_statistics_of_nothing(spark):
    u = spark.createDataFrame([], "system_id bigint, task_id bigint, model_name string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost decimal(10,4), created_at timestamp_ntz")
    parts = audit.statistics(u, spark.createDataFrame([], "id bigint, name string"), F.lit("2024-02-03").cast("date"))
    assert parts["totals"].first().total_tokens == 0 and parts["ranking"].count() == 0
    assert [(r.day, r.tokens) for r in parts["trend"].orderBy("day").collect()][0] == ("2024-01-28", 0) and parts["trend"].count() == 7


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_diff_counts(spark, old, new):
    def model(a, b):
        a, b = [x or [""] for x in (a, b)]
        return sum(x not in a for x in b), sum(x not in b for x in a)

    d = spark.range(1).select(lifecycle.diff_counts(F.lit("\n".join(old)), F.lit("\n".join(new))).alias("d")).first().d
    assert (d.added, d.deleted) == model(old, new)


def test_mock_model_and_prompt(spark):
    df = spark.createDataFrame([("x", "m")], "prompt string, mock string")
    assert prompts.complete(df).first().reply.ok
    body = '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":1}}'
    good = prompts.complete(df, lambda p: (200, body)).first().reply
    assert (good.text, good.input_tokens, good.output_tokens, good.ok, good.error) == ("hi", 3, 1, True, None)
    bad = prompts.complete(df, lambda p: (500, "no")).first().reply
    assert (bad.text, bad.ok) == ("m", False) and "500" in bad.error
    code = "public class OrderService {\n private final Repo repo;\n public int count() { return 1; }\n}"
    r = spark.range(1).select(prompts.trial_report(F.lit(code), F.lit("m")).alias("r")).first().r
    assert (r.class_name, r.method_name, r.dependencies) == ("OrderService", "count", ["`repo` (Repo)"])


def test_publication_and_archive(spark, tmp_path):
    f = sources.demo(spark)
    parsed = parser.parse_files(f)
    drafts = spark.createDataFrame([(1, "A (x)", "f1", "# a\n - [ ] open\n"), (2, "B", "f2", None)], "id bigint, module_name string, file_path string, content string")
    refs = spark.createDataFrame([(10, 1, "src/main/java/com/demo/controller/UserController.java"), (11, 2, "missing.java")], "id bigint, draft_id bigint, file_path string")
    docs = publish.publication(drafts, publish.referenced(drafts, refs, parsed))
    by = {r.path: r.content for r in docs.collect()}
    assert "modules/A__x_.md" in by and by["modules/B.md"] == "# B" and "| A (x) | `/` | `GET` | `listUsers` |" in by["api-index.md"]
    assert "open" in by["pending-confirmation.md"] and by["database-index.md"].endswith("| 暂无 | 暂无 | 暂无 |\n")
    sinks.write_documents(docs, str(tmp_path))
    assert (tmp_path / "modules" / "B.md").read_text() == "# B"
    assert sinks.zip_documents(docs)[:2] == b"PK"


def test_tree_scan_and_replace(spark, tmp_path):
    for p, c in {"a/X.java": "class X {}\n", ".hid/y.txt": "1", "target/z.txt": "1", "node/_k.txt": "a\nb", "e.bin": ""}.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(c)
    (tmp_path / "src" / "bad").write_bytes(b"\xff\xfe")
    t = sources.tree(spark, str(tmp_path / "src"))
    from tessera.functions.predicates import scanned

    s = {r.path: (r.file_type, r.line_count) for r in sources.snapshots(scanned(t)).collect()}
    assert s == {"a/X.java": ("java", 1), "node/_k.txt": ("txt", 2), "e.bin": ("bin", 0), "bad": ("", 0)}
    out = str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b")], [(1, "c")]):
        sinks.replace_by_key(spark.createDataFrame(rows, "task_id int, v string"), out)
    assert sorted((r.task_id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "c"), (2, "b")]


def test_stream_matches_batch(spark, tmp_path):
    from tessera.sources.tables import token_usage
    from tessera.streaming.usage import daily_usage

    u = token_usage(spark, "/root/testdata/sf0.001")
    u.write.parquet(str(tmp_path / "in"))
    q = daily_usage(spark.readStream.schema(u.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").agg(F.sum("tokens")).first()[0] == u.agg(F.sum("total_tokens")).first()[0]
