"""Chat formatting by schema fingerprints, as DataFrame expressions only.

A record's nested field paths, as far as the declared layouts know them, are
sorted, joined and hashed: its fingerprint. Registered is the hash of each
layout's own paths. Of a record's paths those that a layout names are hashed,
and where that is the layout's registered hash it selects the declarative
mapping (``LAYOUTS``) that turns prompt, instruction or message records into
canonical turns array<struct<role, text>>; of several such layouts the first by
``RANK`` counts. So the registry has one hash a layout. A table's own columns
are fingerprinted once from its schema; JSON records are fingerprinted row by
row. A list's fields are one unit: it is there if any of its items has one of
them, or if it has no items. A text that is a list, or a record with a list of
``parts``, is the texts of its items (strings, or records with a ``text``)
joined by line feeds; any other record is its JSON text.

Template: each turn is ``<s>role\\ntext</s>\\n``. In roles and texts ``&``, ``<``
and ``[`` are written as ``&amp;``, ``&lt;`` and ``&lsqb;`` (and a line feed in
a role as ``&nl;``), so no text can hold a control string, and ``read_back``
restores every text exactly. The loss mask covers the assistants' texts.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role and text, so turns of one number come by role; null ids form
one conversation, which is one row like any other; repeated rows are
turns of their own; records of no known layout have null turns, an empty list
has none; items that are not records have empty texts; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrays import let, running
from tessera.llm.common import table

OPEN, CLOSE = "<s>", "</s>\n"
# Escapes, applied in this order and undone in reverse.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&nl;")]
TURNS = "array<struct<role:string,text:string>>"

# Declarative mappings. "list": (path of the array, role field, text field).
# "fields": (role, paths whose non-blank texts are joined by a line feed) in turn order.
# "rows": a table with a row a turn: (conversation, turn, role, text).
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"rows": ("conv_id", "turn", "role", "text")},
    "messages": {"list": ("messages", "role", "content")},
    "conversations": {"list": ("conversations", "from", "value")},
    "chosen": {"list": ("chosen", "role", "content")},
    "data_messages": {"list": ("data.messages", "role", "content")},
    "prompt_completion": {"fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "system_prompt_response": {"fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction_output": {"fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input_output": {"fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question_answer": {"fields": [("user", ["question"]), ("assistant", ["answer"])]},
}
# Other names of roles, in layouts other than rows of canonical turns.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def layout_paths(layout: dict) -> list[str]:
    if "rows" in layout:
        return sorted(layout["rows"])
    if "list" in layout:
        path, role, text = layout["list"]
        return sorted([f"{path}[].{role}", f"{path}[].{text}"])
    return sorted(p for _, paths in layout["fields"] for p in paths)


#: Which layout counts where a record holds several: rows of turns, then lists, then those of most fields.
RANK = sorted(LAYOUTS, key=lambda k: ("rows" not in LAYOUTS[k], "list" not in LAYOUTS[k], -len(layout_paths(LAYOUTS[k])), list(LAYOUTS).index(k)))


def units(layout: dict) -> list[str]:
    """The layout's paths; those of a list are one."""
    return [",".join(layout_paths(layout))] if "list" in layout else layout_paths(layout)


#: All units, sorted: a fingerprint is the hash of those that are there, joined by commas.
KNOWN = sorted({u for layout in LAYOUTS.values() for u in units(layout)})


def _hash(found: list[str]) -> int:
    """What xxhash64 gives for the joined units, seed 42, as a signed number."""
    import xxhash

    h = xxhash.xxh64_intdigest(",".join(sorted(found)).encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


#: The registry: each layout by the hash of its own paths.
BY_FINGERPRINT = {_hash(units(v)): k for k, v in LAYOUTS.items()}


def by_fingerprint() -> dict[int, str]:
    return BY_FINGERPRINT


def registry(spark: SparkSession) -> DataFrame:
    """(fingerprint, layout): the registry as a table, hashed by Spark."""
    rows = [F.struct(F.xxhash64(F.lit(",".join(units(v)))).alias("fingerprint"), F.lit(k).alias("layout")) for k, v in LAYOUTS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def layout_of(df: DataFrame) -> str:
    """Name of the layout that the hash of the table's own paths selects; other columns do not count."""
    have = set(schema_paths(df.schema))
    for name in RANK:
        if BY_FINGERPRINT.get(_hash([u for u in units(LAYOUTS[name]) if set(u.split(",")) <= have])) == name:
            return name
    raise ValueError(f"no layout for the paths {sorted(have)}")


def _turn(role: Column, text: Column, canonical: bool = False) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    role = F.coalesce(role, F.lit(""))
    role = role if canonical else F.coalesce(F.try_element_at(names, role), role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _from_fields(fields: list, get) -> Column:
    turns = []
    for role, paths in fields:
        text = F.concat_ws("\n", *[F.when(F.coalesce(F.trim(get(p)), F.lit("")) != "", get(p)) for p in paths])
        present = reduce(lambda a, b: a | b, [get(p).isNotNull() for p in paths])
        turns.append(F.when(present, F.array(_turn(F.lit(role), text))).otherwise(F.array().cast(TURNS)))
    return F.concat(*turns)


def _stacked(df: DataFrame, keys: list[Column], turn: Column, role: Column, text: Column) -> DataFrame:
    rows = df.select(*keys, turn.alias("_t"), _turn(role, text, canonical=True).alias("_m"))
    names = [c for c in rows.columns if c not in ("_t", "_m")]
    got = rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_t", "_m"))).alias("_l"))
    return got.select(*names, F.transform("_l", lambda x: x["_m"]).alias("turns"))


def to_turns(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """(conv_id, turns) from a table of any layout; ``id_col`` names the record id where there is one a row."""
    layout = LAYOUTS[layout_of(df)]
    if "rows" in layout:
        conv, turn, role, text = layout["rows"]
        return _stacked(df, [F.col(conv).alias("conv_id")], F.col(turn), F.col(role).cast("string"), F.col(text).cast("string"))
    ident = F.col(id_col) if id_col else F.monotonically_increasing_id()
    if "list" in layout:
        path, role, text = layout["list"]
        return df.select(ident.alias("conv_id"), F.transform(path, lambda x: _turn(x[role].cast("string"), x[text].cast("string"))).alias("turns"))
    return df.select(ident.alias("conv_id"), _from_fields(layout["fields"], lambda p: F.col(p).cast("string")).alias("turns"))


def _of_item(role: str, text: str):
    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.text", "string"), F.try_variant_get(i, "$", "string"))), "\n")

    def said(x: Column) -> Column:
        lists = [F.try_variant_get(x, f"$.{text}{more}", "array<variant>") for more in ("", ".parts")]
        return F.coalesce(*[joined(c) for c in lists], F.try_variant_get(x, f"$.{text}", "string"))

    return lambda x: _turn(F.try_variant_get(x, f"$.{role}", "string"), said(x))


def json_to_turns(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of JSON records, each fingerprinted by its own paths."""
    v = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(json_col).alias("_v"))

    def there(unit: str) -> Column:
        if "[]" not in unit:
            return F.try_variant_get("_v", f"$.{unit}", "string").isNotNull()
        path = unit.split("[]")[0]
        items = F.try_variant_get("_v", f"$.{path}", "array<variant>")
        fields = [p.split("[].")[1] for p in unit.split(",")]
        some = F.exists(items, lambda x: reduce(lambda a, b: a | b, [F.try_variant_get(x, f"$.{f}", "string").isNotNull() for f in fields]))
        return items.isNotNull() & ((F.size(items) == 0) | some)

    found = F.filter(F.array(*[F.when(there(u), F.lit(u)) for u in KNOWN]), lambda x: x.isNotNull())
    v = v.withColumn("_found", found).withColumn("fingerprint", F.xxhash64(F.array_join("_found", ",")))
    layout = F.lit(None).cast("string")
    for name in reversed(RANK):
        own = F.array_intersect("_found", F.array(*[F.lit(u) for u in units(LAYOUTS[name])]))
        layout = F.when(F.xxhash64(F.array_join(own, ",")) == F.lit(_hash(units(LAYOUTS[name]))), F.lit(name)).otherwise(layout)
    v = v.withColumn("layout", layout)
    turns = F.lit(None).cast(TURNS)
    for name, layout in LAYOUTS.items():
        if "list" in layout:
            path, role, text = layout["list"]
            items = F.try_variant_get("_v", f"$.{path}", "array<variant>")
            got = F.transform(items, _of_item(role, text))
        elif "fields" in layout:
            got = _from_fields(layout["fields"], lambda p: F.try_variant_get("_v", f"$.{p}", "string"))
        else:
            continue
        turns = F.when(F.col("layout") == name, got).otherwise(turns)
    return v.select("conv_id", "fingerprint", "layout", turns.alias("turns"))


# --- template ------------------------------------------------------------------


def _escape(c: Column, table_: list) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), table_, c)


def _unescape(c: Column, table_: list) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(table_), c)


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<start, end>>): code points of the formatted string, end exclusive."""
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), _escape(t["role"], ROLE_ESCAPES), F.lit("\n")))
    bodies = F.transform("turns", lambda t: _escape(t["text"], ESCAPES))
    out = df.select("conv_id", "turns", heads.alias("_h"), bodies.alias("_b"))
    formatted = F.array_join(F.zip_with("_h", "_b", lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    sizes = F.zip_with("_h", "_b", lambda h, b: (F.length(h) + F.length(b) + len(CLOSE)).cast("bigint"))

    def masked(ends: Column) -> Column:
        own = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct((F.get(ends, i) - len(CLOSE) - F.length(F.get("_b", i))).cast("bigint").alias("start"), (F.get(ends, i) - len(CLOSE)).cast("bigint").alias("end"))))
        return F.filter(own, lambda x: x.isNotNull())

    mask = F.when(F.size("turns") > 0, let(running(sizes), masked)).otherwise(none)
    return out.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, turns): the turns as the formatted string has them."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    body = F.transform(pieces, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(F.substr(x, (F.length(role) + 2).cast("int")), ESCAPES).alias("text"))

    return df.select("conv_id", "formatted", "loss_mask", F.transform(body, turn).alias("turns"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ok.alias("text"))
    back = read_back(format_turns(to_turns(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # What the mask covers, in order: the slices of the formatted string, unescaped.
    lost = F.array_join(F.transform("loss_mask", lambda m: _unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")), ESCAPES)), "")
    back = back.withColumn("_lost", lost)
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_lost").cast("bigint").alias("loss_chars"), F.sha2("_lost", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The same rows in SQL: digests need only the turns, as the template gives every text back.
OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;')) + 9 AS chars FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
