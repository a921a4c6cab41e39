"""Secret scans: fixed patterns plus character Markov models, as DataFrame expressions only.

Base kinds are patterns (``KINDS``), each matched leftmost and without overlap,
then kept if long enough. The method adds tokens that look random: a first-order
character Markov model of random strings and one of ordinary identifiers are
counted from labelled samples, and a token whose mean log-likelihood ratio a
character is above a threshold, and which touches no base span, is a span of
kind ``markov``. Offsets are code points, ends exclusive.

Ordinary strings are made-up identifiers, class names, dates, numbers, rules of
one character and the words of all documents, whole texts; random strings are
digests in several alphabets. Every kind weighs alike. Probabilities of pairs are
smoothed by the classes of their characters, and the threshold is chosen on made
strings that the models have not counted. Tokens of fewer than 20 characters
(``LEAST``) are never judged: they are too short to tell.

Positions come from splitting the text at the same matches: the lengths of the
pieces and of the matches, added up, are the offsets. So the main path has no
Python and every whole text is one row of work. Sums run in blocks of about the
root of their number, so a text of many spans takes no quadratic time.

Defined results: a null text is an empty text; no spans give empty digests of
the empty string; repeated rows are scanned each; null ids stay; other columns
are not read by ``scan`` and are kept by ``redact``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import let, running
from tessera.llm.common import table

# Kind, pattern, group that must be long enough, its least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # For runs of one class, asking for the length in the pattern keeps the same matches.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
TOKEN, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
ORDER = [k for k, *_ in KINDS] + ["markov"]
#: Printable ASCII from 32; other characters count as the last.
FIRST, CHARS = 32, 96
#: Mean log-likelihood ratio a character above which a token counts as random, where no tokens are held back to choose it on.
THRESHOLD = 0.35
#: Pairs that the smoothing by character class counts as, after each character.
PRIOR = 20.0
#: Share of the random strings held back that the threshold must tell.
RECALL = 0.99
#: Characters of a token.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Random strings of each sort, and made-up identifiers of each sort, in the default samples.
SAMPLE_RANDOM = 3000
#: Pairs of characters that a kind of sample counts for at most, however many it has; kinds of one class count alike.
MASS = 300_000
# Parts of ordinary identifiers.
PARTS = "get set user name list index count value item node file path data type config service handler request response session table column order account update create delete find load save parse format build test default max min time date start end key id is has to from with".split()


# --- models --------------------------------------------------------------------


def _cut(c: Column, least: int = LEAST) -> Column:
    """A made string, over and over until it is long enough for a token."""
    return F.when(F.length(c) >= least, c).otherwise(F.substring(F.repeat(c, least), 1, least + 4))


def default_samples(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, random 0/1, kind, weight, held): digests in several alphabets against identifiers, names, dates, numbers, rules of one
    character, and the words of all documents, as they are, capitalised and in capitals, each word once with its number. ``held``:
    made strings that the threshold is chosen on, a fifth; the models are counted on the others."""
    n = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("sample"), n), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    plain = F.regexp_replace(b64, "[+/]", "")
    ids = spark.range(SAMPLE_RANDOM)
    random = {"base64": b64, "letters": plain, "hex": F.substring(digest, 1, 32), "capitals": F.upper(F.substring(plain, 1, 24)), "small": F.lower(F.substring(plain, 3, 24)), "prefixed": F.concat(F.lit("sk_"), F.substring(plain, 1, 24))}
    parts = F.array(*[F.lit(p) for p in PARTS])
    number = lambda k, below: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(below)).cast("int")
    pick = lambda k: F.element_at(parts, number(k, len(PARTS)) + 1)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat_ws("-", (number("y", 60) + 1980).cast("string"), two(number("m", 12) + 1), two(number("d", 28) + 1))
    time = F.concat_ws("-", two(number("h", 24)), two(number("i", 60)), two(number("s", 60)))
    one = F.substring(F.lit(ALPHABET), number("c", len(ALPHABET)) + 1, 1)
    capital = lambda *ks: F.concat(*[F.initcap(pick(k)) for k in ks])
    ordinary = {
        "snake": F.concat_ws("_", pick(1), pick(2), pick(3), pick(4)), "camel": F.concat(pick(1), capital(2, 3, 4)), "class": capital(1, 2, 3, 4, 5, 6), "constant": F.upper(F.concat_ws("_", pick(5), pick(6), pick(7), pick(8))),
        "kebab": F.concat_ws("-", pick(5), pick(6), pick(7), pick(8)), "path": F.concat_ws("/", pick(9), pick(10), pick(11), pick(12)), "numbered": F.concat(pick(1), F.lit("_"), pick(2), F.lit("_"), pick(3), F.lit("_"), number("n", 10_000).cast("string")),
        "dates": F.concat_ws("-", day, time, two(number("z", 100))), "stamps": F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit("T"), F.replace(time, F.lit("-"), F.lit("")), F.lit("Z-"), pick(1)), "release": F.concat_ws("-", pick(1), F.lit("v"), number("a", 20).cast("string"), number("b", 20).cast("string"), F.lit("rc"), number("e", 9).cast("string")),
        "digits": F.concat(*[F.pmod(F.xxhash64("id", F.lit(f"dig{k}")), F.lit(10_000_000)).cast("string") for k in range(4)]), "counting": F.substring(F.repeat(F.lit("0123456789"), 5), 1 + number("o", 10), 22), "alphabet": F.substring(F.lit(ALPHABET * 2), 1 + number("p", 50), 24),
        "rule": F.repeat(one, 20 + number("l", 20)),
    }
    made = lambda strings, random_: F.explode(F.array(*[F.struct(_cut(c).alias("token"), F.lit(kind).alias("kind")) for kind, c in strings.items()])).alias("s")
    held = (F.pmod("id", F.lit(5)) == 0).alias("held")
    columns = lambda random_: ["s.token", F.lit(random_).alias("random"), "s.kind", F.lit(1.0).alias("weight"), "held"]
    out = ids.select(made(random, 1), held).select(*columns(1)).unionAll(ids.select(made(ordinary, 0), held).select(*columns(0)))
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"[A-Za-z_-]{4,}"), F.lit(0))).alias("token"))
    words = words.groupBy("token").agg(F.count("*").cast("double").alias("weight"))
    forms = F.explode(F.array(F.struct("token", F.lit("words").alias("kind")), F.struct(F.initcap("token").alias("token"), F.lit("capitalised").alias("kind")), F.struct(F.upper("token").alias("token"), F.lit("in capitals").alias("kind")))).alias("s")
    return out.unionAll(words.select(forms, "weight").select("s.token", F.lit(0), "s.kind", "weight", F.lit(False)))


def _code(c: Column) -> Column:
    return F.least(F.greatest(F.ascii(c) - FIRST, F.lit(0)), F.lit(CHARS - 1))


def _class(code: int) -> int:
    """Small letters, capitals and digits are a class each, any other character is one of its own."""
    c = chr(code + FIRST)
    return 0 if c.islower() and c.isascii() else 1 if c.isupper() and c.isascii() else 2 if c.isdigit() else 3 + code


def _smoothed(n: list[list[float]]) -> list[list[float]]:
    """P(b | a) from counts: what a pair lacks is filled by how often the classes of a and b follow each other, shared evenly among
    the characters of b's class."""
    of = [_class(c) for c in range(CHARS)]
    members: dict[int, int] = {}
    for c in of:
        members[c] = members.get(c, 0) + 1
    follow: dict[tuple, float] = {}
    total: dict[int, float] = {}
    for a in range(CHARS):
        for b in range(CHARS):
            follow[of[a], of[b]] = follow.get((of[a], of[b]), 0.0) + n[a][b]
            total[of[a]] = total.get(of[a], 0.0) + n[a][b]
    floor = 1.0 / CHARS  # a class that was never seen is followed by anything
    by_class = {(x, y): (follow[x, y] + floor * members[y]) / (total[x] + 1.0) / members[y] for x, y in follow}
    return [[(n[a][b] + PRIOR * by_class[of[a], of[b]]) / (sum(n[a]) + PRIOR) for b in range(CHARS)] for a in range(CHARS)]


def train(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all pairs of characters, row by row of a; after them the threshold, if
    ``samples`` holds tokens back to choose it on, else THRESHOLD.

    ``samples``: token, random, and if there are several sources of a class their ``kind``, a ``weight`` where a token stands for
    several, and ``held``. A kind's counts are scaled down to MASS pairs, so no source drowns another however much it grows.
    At most 96 x 96 counts of a kind and class reach the driver, and the counts of held tokens by ratio."""
    kind = F.col("kind") if "kind" in samples.columns else F.lit("")
    weight = F.col("weight") if "weight" in samples.columns else F.lit(1.0)
    known = samples.where("token is not null and random is not null")
    learnt = known.where("not held") if "held" in samples.columns else known
    chars = learnt.select("random", kind.alias("kind"), weight.alias("weight"), F.split("token", "").alias("c"))
    pairs = chars.select("random", "kind", "weight", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    counted = pairs.groupBy("random", "kind", (_code(F.col("p.a")) * CHARS + _code(F.col("p.b"))).alias("cell")).agg(F.sum("weight").alias("n")).collect()
    mass: dict[tuple, float] = {}
    for r in counted:
        mass[r["random"], r["kind"]] = mass.get((r["random"], r["kind"]), 0.0) + r["n"]
    n = [[[0.0] * CHARS for _ in range(CHARS)] for _ in range(2)]
    for r in sorted(counted, key=lambda r: (r["random"], r["kind"], r["cell"])):
        n[1 if r["random"] else 0][r["cell"] // CHARS][r["cell"] % CHARS] += r["n"] * min(1.0, MASS / mass[r["random"], r["kind"]])
    ordinary, random = (_smoothed(x) for x in n)
    ratios = [math.log(random[a][b]) - math.log(ordinary[a][b]) for a in range(CHARS) for b in range(CHARS)]
    if "held" not in samples.columns:
        return [*ratios, THRESHOLD]
    steps = known.where("held").groupBy("random", F.floor(mean_ratio(F.col("token"), ratios) * 50).alias("step")).count().collect()  # by ratios of 0.02
    return [*ratios, _threshold([(r["step"], bool(r["random"]), r["count"]) for r in steps])]


def _threshold(steps: list[tuple[int, bool, int]]) -> float:
    """The highest ratio that still tells RECALL of the random strings held back: ordinary strings outnumber secrets by far, so
    what margin there is goes to them."""
    random = sorted((s, c) for s, r, c in steps if r)
    missed, allowed = 0, (1 - RECALL) * sum(c for _, c in random)
    for step, c in random:
        missed += c
        if missed > allowed:
            return step / 50
    return THRESHOLD


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio a pair of neighbouring characters."""
    model = F.from_json(F.lit(json.dumps([round(x, 5) for x in ratios[: CHARS * CHARS]])), "array<double>")  # folded to a literal once
    codes = F.transform(F.split(token, ""), lambda c: _code(c))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("a"))
    total = F.aggregate(codes, start, lambda st, b: F.struct((st["s"] + F.when(st["a"] >= 0, F.get(model, st["a"] * CHARS + b)).otherwise(0.0)).alias("s"), b.alias("a")), lambda st: st["s"])
    return total / F.greatest(F.length(token) - 1, F.lit(1))


# --- spans ---------------------------------------------------------------------


def _placed(pieces: Column, matches: Column, keep, kind: int) -> Column:
    """Spans from the pieces between matches: array<struct<start, kind, end>>."""
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    spans = let(
        running(lengths),
        lambda ends: F.zip_with(matches, ends, lambda m, end: F.struct((end - F.length(m)).cast("long").alias("start"), F.lit(kind).alias("kind"), end.alias("end"))),
    )
    return F.filter(spans, lambda x, i: keep(i))


_EMPTY = "array<struct<start:bigint,kind:int,end:bigint>>"


def _without(spans: Column, base: Column) -> Column:
    """The spans, disjoint among themselves, that touch none of ``base``. In order of their starts a span touches an
    earlier one of ``base`` if the greatest end so far is past its start, and a later one if the next starts before its end."""
    own = len(KINDS)
    merged = F.array_sort(F.concat(base, spans))

    def untouched(m: Column) -> Column:
        reach = running(F.transform(m, lambda x: F.when(x["kind"] < own, x["end"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        free = lambda r: lambda x, i: (x["kind"] == own) & (F.get(r, i) <= x["start"]) & F.coalesce((F.get(m, i + 1)["start"] >= x["end"]) | (F.get(m, i + 1)["kind"] == own), F.lit(True))
        return let(reach, lambda r: F.filter(m, free(r)))

    return let(merged, untouched)


def with_spans(df: DataFrame, ratios: list[float] | None, text_col: str = "text") -> DataFrame:
    """Adds ``_base`` and ``_all``: sorted spans array<struct<start, kind, end>>, kind by its place in ORDER."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        m, s = f"_m_{kind}", f"_s_{kind}"
        df = df.withColumn(m, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
        if group:
            g = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
            df = df.withColumn(f"_g_{kind}", F.when(F.size(m) > 0, g))
            keep = lambda i, c=f"_g_{kind}", n=least: F.length(F.get(F.col(c), i)) >= n
        else:
            keep = lambda i, c=m, n=least: F.length(F.get(F.col(c), i)) >= n
        df = df.withColumn(f"_p_{kind}", F.when(F.size(m) > 0, F.split("_text", pattern, -1)))
        df = df.withColumn(s, F.when(F.size(m) > 0, _placed(F.col(f"_p_{kind}"), F.col(m), keep, k)).otherwise(F.array().cast(_EMPTY)))
        names.append(s)
    df = df.withColumn("_base", F.array_sort(F.concat(*names)))
    names = [c for c in df.columns if c[:3] in ("_m_", "_g_", "_p_", "_s_")]
    if ratios is None:
        return df.withColumn("_all", F.col("_base")).drop(*names)
    df = df.withColumn("_m_token", F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("_r_token", F.transform("_m_token", lambda t: mean_ratio(t, ratios)))
    least = ratios[CHARS * CHARS] if len(ratios) > CHARS * CHARS else THRESHOLD
    hot = F.exists("_r_token", lambda r: r > least)
    df = df.withColumn("_p_token", F.when(hot, F.split("_text", TOKEN, -1)))
    found = _placed(F.col("_p_token"), F.col("_m_token"), lambda i: F.get(F.col("_r_token"), i) > least, len(KINDS))
    df = df.withColumn("_s_token", F.when(hot, found).otherwise(F.array().cast(_EMPTY)))
    new = _without(F.col("_s_token"), F.col("_base"))
    df = df.withColumn("_all", F.when(F.size("_s_token") > 0, F.array_sort(F.concat("_base", new))).otherwise(F.col("_base")))
    return df.drop(*names, "_m_token", "_r_token", "_p_token", "_s_token")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(df: DataFrame, ratios: list[float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of each whole text."""
    out = with_spans(df.select(id_col, F.col(text_col).alias("_in")), ratios, "_in")
    n = lambda k: F.size(F.filter("_all", lambda x: x["kind"] == k)).cast("bigint")
    return out.select(id_col, *[n(k).alias(f"n_{kind}") for k, kind in enumerate(ORDER[:3])], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"), n(3).alias("n_markov"))


def redact(df: DataFrame, ratios: list[float] | None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its text replaced by ``mark`` (overlapping spans by one); null texts stay null."""
    columns = df.columns
    hidden = with_spans(df.select(F.struct(*columns).alias("_row"), F.col(text_col).alias("_in")), ratios, "_in")

    def joined(spans: Column) -> Column:
        """What is between the spans, and a mark for each that starts after all before it have ended."""
        reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)

        def pieces(r: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1))
                return F.when(x["start"] >= before, F.concat(F.substr("_text", (before + 1).cast("int"), (x["start"] - before).cast("int")), F.lit(mark))).otherwise("")

            return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr("_text", (F.element_at(r, -1) + 1).cast("int")))

        return let(reach, pieces)

    clean = let(F.col("_all"), joined)
    text = F.when(F.col("_in").isNull(), None).when(F.size("_all") > 0, clean).otherwise(F.col("_in"))
    return hidden.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(default_samples(spark, docs)))
