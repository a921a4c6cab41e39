"""The Markov models: ordinary strings that no sample holds, secrets of several alphabets, ratios and spans written out plainly."""

import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import secrets

ORDINARY = [
    "-" * 20, "A" * 24, "=" * 30, "x" * 20, "_" * 27, "0" * 22, "0123456789012345678901", "1234567890123456789012", "2024-01-02-03-04-05-06-07", "2023_12_31_23_59_59_999", "20240102T030405Z-backup",
    "AbstractSingletonProxyFactoryBean", "HttpServletRequestWrapper2", "Donaudampfschifffahrtsgesellschaft", "Rechtsschutzversicherungsgesellschaften", "Kraftfahrzeughaftpflichtversicherung", "internationalization-settings",
    "MAX_RETRY_COUNT_DEFAULT", "GET_USER_BY_ID_AND_NAME", "com/example/service/UserRepository", "node_modules/lodash/index", "user_authentication_service", "1-2-3-4-5-6-7-8-9-10-11", "release-v2-10-3-rc1-final", "ff00ff-00ff00-0000ff",
    "antidisestablishmentarianism", "constitutionnellement-parlant", "desoxyribonucleico-proteico", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aaaaaaaabbbbbbbbcccccccc",
]


def made_secrets():
    r, out = random.Random(7), []
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    for i in range(40):
        b = hashlib.sha512(b"q%d" % i).digest()
        out += [base64.b64encode(b[:24]).decode(), base64.urlsafe_b64encode(b[:18]).decode(), b[:16].hex(), draw(letters, 32), "ghp_" + draw(letters, 36), draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26)]
    return out


@pytest.fixture(scope="module")
def ratios(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return secrets.train(secrets.default_samples(spark, docs))


def plain(token, ratios):
    code = [min(max(ord(c) - 32, 0), 95) for c in token]
    return sum(round(ratios[a * 96 + b], 5) for a, b in zip(code, code[1:])) / max(1, len(token) - 1)


def test_precision_and_recall(spark, ratios):
    rows = [(t, False) for t in ORDINARY] + [(t, True) for t in made_secrets()]
    df = spark.createDataFrame(rows, "t string, secret boolean").withColumn("r", secrets.mean_ratio(F.col("t"), ratios)).collect()
    told = [(r.secret, r.r > ratios[-1]) for r in df]
    hits, alarms = sum(s and f for s, f in told), sum(f and not s for s, f in told)
    assert hits / (hits + alarms) >= 0.95 and hits >= 0.95 * len(made_secrets()) and alarms <= len(ORDINARY) // 20
    assert all(math.isclose(r.r, plain(r.t, ratios), abs_tol=1e-9) for r in df)


def test_spans(spark, ratios):
    """Tokens above the threshold that touch no base span, wherever they stand."""
    keys = [k for k in made_secrets() if plain(k, ratios) > ratios[-1]][:6]
    texts = [
        f"see {keys[0]}, then {ORDINARY[11]} é {keys[1]}", f"token={keys[2]} and {keys[3]}", keys[4], f"{'ab' * 15} {keys[5]} {'-' * 25}", None, "", "short aB3dE6 only", f"{keys[0]} " * 300, "x " * 50_000 + keys[1],
        f"{keys[0]}!password: hunter22!{keys[1]}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(df, ratios).collect()}
    for i, text in enumerate(texts):
        base = [x for x in (got[i].split(",") if got[i] else []) if not x.startswith("markov")]
        taken = [tuple(map(int, x.split(":")[1:])) for x in base]
        want = [f"markov:{m.start()}:{m.end()}" for m in re.finditer(secrets.TOKEN, text or "") if plain(m[0], ratios) > ratios[-1] and all(m.end() <= a or m.start() >= b for a, b in taken)]
        assert [x for x in (got[i].split(",") if got[i] else []) if x.startswith("markov")] == want
    assert got[0].count("markov") == 2 and "markov" in got[1] and got[7].count("markov") == 300


def test_threshold_tells_99_of_100():
    assert secrets._threshold([(-10, False, 5), (3, True, 1), (20, True, 99), (50, True, 900)]) == 20 / 50
    assert secrets._threshold([(3, False, 5), (3, True, 5)]) == 3 / 50
    assert secrets._threshold([]) == secrets.THRESHOLD


def test_smoothing_keeps_distributions():
    n = [[float((a * b) % 7) if a < 40 else 0.0 for b in range(secrets.CHARS)] for a in range(secrets.CHARS)]
    for row in secrets._smoothed(n):
        assert math.isclose(sum(row), 1.0, abs_tol=1e-6) and min(row) > 0
