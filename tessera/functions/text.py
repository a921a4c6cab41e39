"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINES, MAX_TOKENS, MIN_TOKENS = 80, 1200, 5

# Redaction patterns and replacements, applied in this order.
REDACTIONS = [
    (r"(?i)(password|pwd|pass)\s*[:=]\s*['\"]?[a-zA-Z0-9_\-\$\&\*]+['\"]?", "$1=***"),
    (r"(?i)(bearer\s+|api[-_]?key\s*[:=]\s*)['\"]?[a-zA-Z0-9\-\._~+\/]+=*['\"]?", "$1***"),
    (r"(?i)(secret|private_key)\s*[:=]\s*['\"]?[a-zA-Z0-9_\-\$\&\*]{16,}['\"]?", "$1=***"),
    (r"jdbc:.*password=([^&;\s]+)", "jdbc:***password=***"),
    (r"http://(192\.168\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3})", "http://***"),
]


def has_text(c: Column) -> Column:
    """Not null and not only white space."""
    return c.isNotNull() & c.rlike(r"\S")


def lines(c: Column) -> Column:
    """Lines of a file: LF, CRLF or CR end them; a final terminator adds none; an empty file has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1))


def all_lines(c: Column) -> Column:
    """Every piece between line ends, the empty one after a final end included."""
    return F.split(c, r"\r\n|\n|\r", -1)


def line_count(c: Column) -> Column:
    return F.size(lines(c)).cast("bigint")


def extension(name: Column) -> Column:
    """What follows the last dot; empty if there is none."""
    return F.when(F.instr(name, ".") == 0, F.lit("")).otherwise(F.substring_index(name, ".", -1))


def token_estimate(c: Column) -> Column:
    """Estimate for a chunk: a third of the characters, rounded up, and at least MIN_TOKENS; blank counts as empty."""
    n = F.when(has_text(c), F.length(c)).otherwise(0)
    return F.greatest(F.lit(MIN_TOKENS), F.ceil(n / 3.0)).cast("bigint")


def request_estimate(c: Column) -> Column:
    """Estimate for a request: a third of the characters, rounded down."""
    return F.floor(F.length(c) / 3).cast("bigint")


def trial_estimate(c: Column) -> Column:
    """Estimate for a prompt's trial run: a quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("bigint")


def content_hash(c: Column) -> Column:
    """MD5 of a text; blank texts hash as empty."""
    return F.md5(F.when(has_text(c), c).otherwise(F.lit("")))


def redact(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, F.lit(rule[0]), F.lit(rule[1])), REDACTIONS, c)


def file_name(module: Column) -> Column:
    """A module's name as a file name."""
    return F.regexp_replace(module, r"[\s/()]", "_")


def capitalised(c: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def string_hash(c: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of a string's UTF-16 units, as a signed integer."""
    wrapped = F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda h, ch: F.when(ch == "", h).otherwise(_hashed(h, _code_point(ch))))
    return F.when(wrapped >= 2147483648, wrapped - 4294967296).otherwise(wrapped)


def _hashed(h: Column, point: Column) -> Column:
    """A character beyond the BMP counts as its two surrogates."""
    one = lambda x, unit: (x * 31 + unit) % F.lit(4294967296)
    high, low = F.lit(0xD800) + F.floor((point - 0x10000) / 1024), F.lit(0xDC00) + (point - 0x10000) % 1024
    return F.when(point < 0x10000, one(h, point)).otherwise(one(one(h, high), low)).cast("bigint")


def _code_point(ch: Column) -> Column:
    # ``ascii`` gives the code point of the first character, beyond ASCII too.
    return F.ascii(ch).cast("bigint")


def brace_balance(c: Column) -> Column:
    """Opening less closing braces."""
    return (F.length(F.replace(c, F.lit("}"), F.lit(""))) - F.length(F.replace(c, F.lit("{"), F.lit("")))).cast("bigint")


def masked(c: Column) -> Column:
    """A stored secret as it is shown."""
    return F.when(has_text(c), F.lit("******")).otherwise(c)


def unmasked(new: Column, old: Column) -> Column:
    """The secret to store: the shown mask keeps the old one."""
    return F.coalesce(F.nullif(new, F.lit("******")), old)


def fill_template(c: Column, values: dict[str, Column]) -> Column:
    """Replaces ``${name}`` literally; null values become empty."""
    return reduce(lambda x, kv: F.replace(x, F.lit("${%s}" % kv[0]), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), c)


def short_commit(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 8), F.lit("-"))


def duration_text(ms: Column) -> Column:
    return F.when(ms > 0, F.format_string("%.1fs", ms / 1000)).otherwise(F.lit("-"))
