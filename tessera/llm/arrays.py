"""Array columns: values worked out once, running sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, step=lambda a, b: a + b) -> Column:
    """For each place, the sum (or another ``step``) of the values up to it, none below zero: within blocks of about the
    root of their number, then over the blocks before."""

    zero = F.lit(0).cast("bigint")

    def scan(v: Column) -> Column:
        start = F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(v, start, lambda st, x: let(step(st["s"], x), lambda y: F.struct(y.alias("s"), F.concat(st["out"], F.array(y)).alias("out"))), lambda st: st["out"])

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: scan(F.slice(v, k * width + 1, width)))

        def shifted(inner: Column) -> Column:
            before = scan(F.transform(inner, lambda b: F.element_at(b, -1)))
            return let(before, lambda w: F.flatten(F.transform(inner, lambda b, k: F.when(k == 0, b).otherwise(let(F.get(w, k - 1), lambda s: F.transform(b, lambda x: step(s, x)))))))

        return let(cut, shifted)

    return F.when(F.size(values) > 0, let(values, blocks)).otherwise(F.array().cast("array<bigint>"))
