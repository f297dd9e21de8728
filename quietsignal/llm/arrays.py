"""Array expressions: values bound once, running sums and maxima, searches and cuts, all near-linear in a row's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGS = "CAST(array() AS array<bigint>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep in lambdas ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1; no number if n is 0."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n)


def chunks(values: Column, width: Column) -> Column:
    """``values`` in arrays of ``width`` elements, the last one shorter."""
    part = lambda c: F.transform(F.sequence(c * width, F.least((c + 1) * width, F.size(values)) - 1), lambda i: F.get(values, i))
    return F.transform(upto(F.ceil(F.size(values) / width).cast("int")), part)


def root(values: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (longs of 0 or more), 0 and all values before it under ``op`` (a sum or a maximum).

    Arrays cannot grow in place, so values are taken in chunks of about the root of their number, and what a
    chunk starts with is found from the chunks' totals: n ** 1.5 copies at most.
    """
    zero = F.lit(0).cast("long")

    def grow(xs: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.expr(LONGS).alias("out"))
        return F.aggregate(xs, begin, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def of(parts: Column) -> Column:
        firsts = grow(F.transform(parts, lambda c: F.aggregate(c, zero, lambda a, x: op(a, x))), zero)
        return let(firsts, lambda f: F.flatten(F.transform(parts, lambda c, i: grow(c, F.coalesce(F.get(f, i), zero)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(chunks(v, root(v)), of)).otherwise(F.expr(LONGS)))


def below(ascending: Column, limit: Column, steps: int = 31) -> Column:
    """How many of the ascending longs are below ``limit``, by binary search."""

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        less = F.get(ascending, middle) < limit
        done = a["low"] >= a["high"]
        return F.struct(F.when(done, a["low"]).when(less, middle + 1).otherwise(a["low"]).alias("low"), F.when(done, a["high"]).when(less, a["high"]).otherwise(middle).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, begin, step, lambda a: a["low"])
