"""Interval joins and sliding statistics against plain versions."""

import math
import random

import numpy as np
import pytest

from quietsignal.operators import record, series
from quietsignal.operators.record import Settings


def plain_score(v, boxes, steep):
    def one(x, lo, hi):
        z = steep * (x - hi if x > (lo + hi) / 2 else lo - x)
        return 1 - 1 / (1 + math.exp(max(-700, min(700, -z))))

    if any(x is None or x != x for x in v):
        return None
    return max((sum(one(x, *e) for x, e in zip(v, box, strict=True)) / len(v) for box in boxes), default=0.0)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_range_tables_of_any_size(spark, keys):
    """Narrow, wide, nested and broken ranges, by key and without; null keys meet null keys."""
    r = random.Random(3)
    ranges = [(r.choice(["a", "b", None]), lo, lo + r.choice([0.0, 1e-9, 0.5, 30.0, 1e7]), m, m + 5) for lo in (r.uniform(-100, 100) for _ in range(60)) for m in (r.uniform(0, 10),)]
    ranges += [("a", 5.0, 1.0, 0.0, 1.0), ("a", None, 1.0, 0.0, 1.0), ("b", float("nan"), 9.0, 0.0, 1.0)]
    rows = [(r.choice(["a", "b", "c", None]), i, r.uniform(-120, 120), r.uniform(0, 15)) for i in range(150)] + [("a", 500, None, 1.0), ("a", 501, float("nan"), 1.0), ("a", 502, 3.0, None), ("a", 503, 1e15, 2.0)]
    df = spark.createDataFrame(rows, "k string, i long, v double, w double")
    table = spark.createDataFrame(ranges, "k string, v_lo double, v_hi double, w_lo double, w_hi double")
    got = {x["i"]: x["score"] for x in record.in_range(df, table, Settings(keys, ["v", "w"]), 10.0).collect()}
    sound = [b for b in ranges if None not in b[1:] and b[1] <= b[2]]
    for k, i, v, w in rows:
        boxes = [((a, b), (c, d)) for o, a, b, c, d in sound if not keys or o == k]
        want = plain_score((v, w), boxes, 10.0)
        assert got[i] == (want if want is None else pytest.approx(want, abs=1e-9)), i
    assert {x["score"] for x in record.in_range(df.limit(3), table.where("false"), Settings(keys, ["v", "w"]), 10.0).collect()} == {0.0}


@pytest.mark.parametrize("statistic", ["KS", "CVM", "AD"])
def test_change_statistics_with_ties_and_nulls(spark, statistic):
    r = random.Random(5)
    x = [float(r.randrange(4)) if i % 17 else None for i in range(80)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i long, v double")
    got = {y["i"]: y["stat"] for y in series.change_points(df, ["k"], "v", "i", "i", 10, statistic, 0.0).collect()}
    want = {}
    for i in range(5, 76):
        a, b = x[i - 5 : i], x[i : i + 5]
        if None in a + b:
            continue
        z = sorted(a + b)
        below = lambda s, v: sum(y <= v for y in s)
        gaps = [below(a, v) / 5 - below(b, v) / 5 for v in z]
        ad = sum((below(a, v) * 10 - (j + 1) * 5) ** 2 / ((j + 1) * (9 - j)) for j, v in enumerate(z[:9])) / 25
        want[i] = {"KS": max(map(abs, gaps)), "CVM": 0.25 * sum(g * g for g in gaps), "AD": ad}[statistic]
    assert set(got) == set(want) and np.allclose([got[i] for i in want], list(want.values()))


def test_ngram_distances_against_counts(spark):
    from collections import Counter

    r = random.Random(6)
    x = [r.randrange(3) for _ in range(40)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i long, s int")
    ref = series.ngram_frequencies(df, ["k"], "s", "i", "i", 2)
    got = {y["i"]: y["score"] for y in series.ngram_distance(df, ref, ["k"], "s", "i", "i", 2, 8).collect()}
    freq = lambda c: {g: n / max(c.values()) for g, n in c.items()}
    f = freq(Counter(zip(x, x[1:], strict=False)))
    d = {}
    for i in range(7, 40):
        own = freq(Counter(zip(x[i - 7 : i + 1], x[i - 6 : i + 1], strict=False)))
        d[i] = sum((own.get(g, 0) - f.get(g, 0)) ** 2 for g in {*own, *f})
    for i in range(40):
        assert got[i] == pytest.approx(max(d.get(j, 0.0) for j in range(i, min(40, i + 8))))
