"""Percentiles by rounds of pivots against sorted lists."""

import math
import random

import pytest

from sparkseek.operators.percentiles import percentiles

WANTED = {"least": 0.0, "low": 0.013, "p50": 0.5, "p95": 0.95, "most": 1.0}


def want(values, p):
    own = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return own[max(1, math.ceil(p * len(own))) - 1] if own else 0


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "wide", "nan", "whole"])
def test_against_sorting(spark, kind):
    rng = random.Random(kind)
    make = {
        "spread": lambda: rng.gauss(0, 50), "ties": lambda: float(rng.randrange(6)), "two": lambda: rng.choice([1.5, -2.5]), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300),
        "nan": lambda: rng.choice([math.nan, rng.random()]), "whole": lambda: (1 << 60) + rng.randrange(3000),
    }[kind]
    groups = {"hot": 1500, "warm": 300, "small": 40, None: 200, "one": 1}
    values = {g: [make() if rng.random() < 0.95 else None for _ in range(n)] for g, n in groups.items()} | {"none": [None, None], "full": [make()]}
    rows = [(g, v) for g, own in values.items() for v in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"g string, v {'bigint' if kind == 'whole' else 'double'}").repartition(4)
    key = lambda own: [float(v) if v is not None else None for v in own]
    got = {r.g: r for r in percentiles(df, ["g"], "v", WANTED, exact=20 if kind == "spread" else 100).collect()}
    assert set(got) == set(values)
    for g, own in values.items():
        for name, p in WANTED.items():
            assert same(got[g][name], want(key(own), p)), (g, name)


def test_empty_and_small(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(df, ["g"], "v", WANTED).collect() == []
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0)], "g string, v double")
    assert tuple(percentiles(df, ["g"], "v", WANTED).first()) == ("a", 1.0, 1.0, 1.0, 2.0, 2.0)


def test_two_keys_and_a_clashing_column(spark):
    df = spark.range(2000).selectExpr("id % 3 a", "cast(id % 2 as string) b", "cast(id as double) v", "1 p", "2 r")
    got = {(x.a, x.b): x.m for x in percentiles(df, ["a", "b"], "v", {"m": 0.5}, exact=50).collect()}
    assert got == {(x.a, x.b): x.m for x in percentiles(df, ["a", "b"], "v", {"m": 0.5}).collect()}
