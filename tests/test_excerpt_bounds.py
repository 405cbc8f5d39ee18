"""Bounds of excerpts: only lines within the budget are looked at, once, and the result is that of all lines."""

import random

from pyspark.sql import functions as F

from sparkseek.operators import excerpt
from sparkseek.plans import catalog


def plain(lines, start, end, budget, structured):
    """Over all lines."""
    n = len(lines)
    if structured:
        top = [k for k, x in enumerate(lines, 1) if x and x[0] not in " \t#/"]
        low, high = max([k for k in top if k <= start], default=1), min([k for k in top if k > end], default=n + 1) - 1
    else:
        blank = [k for k, x in enumerate(lines, 1) if not x.strip(" \t\n\x0b\f\r")]
        low, high = min(max([k for k in blank if k < start], default=0) + 1, start), max(min([k for k in blank if k > end], default=n + 1) - 1, end)
    if end - start + 1 >= budget:
        return start, min(end, start + budget - 1)
    s = max(low, min(start, end - budget + 1))
    return s, min(high, max(end, s + budget - 1))


def test_bounds_equal_those_of_all_lines(spark):
    r = random.Random(3)
    cases = []
    for k in range(600):
        lines = [r.choice(["a", "a", "b", " c", "\tc", "#", "", " \t", "\x0b", " "] if k % 2 else ["a", " b", " c", " d", "/x"]) for _ in range(r.randint(1, 40))]
        end = r.randint(1, len(lines))
        cases.append((k, f"/f{k}" + r.choice([".md", ".json"]), "chunk", ("line_range", r.randint(1, end), end, ""), "\n".join(lines)))
    df = spark.createDataFrame(cases, "id int, path string, content string, locator struct<kind string, start int, end int, symbol string>, source string")
    for budget in (1, 3, 12):
        got = {x.id: (x.start_line, x.end_line) for x in excerpt.expand(df, budget).collect()}
        assert got == {k: plain(s.split("\n"), at[1], at[2], budget, p.endswith(".json")) for k, p, _, at, s in cases}


def test_bounds_are_worked_out_once(spark):
    plan = catalog.QUERIES["excerpt_render"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000 and plan.count("RLIKE") < 25
