"""Excerpts: grow a chunk's lines to a natural unit within a budget, and render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions.scalars import extension
from sparkseek.operators.chunking import go_declarations

MAX_LINES, WIDTH, GUTTER, TAB = 12, 80, 4, 4
CODE_EXT = (".py", ".js", ".ts", ".rs", ".sh", ".c", ".java", ".cpp", ".h", ".hpp")
STRUCTURED_EXT = (".json", ".yaml", ".yml", ".toml")
DECL = r"^(func|def|class|function|fn|type|impl|pub fn)\b"


def _where(lines: Column, test) -> Column:
    """Numbers of the lines that pass a test."""
    numbered = F.transform(lines, lambda x, k: F.struct((k + 1).alias("n"), test(x).alias("ok")))
    return F.transform(F.filter(numbered, lambda x: x["ok"]), lambda x: x["n"])


def _near(lines: Column, start: Column, end: Column, budget: Column, test) -> Column:
    """As `_where`, of the lines that `_grow` can reach from start..end and one more: others don't change what it gives."""
    first = F.greatest(F.lit(1), start - budget)
    numbered = F.transform(F.slice(lines, first, F.greatest(F.lit(0), end + budget - first + 1)), lambda x, k: F.struct((first + k).alias("n"), test(x).alias("ok")))
    return F.transform(F.filter(numbered, lambda x: x["ok"]), lambda x: x["n"])


def _last_at_most(numbers: Column, n: Column) -> Column:
    return F.array_max(F.filter(numbers, lambda x: x <= n))


def _first_above(numbers: Column, n: Column) -> Column:
    return F.array_min(F.filter(numbers, lambda x: x > n))


def _grow(low: Column, high: Column, start: Column, end: Column, budget: Column) -> Column:
    """From start..end up to low first, then down to high, within the budget."""
    s = F.greatest(low, F.least(start, end - budget + 1))
    e = F.least(high, F.greatest(end, s + budget - 1))
    cut = F.struct(start.alias("s"), F.least(end, start + budget - 1).alias("e"))
    return F.when(end - start + 1 >= budget, cut).otherwise(F.struct(s.alias("s"), e.alias("e")))


def prose_bounds(lines: Column, start: Column, end: Column, budget: Column) -> Column:
    blank = _near(lines, start, end, budget, lambda x: ~x.rlike(r"\S"))
    low = F.least(F.coalesce(_last_at_most(blank, start - 1), F.lit(0)) + 1, start)
    high = F.greatest(F.coalesce(_first_above(blank, end), F.size(lines) + 1) - 1, end)
    return _grow(low, high, start, end, budget)


def structured_bounds(lines: Column, start: Column, end: Column, budget: Column) -> Column:
    top = _near(lines, start, end, budget, lambda x: (x != "") & ~x.rlike(r"^[ \t#/]"))
    low = F.coalesce(_last_at_most(top, start), F.lit(1))
    high = F.coalesce(_first_above(top, end), F.size(lines) + 1) - 1
    return _grow(low, high, start, end, budget)


def fit_budget(low: Column, high: Column, start: Column, end: Column, budget: Column) -> Column:
    """The unit if it fits; else as much as does, upwards first."""
    return F.when(high - low + 1 <= budget, F.struct(low.alias("s"), high.alias("e"))).otherwise(_grow(low, high, start, end, budget))


def code_bounds(lines: Column, start: Column, end: Column, budget: Column) -> Column:
    decl = _where(lines, lambda x: x.rlike(DECL))
    close = _where(lines, lambda x: x.startswith("}"))
    low = F.coalesce(_last_at_most(decl, start), start)
    high = F.coalesce(_first_above(close, end), F.size(lines))
    cut = F.struct(start.alias("s"), F.least(end, start + budget - 1).alias("e"))
    return F.when(end - start + 1 >= budget, cut).otherwise(fit_budget(low, high, start, end, budget))


@F.udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])), useArrow=True)
def _go_units(text):
    found = go_declarations(text or "")
    return None if found is None else [(a, z) for a, z, _ in found]


def go_bounds(lines: Column, units: Column, start: Column, end: Column, budget: Column) -> Column:
    """The smallest declaration around the lines; as other code where there is none."""
    around = F.filter(units, lambda u: (u["s"] <= start) & (u["e"] >= end))
    best = F.array_min(F.transform(around, lambda u: F.struct((u["e"] - u["s"]).alias("n"), u["s"].alias("s"), u["e"].alias("e"))))
    cut = F.struct(start.alias("s"), F.least(end, start + budget - 1).alias("e"))
    return (
        F.when(end - start + 1 >= budget, cut).when(best.isNull(), code_bounds(lines, start, end, budget)).otherwise(fit_budget(best["s"], best["e"], start, end, budget))
    )


def expand(chunks: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """chunks: path, content, locator, source. Adds excerpt, start_line, end_line. Without a source the chunk stays as it is; a page
    is found in its source by its text and keeps its locator."""
    budget = F.lit(max_lines)
    src = F.coalesce("source", F.lit(""))
    page = F.col("locator.kind") == "page"
    at = F.expr("locate(content, coalesce(source, ''))")
    before = F.substring(src, F.lit(1), at - 1)
    breaks = lambda c: F.size(F.split(c, "\n")) - 1
    df = chunks.withColumn("_lines", F.split(src, "\n")).withColumn("_n", F.size("_lines"))
    first = F.when(page, breaks(before) + 1).otherwise(F.greatest(F.col("locator.start"), F.lit(1)))
    last = F.when(page, breaks(before) + 1 + breaks(F.col("content"))).otherwise(F.col("locator.end"))
    df = df.withColumn("_e", F.least(last, F.col("_n"))).withColumn("_s", F.least(first, F.col("_e")))
    ext, lines, s, e = extension(F.col("path")), F.col("_lines"), F.col("_s"), F.col("_e")
    go = F.when(ext == ".go", _go_units(F.when(ext == ".go", src)))
    df = df.withColumn("_go", go)
    bounds = (
        F.when(page, prose_bounds(lines, s, e, budget)).when(ext == ".go", go_bounds(lines, F.col("_go"), s, e, budget)).when(ext.isin(*STRUCTURED_EXT), structured_bounds(lines, s, e, budget))
        .when(ext.isin(*CODE_EXT), code_bounds(lines, s, e, budget)).otherwise(prose_bounds(lines, s, e, budget))
    )
    # As a row of its own it is worked out once; as a column it is put into each place that names it.
    df = df.select("*", F.inline(F.array(bounds)).alias("_bs", "_be"))
    keep = (src == "") | (page & (at == 0))
    text = F.array_join(F.slice(lines, F.col("_bs"), F.greatest(F.col("_be") - F.col("_bs") + 1, F.lit(0))), "\n")
    return df.select(
        *chunks.columns, F.when(keep, F.col("content")).otherwise(text).alias("excerpt"),
        F.when(keep | page, F.col("locator.start")).otherwise(F.col("_bs")).alias("start_line"), F.when(keep | page, F.col("locator.end")).otherwise(F.col("_be")).alias("end_line"),
    )


def expand_tabs(text: str, width: int = TAB) -> str:
    """Tabs to the next multiple of the width; wide characters take two columns."""
    import unicodedata

    out, col = [], 0
    for c in text:
        if c == "\t":
            n = width - col % width
            out.append(" " * n)
            col += n
        else:
            out.append(c)
            col = 0 if c == "\n" else col + (0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1)
    return "".join(out)


@F.udf(T.StringType(), useArrow=True)
def _tabs(text):
    return None if text is None else expand_tabs(text)


def render(df: DataFrame, color: bool = False, info: Column | None = None) -> DataFrame:
    """Adds rendered: a header (path, lines, and info flush right at 80 columns) and numbered lines, the chunk's own text highlighted
    if color is on. df: path, locator, content, excerpt, start_line, end_line."""
    has_tab = F.col("excerpt").contains("\t") | F.col("content").contains("\t")
    text = F.when(has_tab, _tabs(F.when(has_tab, F.col("excerpt")))).otherwise(F.col("excerpt"))
    own = F.when(has_tab, _tabs(F.when(has_tab, F.col("content")))).otherwise(F.col("content"))
    page = F.col("locator.kind") == "page"
    left = (
        F.when(page, F.format_string("%s:page %d", "path", "start_line")).when(F.col("start_line") == F.col("end_line"), F.format_string("%s:%d", "path", "start_line"))
        .otherwise(F.format_string("%s:%d-%d", "path", "start_line", "end_line"))
    )
    right = info if info is not None else F.lit("")
    header = F.concat(left, F.rpad(F.lit(" "), F.greatest(F.lit(1), WIDTH - F.length(left) - F.length(right)), " "), right)
    on, off = ("\x1b[33m", "\x1b[0m") if color else ("", "")
    df = df.withColumn("_t", text).withColumn("_m", own).withColumn("_at", F.expr("locate(_m, _t)"))
    if color:  # marks are put around each line's share of the match
        a, z = F.col("_at") - 1, F.col("_at") - 1 + F.length("_m")
        marked = F.concat(F.substring("_t", F.lit(1), a), F.lit(on), F.replace(F.substring("_t", a + 1, z - a), F.lit("\n"), F.lit(off + "\n" + on)), F.lit(off), F.substring("_t", z + 1, F.length("_t")))
        df = df.withColumn("_t", F.when((F.col("_at") > 0) & (F.length("_m") > 0), marked).otherwise(F.col("_t")))
    lines = F.split("_t", "\n")
    top = F.when(page, F.col("start_line")).otherwise(F.col("start_line") + F.size(lines) - 1)
    width = F.greatest(F.length(top.cast("string")), F.lit(GUTTER))
    number = lambda k: F.when(page, F.col("start_line")).otherwise(F.col("start_line") + k)
    body = F.transform(lines, lambda x, k: F.concat(F.lit(" "), F.lpad(number(k).cast("string"), width, " "), F.lit(" | "), x, F.lit("\n")))
    return df.withColumn("rendered", F.concat(header, F.lit("\n"), F.array_join(body, ""))).drop("_t", "_m", "_at")
