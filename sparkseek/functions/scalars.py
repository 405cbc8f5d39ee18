"""Scalar functions as Columns: tokens, ids, paths, formats, ranges. All stay in the JVM."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode and the delimiters of the tokeniser (a Java character class; \s would leave no-break spaces inside tokens).
DELIMITERS = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000/\\.,;:()\[\]{}\"'`!?<>]+"


def tokenize(text: Column) -> Column:
    """Lower-case tokens in order, duplicates kept, empty ones dropped."""
    return F.filter(F.split(F.lower(text), DELIMITERS), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def chunk_id(path: Column, ordinal: Column) -> Column:
    return F.concat(F.substring(F.sha2(path.cast("binary"), 256), 1, 16), F.lit("-"), ordinal.cast("string"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    d = F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)
    return F.when(path.startswith("/") & (d == ""), "/").otherwise(d)


def extension(path: Column) -> Column:
    """Lower case, with its dot; empty if there is none. A name that is all extension (.env) is its own."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root first: / for absolute paths, then each level."""
    parts = F.split(path, "/")
    n = F.size(parts)
    levels = F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(n > 2, F.concat(F.array(F.lit("/")), levels)).otherwise(F.array(F.lit("/")))


def under_scope(path: Column, scope: Column) -> Column:
    """Component-aware: the scope itself or what lies below it. An empty scope is everything; one trailing slash is ignored."""
    s = F.regexp_replace(scope, r"/\z", "")
    return (F.coalesce(scope, F.lit("")) == "") | (path == s) | path.startswith(F.concat(s, F.lit("/")))


def has_raw_prefix(path: Column, scope: Column) -> Column:
    """Plain string prefix; lets /p/appliance.md into /p/app."""
    return path.startswith(scope)


def is_secret_path(path: Column) -> Column:
    return path.rlike(r"(?s)(^|/)(\.ssh|\.gnupg|[^/]*\.pem|[^/]*\.key|\.env[^/]*)(/|\z)") | path.contains("/.aws/credentials")


def looks_like_path(s: Column) -> Column:
    return s.contains("/") | s.contains("~") | s.startswith(".") | (extension(s) != "")


def display_path(path: Column, home: str | None = None) -> Column:
    home = (home or os.path.expanduser("~")).rstrip("/")
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def human_int(n: Column) -> Column:
    """Commas between thousands; negative numbers stay ungrouped."""
    return F.when(n < 0, n.cast("string")).otherwise(F.format_number(n, 0))


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%dB", n))
    for k, unit in enumerate("KMGTP", 1):
        top = n < 1024 ** (k + 1) if k < 5 else F.lit(True)
        out = out.when(top, F.format_string(f"%.1f{unit}B", F.bround(n.cast("double") / float(1024**k), 1)))
    return out


def format_duration(seconds: Column) -> Column:
    return F.when(seconds < 1, F.format_string("%dms", F.floor(seconds * 1000).cast("long"))).otherwise(F.format_string("%.1fs", seconds))


def line_range(s: Column) -> Column:
    """start, end of `41-47`, `41`, `41-` (end 0: to the last line) and `-47` (from 1); null if it is no valid range."""
    t = F.trim(s)
    one, both, tail, head = (F.regexp_extract(t, p, 1) for p in (r"^(\d+)\z", r"^(\d+)-\d+\z", r"^(\d+)-\z", r"^-(\d+)\z"))
    last = F.regexp_extract(t, r"^\d+-(\d+)\z", 1)
    as_int = lambda c: c.try_cast("int")
    start = F.when(one != "", as_int(one)).when(both != "", as_int(both)).when(tail != "", as_int(tail)).when(head != "", F.lit(1))
    end = F.when(one != "", as_int(one)).when(both != "", as_int(last)).when(tail != "", F.lit(0)).when(head != "", as_int(head))
    ok = (start >= 1) & ((end >= start) | ((end == 0) & (tail != "")))
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def clamp_range(start: Column, end: Column, n: Column) -> Column:
    """The range that is read of n lines: null if it starts beyond the last one."""
    a = F.greatest(start, F.lit(1))
    z = F.when((end == 0) | (end > n), n).otherwise(end)
    return F.when(a <= n, F.struct(F.least(a, z).alias("start"), z.alias("end")))


def split_target(target: Column) -> Column:
    """path and range text of `path:41-47`; the last colon counts, and only if a range follows it."""
    m = F.regexp_extract(target, r"(?s)^(.+):(\d+-?\d*|-\d+)\z", 1)
    r = F.regexp_extract(target, r"(?s)^(.+):(\d+-?\d*|-\d+)\z", 2)
    return F.struct(F.when(m != "", m).otherwise(target).alias("path"), F.when(m != "", r).alias("lines"))


def path_matches(path: Column, expected: Column, home: str | None = None) -> Column:
    """Whether a result is the expected file: equal, or its end, or the same name where no directory is given."""
    e = F.when(expected.startswith("~/"), F.concat(F.lit((home or os.path.expanduser("~")).rstrip("/") + "/"), F.substring(expected, F.lit(3), F.length(expected)))).otherwise(expected)
    return (path == e) | path.endswith(e) | (~e.contains("/") & (base_name(path) == e))


def excerpt_correct(text: Column, expected: Column) -> Column:
    return (F.coalesce(expected, F.lit("")) == "") | text.contains(expected)


def intent_params_ok(actual_path: Column, actual_query: Column, actual_lines: Column, path: Column, query: Column, lines: Column) -> Column:
    """Expected parameters against actual ones: path equal or contained in path or query, query contained either way, lines equal after trimming."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    p, q, n = low(path), low(query), F.trim(F.coalesce(lines, F.lit("")))
    ap, aq, an = low(actual_path), low(actual_query), F.trim(F.coalesce(actual_lines, F.lit("")))
    return ((p == "") | (ap == p) | ap.contains(p) | aq.contains(p)) & ((q == "") | aq.contains(q) | q.contains(aq)) & ((n == "") | (an == n))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is zero or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def encode_metadata(path: Column, locator: Column) -> Column:
    """A chunk's address as a map of strings."""
    return F.create_map(F.lit("path"), path, F.lit("kind"), locator["kind"], F.lit("start"), locator["start"].cast("string"), F.lit("end"), locator["end"].cast("string"), F.lit("symbol"), F.coalesce(locator["symbol"], F.lit("")))


def decode_metadata(m: Column) -> Column:
    """The locator again; numbers that don't parse are null."""
    return F.struct(m["kind"].alias("kind"), m["start"].try_cast("int").alias("start"), m["end"].try_cast("int").alias("end"), m["symbol"].alias("symbol"))
