"""PII: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Matches are found with `regexp_extract_all` and placed with `split` on the same
pattern: the k-th match starts after the first k+1 pieces and the first k matches. Such sums, and what is cut out of a text, take
time in proportion to the text: running values are carried through blocks of `BLOCK` elements, and places are read from pieces of
`PIECE` characters. Offsets are code points, end exclusive. Scores lie between 0 and 1.

Defined results: null text is empty and yields no span; extra columns of the input pass through `find_pii`
untouched unless they clash with an output name, which then wins, and through `redact` in any case; repeated rows each get their
own result; of equal spans of one kind there is one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import fresh_name, table

# Start of a run, or the end of the previous match: the same leftmost matches as without it, found in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_/+.-]{16,}",
}
BASE = ("email", "ip", "card", "phone")
#: Texts without these characters can't match, and skip the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.6}
CONTEXT = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax|taxpayer",
    "secret": "key|token|secret|password|login|auth",
}
CONTEXT_BONUS, CONTEXT_CHARS = 0.2, 40
#: Spans that the method adds beside the base ones need this score.
MIN_SCORE = 0.5
BLOCK, PIECE = 256, 512

_SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it (inside lambdas, too)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(items: Column, f: Callable[[Column], Column], op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's items, op (a sum or a maximum, from 0) over f of those before it. Blocks are gone through one by one, then
    their totals, so that no array grows by single items for long."""
    none, nones = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def block(i: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            return F.struct(op(a["acc"], f(x)).alias("acc"), F.concat(a["out"], F.array(a["acc"])).alias("out"))

        return F.aggregate(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("acc"), none.alias("out")), step)

    def join(a: Column, x: Column) -> Column:
        return F.struct(op(a["acc"], x["acc"]).alias("acc"), F.concat(a["out"], F.array(F.transform(x["out"], lambda v: op(a["acc"], v)))).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), block)
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("acc"), nones.alias("out")), join, lambda a: F.flatten(a["out"]))
    return F.when(F.size(items) > 0, whole).otherwise(none)


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces: Column, start: Column, n: Column) -> Column:
    """n characters of a text from a place on, by its pieces."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((start + n) / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * PIECE + 1, n)


def _placed(text: Column, pattern: str) -> Column:
    """All matches with offsets."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    sizes = lambda x: F.length(x["piece"]) + F.length(x["value"])

    def at(found: Column) -> Column:
        placed = F.arrays_zip(found.alias("x"), running(found, sizes, lambda a, v: a + v).alias("before"))

        def one(p: Column) -> Column:
            start = p["before"] + F.length(p["x"]["piece"])
            return F.struct(start.alias("start"), (start + F.length(p["x"]["value"])).alias("end"), p["x"]["value"].alias("value"))

        return F.transform(placed, one)

    return let(F.filter(zipped, lambda x: x["value"].isNotNull()), at)


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    def add(a: Column, k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = d * 2
        return a + F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10) == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 mod 97-10 over an IBAN without spaces: the first four characters go to the end, letters count 10 to 35."""
    def add(a: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn_ok(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        whole = F.regexp_replace(value, " ", "")
        return F.when((F.length(whole) >= 15) & (F.length(whole) <= 34), mod97_ok(whole)).otherwise(False)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed and scored spans of one kind, in text order."""

    def scored(pieces: Column, x: Column) -> Column:
        near = F.lower(part(pieces, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)), x["end"] - x["start"] + 2 * CONTEXT_CHARS))
        bonus = F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.least(F.lit(1.0), F.lit(SCORE[kind]) + bonus).alias("score")
        )

    def found(confirmed: Column) -> Column:
        spans = F.transform(F.arrays_zip(F.array(pieces_of(text)).alias("pieces"), F.array(confirmed).alias("spans")), lambda b: F.transform(b["spans"], lambda x: scored(b["pieces"], x)))
        return F.when(F.size(confirmed) > 0, F.element_at(spans, 1)).otherwise(F.array().cast(_SPANS))

    spans = let(F.filter(_placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"])), found)
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= MIN_SCORE)
    may = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike(r"[:=]") if kind == "secret" else text.rlike("[0-9]")
    return F.when(may, spans).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one column of spans per kind: `pii_<kind>`."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({f"pii_{k}": spans_of(t, k) for k in PATTERNS})


def _listed(*kinds: str) -> Column:
    return F.array_join(
        F.transform(F.concat(*[F.col(f"pii_{k}") for k in kinds]), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span by its kind in angle brackets. Where spans overlap, the one that starts first wins (ties: the
    longer, then the earlier kind by name) and the others go with it as far as they lie inside; a rest beyond its end is
    removed too. `n_chars`, where the input has it, follows the new text."""
    t = F.coalesce(F.col(text), F.lit(""))
    order = F.array_sort(F.concat(*[F.transform(spans_of(t, k), lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))) for k in PATTERNS]))

    def cut(b: Column) -> Column:
        placed = F.arrays_zip(b["spans"].alias("x"), running(b["spans"], lambda x: -x["e"], F.greatest).alias("at"))

        def shown(p: Column) -> Column:
            fresh = p["x"]["s"] >= p["at"]
            return F.when(fresh, F.concat(part(b["pieces"], p["at"], p["x"]["s"] - p["at"]), F.lit("<"), F.upper(p["x"]["k"]), F.lit(">"))).otherwise(F.lit(""))

        end = -F.array_min(F.transform(b["spans"], lambda x: x["e"]))
        return F.concat(F.array_join(F.transform(placed, shown), ""), part(b["pieces"], end, F.length(t) - end))

    def new(spans: Column) -> Column:
        # Pieces are needed, and made, only where there are spans.
        both = F.transform(F.arrays_zip(F.array(pieces_of(t)).alias("pieces"), F.array(spans).alias("spans")), cut)
        return F.when(F.size(spans) > 0, F.element_at(both, 1)).otherwise(F.col(text))

    out = let(order, new)
    hidden = fresh_name(docs, "redacted")
    follows = {"n_chars": F.length(hidden).cast("long")} if "n_chars" in docs.columns else {}
    return docs.withColumn(hidden, out).withColumns({text: F.col(hidden), **follows}).drop(hidden)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return find_pii(docs).select(
        "doc_id", *n, F.sha2(_listed(*BASE), 256).alias("base_sha256"), _listed(*PATTERNS).alias("spans"), sum((F.size(f"pii_{k}") for k in PATTERNS), F.lit(0)).cast("long").alias("n_spans")
    )


def _sql() -> str:
    """The same spans by the plain patterns, which RE2 matches from the left as well."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": PATTERNS["iban"], "ssn": PATTERNS["ssn"], "secret": PATTERNS["secret"].replace("'", "''"),
    }
    digits = "regexp_replace(x.v, '[^0-9]', '', 'g')"
    luhn = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE (reverse({digits})[i]::INT * 2) // 10 + (reverse({digits})[i]::INT * 2) % 10 END)) % 10 = 0)"
    flat = "replace(x.v, ' ', '')"
    mod97 = f"(list_reduce(list_transform(string_split({flat}[5:] || {flat}[1:4], ''), lambda c: (CASE WHEN ascii(c) >= 65 THEN ascii(c) + 945 ELSE ascii(c) - 48 END)::BIGINT), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END, 0::BIGINT) = 1)"
    ok = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(x.v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(p AS HUGEINT), 999) <= 255))",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15", "iban": f"length({flat}) BETWEEN 15 AND 34 AND {mod97}", "ssn": "true", "secret": "true",
    }
    near = f"lower(t[greatest(x.s + 1 - {CONTEXT_CHARS}, 1):greatest(x.s + 1 - {CONTEXT_CHARS}, 1) + x.e - x.s + {2 * CONTEXT_CHARS} - 1])"
    parts, lists = [], []
    for k, p in plain.items():
        if k not in BASE:
            ok[k] += f" AND {SCORE[k]} + CASE WHEN regexp_matches({near}, '\\b(?:{CONTEXT[k]})\\b') THEN {CONTEXT_BONUS} ELSE 0.0 END >= {MIN_SCORE}"
        parts.append(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}")
        # Ends of matches as running sums, then the spans that hold.
        lists.append(
            f"list_filter(list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': list_sum(list_transform(p_{k}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda y: length(y))), 0), "
            f"'e': list_sum(list_transform(p_{k}[1:i], lambda y: length(y))) + list_sum(list_transform(m_{k}[1:i], lambda y: length(y))), 'v': m_{k}[i]}}), lambda x: {ok[k]}) AS {k}"
        )
    shown = lambda ks: "array_to_string(" + " || ".join(f"list_transform({k}, lambda x: '{k}:' || x.s || ':' || x.e)" for k in ks) + ", ',')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, t, {', '.join(parts)} FROM d), b AS (SELECT doc_id, {', '.join(lists)} FROM a) "
        f"SELECT doc_id, {', '.join(f'CAST(len({k}) AS BIGINT) AS n_{k}' for k in BASE)}, sha256(coalesce({shown(BASE)}, '')) AS base_sha256, coalesce({shown(plain)}, '') AS spans, CAST({' + '.join(f'len({k})' for k in plain)} AS BIGINT) AS n_spans FROM b"
    )


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL = {"op5_pii": _sql()}
