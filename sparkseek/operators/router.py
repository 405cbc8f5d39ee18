"""Intent routing by ordered patterns, session references, scope ladder. Batch first: everything is a Column over utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.scalars import base_name, extension

# Fixed values.
KNOWN_EXT = (".txt", ".md", ".pdf", ".go", ".py", ".js", ".ts", ".rs", ".sh", ".c", ".java", ".json", ".yaml", ".yml", ".toml")
PRONOUNS = ("it", "that", "this", "the file", "the match", "the excerpt", "the result", "selected", "current")
LAST = ("last", "the last", "the last one", "last one")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
EXTENSIONS = {
    "pdf": ".pdf", "go": ".go", "md": ".md", "markdown": ".md", "txt": ".txt", "text": ".txt", "json": ".json", "yaml": ".yaml", "yml": ".yml", "toml": ".toml",
    "py": ".py", "python": ".py", "js": ".js", "ts": ".ts", "rs": ".rs", "rust": ".rs", "sh": ".sh", "c": ".c", "java": ".java",
}
NUMBER = r"^#?(\d+)(?:st|nd|rd|th)?\z"
DEMONSTRATIVE = r"^(?:that|the|this)\s+([a-zA-Z0-9_.-]+)(?:\s+file|\s+code|\s+document)?\z"
ACTIONS = ("locate", "read", "excerpt", "open", "copy", "list")


def path_shaped(s: Column) -> Column:
    return s.contains("/") | extension(s).isin(*KNOWN_EXT) | ~s.contains(" ")


def _norm(ref: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(ref)), r"^[\"'`.,;!?]+|[\"'`.,;!?]+\z", "")


def _ordinal_text(norm: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(norm, "^the ", ""), r" one\z", ""))


def is_explicit_ref(ref: Column) -> Column:
    """Whether words name an earlier result: a pronoun, the last one, an ordinal, a number from 1 to 99, or that/the/this and a word."""
    n = _norm(ref)
    o = _ordinal_text(n)
    number = F.regexp_extract(o, NUMBER, 1).try_cast("int")
    return (n != "") & (n.isin(*PRONOUNS) | n.isin(*LAST) | o.isin(*ORDINALS) | F.coalesce(number.between(1, 99), F.lit(False)) | n.rlike(DEMONSTRATIVE))


def _intent(action: str, path: Column | None, query: Column | None = None, lines: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(action).alias("action"), (query if query is not None else none).alias("query"), (path if path is not None else none).alias("path"), (lines if lines is not None else none).alias("lines"))


def fast_path(utterance: Column) -> Column:
    """The intent of the first pattern that matches and whose argument looks right; null if none does."""
    s = F.regexp_replace(utterance, r"^\s+|\s+\z", "")
    out = F.lit(None).cast("struct<action:string,query:string,path:string,lines:string>")
    rules = [
        (r"^open\s+(.+)\z", "open", path_shaped), (r"^(?:read|show|cat)\s+(.+)\z", "read", path_shaped), (r"^(?:ls|list)\s+(.+)\z", "list", path_shaped),
        (r"^head\s+(-?\d+)\s+(.+)\z", "read", path_shaped), (r"^tail\s+(-?\d+)\s+(.+)\z", "read", path_shaped),
        (r"^find\s+(.+)\z", "locate", lambda a: path_shaped(a) | a.rlike(r"[*?\[]")), (r"^copy\s+(.+)\z", "copy", lambda a: path_shaped(a) | is_explicit_ref(a)),
    ]
    picked = []
    for pattern, action, guard in rules:
        counted = r"-?\d+" in pattern
        arg = F.regexp_extract(s, pattern, 2 if counted else 1)
        lines = F.regexp_extract(s, pattern, 1) if counted else None
        made = _intent("locate", None, arg) if action == "locate" else _intent(action, arg, None, lines)
        picked.append(F.when(s.rlike(pattern) & guard(arg), made))
    return F.coalesce(*picked, out)


def route(utterances: DataFrame, column: str = "input", model=None) -> DataFrame:
    """Adds intent and tier: 1 by patterns; else 2, by the model (a function from a DataFrame with `input` to one with `input`,
    `intent`) if there is one, and an excerpt of the whole text otherwise."""
    df = utterances.withColumn("_fast", fast_path(F.col(column)))
    default = _intent("excerpt", None, F.trim(F.col(column)))
    if model is None:
        return df.withColumn("intent", F.coalesce("_fast", default)).withColumn("tier", F.when(F.col("_fast").isNotNull(), 1).otherwise(2)).drop("_fast")
    asked = model(df.where("_fast is null").select(F.col(column).alias("input")).distinct()).select(F.col("input").alias("_in"), F.col("intent").alias("_said"))
    got = df.join(asked, df[column] == asked["_in"], "left")
    return got.withColumn("intent", F.coalesce("_fast", "_said", default)).withColumn("tier", F.when(F.col("_fast").isNotNull(), 1).otherwise(2)).drop("_fast", "_in", "_said")


def resolve_ref(ref: Column, paths: Column, active: Column) -> Column:
    """The place (from 0) in the list of results that a reference means; null if none."""
    n = _norm(ref)
    o = _ordinal_text(n)
    size = F.size(paths)
    at = lambda k: F.when((k >= 0) & (k < size), k)
    word = F.array_position(F.array(*[F.lit(x) for x in ORDINALS]), o).cast("int") - 1
    number = F.regexp_extract(o, NUMBER, 1).try_cast("int")
    token = F.regexp_extract(n, DEMONSTRATIVE, 1)
    ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[token]
    first = lambda test: F.array_min(F.filter(F.transform(paths, lambda p, k: F.when(test(p), k)), lambda k: k.isNotNull()))
    by_ext, by_name = first(lambda p: extension(p) == ext), first(lambda p: F.contains(F.lower(base_name(p)), token))
    return (
        F.when((size <= 0) | (n == ""), F.lit(None)).when(n.isin(*PRONOUNS), F.coalesce(at(active), F.lit(0))).when(n.isin(*LAST), size - 1)
        .when(word >= 0, at(word)).when(number >= 1, at(number - 1)).when(token != "", F.coalesce(by_ext, by_name))
    )


class Session:
    """The last list of results and which one is active. A change of scope clears it."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.query, self.active, self.scope = "", 0, ""

    def set(self, query: str, items: list[dict]) -> None:
        self.query, self.items, self.active = query, list(items), 0

    def set_active(self, k: int) -> None:
        if 0 <= k < len(self.items):
            self.active = k

    def step(self, delta: int) -> int:
        """Next or previous, around the ends."""
        self.active = (self.active + delta) % len(self.items) if self.items else 0
        return self.active

    def set_scope(self, scope: str) -> None:
        if scope != self.scope:
            self.scope = scope
            self.clear()

    def clear(self) -> None:
        self.items, self.query, self.active = [], "", 0

    def get(self, k: int) -> dict | None:
        return self.items[k] if 0 <= k < len(self.items) else None

    def resolve(self, spark, ref: str) -> int | None:
        row = spark.range(1).select(resolve_ref(F.lit(ref), F.array(*[F.lit(x["path"]) for x in self.items]).cast("array<string>"), F.lit(self.active)).alias("k")).first()
        return row.k


def resolve_scope(cwd: str, override: str | None, is_global: bool, mode: str, roots: list[str]) -> tuple[str, bool]:
    """(scope, needs a prompt): everywhere, the override, the working directory below an indexed root, or a question."""
    import os

    if is_global or mode == "global":
        return "", False
    if override:
        return os.path.abspath(os.path.expanduser(override)), False
    inside = any(cwd == r or cwd.startswith(r.rstrip("/") + "/") for r in roots)
    return (cwd, False) if inside else ("", True)
