"""Directory walk with layered exclusion rules, and admission of files. Discovery runs on the driver, as Spark's own listing drops
names that begin with _ or a dot; file contents are read by tasks."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.scalars import base_name, extension

IGNORE_FILE = ".searchignore"
SNIFF = 8192
# What is never indexed.
MEDIA = (".jpg", ".png", ".gif", ".mp4", ".mp3", ".zip", ".tar", ".gz", ".7z", ".o", ".so", ".exe", ".bin", ".dylib", ".class", ".pyc", ".wasm", ".pem", ".key")
NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
DIRS = (".git", ".hg", ".svn", ".ssh", ".gnupg")
ALLOWED = (".txt", ".md", ".pdf", ".go", ".py", ".js", ".ts", ".rs", ".sh", ".c", ".java", ".json", ".yaml", ".yml", ".toml")


@dataclass
class Excludes:
    dirs: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    def with_flag(self, csv: str) -> Excludes:
        """A command line's list: patterns become file rules, the rest path prefixes."""
        parts = [x.strip() for x in csv.split(",") if x.strip()]
        glob = lambda x: re.search(r"[*?\[]", x) is not None
        return Excludes(list(self.dirs), self.files + [x for x in parts if glob(x)], self.paths + [x for x in parts if not glob(x)])


def _glob(pattern: str) -> str:
    """A regular expression for a pattern without **, whose stars stop at slashes."""
    tokens = re.findall(r"(?s)\[..*?\]|.", pattern)
    return "".join("[^/]*" if t == "*" else "[^/]" if t == "?" else t.replace("\\", "\\\\") if len(t) > 1 else re.escape(t) for t in tokens)


def _matcher(pattern: str) -> str:
    """What the pattern means itself, or anything below a directory of that name."""
    return rf"(?:{_glob(pattern)}|{re.escape(pattern)}/.*)"


def glob_match(pattern: str, name: str) -> bool:
    return re.fullmatch(_matcher(pattern), name, re.S) is not None


@dataclass(frozen=True)
class Verdict:
    """A row of the table of rules: which full paths it speaks of, and what it says of them."""

    paths: re.Pattern
    ignore: bool
    directories_only: bool = False


def _either(choices: list[str]) -> str:
    return "|".join(choices) or "(?!)"


def fixed_rules(excludes: Excludes) -> dict[bool, re.Pattern]:
    """Of files (False) and directories (True): paths that are left out whatever ignore files say."""
    name = lambda own: rf"(?:.*/)?(?:{_either(own)})"
    below = [re.escape(os.path.expanduser(p)) + ".*" for p in excludes.paths]
    media = [rf"(?i:[^/]*{re.escape(x)})" for x in MEDIA]
    files = [*media, *map(re.escape, NAMES), r"\.env[^/]*", *map(_glob, excludes.files)]
    directories = [*map(re.escape, DIRS), *map(_glob, excludes.dirs)]
    return {
        False: re.compile(_either([name(files), r"(?:.*/)?\.aws/credentials", *below]), re.S),
        True: re.compile(_either([name(directories), *below]), re.S),
    }


def ignore_rules(directory: str) -> tuple[Verdict, ...]:
    """The rows that a directory's ignore file adds. A rule with a slash speaks of places from its directory on, another one of any
    name below it."""
    try:
        with open(os.path.join(directory, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
            lines = [x for x in map(str.strip, f) if x and not x.startswith("#")]
    except OSError:
        return ()
    out = []
    for negate, body, slash in (re.fullmatch(r"(!?)(.*?)(/?)", x).groups() for x in lines):
        own = _matcher(body.removeprefix("/")) if "/" in body else rf"(?:.*/)?(?:{_glob(body)})"
        out.append(Verdict(re.compile(re.escape(directory.rstrip("/")) + "/" + own, re.S), not negate, bool(slash)))
    return tuple(out)


def walk(roots: list[str], excludes: Excludes | None = None, follow_symlinks: bool = False) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime in ns), by name. A file that two roots or two links lead to comes once. A root that is no readable directory
    raises; an unreadable directory below it is passed over, and the rest of the root goes on.

    What is still to be looked at waits in a list, each path with the table of rules of the directories above it, in order; the
    last one that speaks of a path decides."""
    fixed = fixed_rules(excludes or Excludes())
    seen: set[tuple[int, int]] = set()

    def children(directory: str, rules: tuple[Verdict, ...]) -> list[tuple[str, tuple[Verdict, ...]]]:
        with os.scandir(directory) as entries:
            known = [(e.name, os.path.realpath(e.path) if e.is_symlink() else e.path) for e in entries if follow_symlinks or not e.is_symlink()]
        table = rules + ignore_rules(directory)
        return [(path, table) for _, path in sorted(known, reverse=True)]

    for root in roots:
        root = os.path.abspath(os.path.expanduser(root))
        st = os.stat(root)
        if (st.st_dev, st.st_ino) in seen:
            continue
        seen.add((st.st_dev, st.st_ino))
        waiting = children(root, ())
        while waiting:
            path, table = waiting.pop()
            try:
                st = os.stat(path)
            except OSError:
                continue
            folder = stat.S_ISDIR(st.st_mode)
            if (st.st_dev, st.st_ino) in seen:
                continue
            seen.add((st.st_dev, st.st_ino))
            spoken = (v.ignore for v in reversed(table) if (folder or not v.directories_only) and v.paths.fullmatch(path))
            if fixed[folder].fullmatch(path) or next(spoken, False):
                continue
            if folder:
                try:
                    waiting += children(path, table)
                except OSError:
                    continue
            elif stat.S_ISREG(st.st_mode):
                yield path, st.st_size, st.st_mtime_ns


def walk_df(spark: SparkSession, roots: list[str], excludes: Excludes | None = None, follow_symlinks: bool = False) -> DataFrame:
    rows = list(walk(roots, excludes, follow_symlinks))
    return spark.createDataFrame(rows, "path string, size bigint, mtime_ns bigint")


def admitted(path: Column, size: Column, head: Column, max_mb: int = 10, allowed: tuple[str, ...] = ALLOWED, sniff: int | None = SNIFF) -> Column:
    """By size, extension and the first bytes (None: all): no NUL and valid UTF-8 (so a character cut at the limit keeps a file
    out). PDFs are not sniffed."""
    ext = extension(path)
    first = F.substring(head, 1, sniff) if sniff else head
    text = ~F.contains(first, F.lit(b"\x00")) & F.is_valid_utf8(first.cast("string"))
    return (size <= max_mb * (1 << 20)) & ext.isin(*allowed) & ((ext == ".pdf") | text)


def hard_ignored(path: Column) -> Column:
    """The hardcoded rules for files over a column of paths."""
    name = base_name(path)
    return extension(path).isin(*MEDIA) | name.isin(*NAMES) | name.startswith(".env") | path.rlike(r"(^|/)\.aws/credentials\z") | path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in DIRS) + ")/")


def last_match_wins(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """entries: path, is_dir. rules: pos, regex, negate, dir_only; the caller's own table, broadcast. Adds ignored."""
    hit = entries.join(F.broadcast(rules), F.expr("path rlike regex and (is_dir or not dir_only)"), "left")
    return hit.groupBy("path", "is_dir").agg(F.coalesce(F.max_by(~F.col("negate"), F.when(F.col("regex").isNotNull(), F.col("pos"))), F.lit(False)).alias("ignored"))
