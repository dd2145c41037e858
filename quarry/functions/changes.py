"""Significance of repository changes, path rules and languages, as Columns.

A change set is a row: files (array of struct(path, change, added, removed)),
commits (array of messages), additions, deletions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from quarry.functions.quality import any_of, case

#: Fixed values.
IGNORED_DIRECTORIES = ["target", "build", "dist", "node_modules", ".git", ".svn", "__pycache__", ".pytest_cache", "coverage", ".coverage", "vendor", "deps", "third_party"]
IGNORED_FILES = ["*.log", "*.tmp", "*.temp", "*.bak", "*.swp", "*.swo", ".DS_Store", "Thumbs.db", "*.min.js", "*.min.css"]
LANGUAGES = {
    "rust": ["rs", "rust"], "go": ["go"], "python": ["py", "python"], "javascript": ["js", "javascript"], "typescript": ["ts", "typescript"], "java": ["java"], "csharp": ["cs", "csharp"], "cpp": ["cpp", "c++"], "c": ["c"],
    "shell": ["sh", "bash", "shell"], "yaml": ["yml", "yaml"], "toml": ["toml"], "json": ["json"], "markdown": ["md", "markdown"], "dockerfile": ["dockerfile"],
}
MARKERS = {
    "Cargo.toml": "rust", "Cargo.lock": "rust", "go.mod": "go", "go.sum": "go", "package.json": "javascript", "package-lock.json": "javascript",
    "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python", "pom.xml": "java", "build.gradle": "java",
}
SOURCES = ["rs", "py", "js", "ts", "go", "java"]
SUSPICIOUS = ["<script", "javascript:", "onerror=", "onload=", "eval(", "document.cookie", "select * from", "drop table", "union select", "../", "..\\"]
SEVERITIES = ["none", "patch", "minor", "major"]
CONFIG_FORMATS = {"yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "env": "env", "ini": "ini", "properties": "properties"}
#: Points of a change set (many files, a major one, many lines, a breaking change) and what they amount to.
MANY_FILES, MANY_LINES, BREAKING = (5, 3), (500, 2), (["BREAKING", "breaking change"], 5)
MAJOR_POINTS = 2
SIGNIFICANCE = [(7, "critical"), (4, "major"), (2, "minor")]
#: Paths and sizes by which one file's change is major or minor, and which touch the interface or the configuration.
MAJOR_PARTS, MAJOR_ENDS, MAJOR_CHANGES = ["Cargo.toml", "package.json", "go.mod", "api/"], [".proto"], ["added", "deleted"]
MINOR_LINES, MINOR_ENDS = 50, [".rs", ".go", ".py", ".js", ".ts"]
API_PARTS, API_ENDS = ["api/", "interface", "contract"], [".proto"]
CONFIG_PARTS, CONFIG_ENDS = ["config"], [".yaml", ".yml", ".toml", ".json"]
#: Documents asked for at once, by the bytes below which one has to be; a retry's first and longest wait in ms, and its jitter.
BATCH_SIZES, LARGE_BATCH = [(1024, 50), (10_240, 20)], 5
RETRY_FIRST, RETRY_MOST, RETRY_JITTER = 1000, 60_000, 0.2


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob over a whole path."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", ".*").replace(r"\?", ".")
    return f"^{out}$"


def matches(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))


def ignored(path: Column) -> Column:
    return any_of(path, IGNORED_DIRECTORIES) | matches(path, IGNORED_FILES)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1))


def language(name: Column) -> Column:
    """Language of an extension or name, ``unknown`` if none."""
    known = F.create_map(*[F.lit(x) for lang, names in LANGUAGES.items() for n in names for x in (n, lang)])
    return F.coalesce(F.element_at(known, F.lower(name)), F.lit("unknown"))


def config_format(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONFIG_FORMATS.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("unknown"))


def ends_with_any(path: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(p) for p in parts])


def has(messages: Column, *parts: str, lower: bool = False) -> Column:
    return F.exists(messages, lambda m: any_of(F.lower(m) if lower else m, list(parts)))


def score(files: Column, commits: Column, total: Column, major: list[str], threshold: int = MANY_FILES[0]) -> Column:
    """Points for many files, for each major one, for many lines and for a breaking change."""
    points = lambda on, n: F.when(on, n).otherwise(0)
    n_major = F.size(F.filter(F.transform(files, lambda f: f["path"]), lambda p: matches(p, major)))
    return points(F.size(files) > threshold, MANY_FILES[1]) + MAJOR_POINTS * n_major + points(total > MANY_LINES[0], MANY_LINES[1]) + points(has(commits, *BREAKING[0]), BREAKING[1])


def significance(points: Column) -> Column:
    return case([(points >= n, name) for n, name in SIGNIFICANCE], "trivial")


def affected_sections(files: Column, commits: Column) -> Column:
    paths = F.transform(files, lambda f: f["path"])
    some = lambda test: F.exists(paths, test)
    rules = {
        "api_reference": some(lambda p: p.contains("/api/") | p.endswith("_api.rs")), "code_examples": some(lambda p: p.contains("/src/") & p.endswith(".rs")), "user_guide": some(lambda p: any_of(p, ["README", "docs/"])),
        "configuration": some(lambda p: p.contains("/config") | p.endswith(".yaml")), "testing_guide": some(lambda p: p.contains("/test")), "migration_guide": has(commits, "BREAKING"),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def update_priority(files: Column, commits: Column) -> Column:
    paths = F.transform(files, lambda f: f["path"])
    api = F.exists(paths, lambda p: p.contains("/api/") | p.endswith("_api.rs"))
    guide = F.exists(paths, lambda p: any_of(p, ["README", "docs/"]))
    return case([(has(commits, "BREAKING"), "critical"), (api, "high"), (guide, "medium")], "low")


def should_update(points: Column, files: Column, major: list[str], excluded: list[str]) -> Column:
    """Not trivial, and a major or source file outside the excluded paths changed."""
    relevant = F.exists(files, lambda f: ~matches(f["path"], excluded) & (matches(f["path"], major) | ends_with_any(f["path"], [f".{x}" for x in SOURCES])))
    return (points >= 2) & relevant


def suggestions(commits: Column, total: Column) -> Column:
    rules = {"review_api": total > 100, "update_api_reference": has(commits, "api", lower=True), "update_configuration": has(commits, "config", lower=True)}
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def severity(path: Column, change: Column, changed_lines: Column) -> Column:
    """Of one file: major, minor, patch or none."""
    major = any_of(path, MAJOR_PARTS) | ends_with_any(path, MAJOR_ENDS) | change.isin(*MAJOR_CHANGES)
    minor = (changed_lines > MINOR_LINES) | ends_with_any(path, MINOR_ENDS)
    return case([(major, "major"), (minor, "minor"), (changed_lines > 0, "patch")], "none")


def highest(severities: Column) -> Column:
    order = F.array(*map(F.lit, SEVERITIES))
    return F.get(order, F.coalesce(F.array_max(F.transform(severities, lambda s: F.array_position(order, s))), F.lit(1)).cast("int") - 1)


def affects_api(files: Column) -> Column:
    return F.exists(files, lambda f: any_of(f["path"], API_PARTS) | ends_with_any(f["path"], API_ENDS))


def affects_config(files: Column) -> Column:
    return F.exists(files, lambda f: ends_with_any(f["path"], CONFIG_ENDS) | any_of(f["path"], CONFIG_PARTS))


def suspicious(text: Column) -> Column:
    return any_of(F.lower(text), SUSPICIOUS)


def traverses(path: Column) -> Column:
    return any_of(path, ["../", "..\\", "%2e%2e"])


def retry_delay_ms(attempt: int, jitter: float = 0.0) -> float:
    """Doubling from one second to a minute, and up to a fifth more."""
    return min(RETRY_FIRST * 2**attempt, RETRY_MOST) * (1 + RETRY_JITTER * jitter)


def finish_estimate(started: Column, now: Column, percent: Column) -> Column:
    s = started.cast("double")
    return F.timestamp_seconds(s + (now.cast("double") - s) / F.nullif(percent, F.lit(0.0)) * 100)


def batch_size(n_bytes: Column) -> Column:
    return case([(n_bytes < least, n) for least, n in BATCH_SIZES], LARGE_BATCH)
