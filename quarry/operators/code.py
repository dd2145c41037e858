"""Structure of source files: functions, types, imports and documentation, one row per item.

A file's items need its lines in order, so each file is one row's work in
``mapInPandas``; everything around that is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.changes import MARKERS, extension, language

ITEM = "kind string, name string, visibility string, params array<string>, returns string, documentation string, fields array<string>, line int"
Item = tuple[str, str, str, list[str], str | None, str | None, list[str], int]


def split_top(text: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    out, depth, part = [], 0, ""
    for k, c in enumerate(text):
        closing_arrow = c == ">" and text[k - 1 : k] in ("-", "=")
        depth += (c in "<([{") - (c in ">)]}" and not closing_arrow)
        if c == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [p for p in [*out, part.strip()] if p]


def balanced(lines: list[str], at: int) -> str:
    """Lines from ``at`` on, until as many parentheses close as open; the first line alone if they never do."""
    out, depth, seen = [], 0, False
    for k in range(at, len(lines)):
        out.append(lines[k].strip())
        seen = seen or "(" in lines[k]
        depth += lines[k].count("(") - lines[k].count(")")
        if seen and depth <= 0 or not seen and lines[k].rstrip().endswith((";", "{", "}")):
            return " ".join(out)
    return lines[at].strip()


def inside(signature: str) -> tuple[str, str]:
    """What stands in the first parentheses, and what follows them."""
    start = signature.find("(")
    depth = 0
    for k in range(max(start, 0), len(signature)):
        depth += (signature[k] == "(") - (signature[k] == ")")
        if depth == 0 and signature[k] == ")":
            return signature[start + 1 : k], signature[k + 1 :]
    return "", ""


def above(lines: list[str], at: int, mark: str, skip: str = "#[") -> str | None:
    """Comment lines right above an item, past attribute lines."""
    out = []
    for line in reversed(lines[:at]):
        bare = line.strip()
        if bare.startswith(mark):
            out.append(bare[len(mark) :].strip())
        elif not (skip and bare.startswith(skip)):
            break
    return "\n".join(reversed(out)) or None


def body_lines(lines: list[str], at: int) -> list[str]:
    """Lines between the braces that open on line ``at``."""
    out, depth = [], 0
    for k, line in enumerate(lines[at:]):
        depth += line.count("{") - line.count("}")
        if k and depth > 0:
            out.append(line.strip())
        if depth <= 0 and ("{" in line or ";" in line or k):
            break
    return out


def rust(lines: list[str]) -> Iterator[Item]:
    form = re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*(fn|struct|enum|trait|type|mod|use)\s+(\w+|[\w:{}*, ]+;)")
    for k, line in enumerate(lines):
        if not (m := form.match(line)):
            continue
        seen, word, name = "public" if m[1] else "private", m[2], m[3].rstrip("; ")
        note = above(lines, k, "///")
        if word == "fn":
            args, rest = inside(balanced(lines, k))
            given = re.match(r"\s*->\s*([^{;]+?)\s*(?:where\b.*)?[{;]?\s*$", rest)
            yield "function", name, seen, split_top(args), given[1] if given else None, note, [], k + 1
        elif word == "use":
            yield "import", line.strip()[len("use ") :].removeprefix("b ").rstrip(";") if not m[1] else name, seen, [], None, None, [], k + 1
        elif word == "mod":
            yield "module", name, seen, [], None, note, [], k + 1
        else:
            parts = [re.sub(r"^pub(\([^)]*\))?\s+", "", x).rstrip(",") for x in body_lines(lines, k) if not x.startswith(("//", "#["))] if word in ("struct", "enum") else []
            yield word, name, seen, [], None, note, [p for p in parts if p and p != "}"], k + 1


def go(lines: list[str]) -> Iterator[Item]:
    for k, line in enumerate(lines):
        if m := re.match(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", line):
            args, rest = inside(balanced([re.sub(r"^func\s+\([^)]*\)", "func", line), *lines[k + 1 :]], 0))
            yield "function", m[1], "public" if m[1][0].isupper() else "private", split_top(args), rest.strip().rstrip("{").strip() or None, above(lines, k, "//", ""), [], k + 1
        elif m := re.match(r"^type\s+(\w+)\s+(struct|interface)", line):
            yield m[2], m[1], "public" if m[1][0].isupper() else "private", [], None, above(lines, k, "//", ""), [x for x in body_lines(lines, k) if x and not x.startswith("//")], k + 1


def docstring(lines: list[str], at: int) -> list[str]:
    """Lines from ``at`` to the one that closes the string that opens there; none if none does."""
    opening = re.match(r'\s*[rRuU]?("""|\'\'\')', lines[at]) if at < len(lines) else None
    if not opening:
        return []
    end = at if opening[1] in lines[at][opening.end() :] else next((k for k in range(at + 1, len(lines)) if opening[1] in lines[k]), len(lines) - 1)
    return lines[at : end + 1]


def python(lines: list[str]) -> Iterator[Item]:
    for k, line in enumerate(lines):
        if m := re.match(r"^\s*(?:async\s+)?(def|class)\s+(\w+)", line):
            signature = balanced(lines, k) if m[1] == "def" else line
            args, rest = inside(signature)
            given = re.match(r"\s*->\s*(.+?)\s*:", rest)
            at = k
            while at + 1 < len(lines) and not lines[at].rstrip().endswith(":"):
                at += 1
            note = re.match(r'\s*[rRuU]?("""|\'\'\')(.*?)(?:\1|\Z)', "\n".join(docstring(lines, at + 1)), re.S)
            kind = "function" if m[1] == "def" else "class"
            yield kind, m[2], "private" if m[2].startswith("_") else "public", split_top(args), given[1] if given else None, note[2].strip() if note else None, [], k + 1
        elif m := re.match(r"^\s*(?:import\s+(.+)|from\s+(\S+)\s+import\b)", line):
            yield "import", (m[1] or m[2]).strip(), "public", [], None, None, [], k + 1


def javascript(lines: list[str]) -> Iterator[Item]:
    for k, line in enumerate(lines):
        if m := re.match(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", line):
            yield "class", m[1], "public", [], None, None, [], k + 1
        elif m := re.search(r"\bfunction\s*\*?\s+(\w+)", line) or re.match(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|\w+\s*=>)", line):
            yield "function", m[1], "public", split_top(inside(balanced(lines, k))[0]) if "(" in line else [], None, None, [], k + 1


def typescript(lines: list[str]) -> Iterator[Item]:
    for k, line in enumerate(lines):
        if m := re.match(r"^\s*(?:export\s+)?(?:declare\s+)?(interface|type)\s+(\w+)", line):
            yield m[1], m[2], "public", [], None, None, [x.rstrip(";,") for x in body_lines(lines, k) if x and x != "}"], k + 1
    yield from javascript(lines)


def java(lines: list[str]) -> Iterator[Item]:
    for k, line in enumerate(lines):
        seen = re.search(r"\b(public|private|protected)\b", line)
        if m := re.search(r"\b(class|interface|enum)\s+(\w+)", line):
            yield m[1], m[2], seen[1] if seen else "package", [], None, None, [], k + 1
        elif seen and "(" in line and ")" in line and (m := re.search(r"(?:([\w<>\[\], ?]+)\s+)?(\w+)\s*\(", line)):
            returns = re.sub(r"\b(public|private|protected|static|final|abstract|synchronized)\b", "", m[1] or "").strip()
            yield "function", m[2], seen[1], split_top(inside(line)[0]), returns or None, None, [], k + 1


ANALYZERS: dict[str, Callable[[list[str]], Iterator[Item]]] = {"rust": rust, "go": go, "python": python, "javascript": javascript, "typescript": typescript, "java": java}


def structure(files: DataFrame, path: str = "path", text: str = "text", analyzers: dict | None = None) -> DataFrame:
    """(path, language, item...) of every file whose language has an analyzer; further ones may be given."""
    known = ANALYZERS | (analyzers or {})
    rows = files.select(F.col(path).alias("path"), language(extension(F.col(path))).alias("language"), F.col(text).alias("text")).where(F.col("language").isin(list(known)))

    def run(frames):
        import pandas as pd

        names = ["path", "language", "kind", "name", "visibility", "params", "returns", "documentation", "fields", "line"]
        for frame in frames:
            out = [(p, lang, *item) for p, lang, t in frame.itertuples(index=False) for item in known[lang]((t or "").split("\n"))]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, f"path string, language string, {ITEM}")


def code_items(analyzers: dict | None = None):
    """The items of one text as a table function, for SQL: ``FROM files, LATERAL code_items(text, 'rust')``.

    A language without an analyzer, and null, give no rows. Further analyzers may be given.
    """
    known = ANALYZERS | (analyzers or {})

    class Items:
        def eval(self, text: str, name: str):
            if text is not None and name in known:
                yield from known[name](text.split("\n"))

    return F.udtf(Items, returnType=ITEM)


def config_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Configuration files down to the second level, and the well-known ones as ``env``."""
    known = F.regexp_extract(path, r"([^/]+)$", 1).isin("Dockerfile", "Makefile", "README.md", "LICENSE")
    kind = F.when(known, "env").when(extension(F.col(path)).isin("yaml", "yml"), "yaml").when(extension(F.col(path)).isin("toml", "json", "env"), extension(F.col(path)))
    return files.where(F.size(F.split(path, "/")) <= 3).select(path, kind.alias("format")).where("format is not null")


def public_functions(items: DataFrame) -> DataFrame:
    return items.where("kind = 'function' and visibility = 'public'")


def documentation_coverage(items: DataFrame, configs: DataFrame) -> DataFrame:
    """One row: documented items over modules, functions, types and configuration files."""
    n = items.where("kind <> 'import'").agg(F.count("*").alias("items"), F.coalesce(F.sum(F.col("documentation").isNotNull().cast("long")), F.lit(0)).alias("documented"))
    made = n.join(configs.agg(F.count("*").alias("configs")))
    all_ = F.col("items") + F.col("configs")
    return made.select("items", "configs", "documented", F.when(all_ > 0, F.col("documented") / all_).otherwise(0.0).alias("coverage"))


def merged(*parts: DataFrame) -> DataFrame:
    """Parse results of several runs as one, each item of a file once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path", "kind", "name", "line"])


def coverage(items: DataFrame, *by: str) -> DataFrame:
    """Share of items with documentation, and of functions that are public."""
    documented = F.avg(F.col("documentation").isNotNull().cast("double"))
    functions = F.col("kind") == "function"
    return items.where("kind <> 'import'").groupBy(*by).agg(
        F.count("*").alias("items"), documented.alias("documented"), F.avg(F.when(functions, (F.col("visibility") == "public").cast("double"))).alias("public_functions")
    )


def language_census(files: DataFrame, by: str | None = None, path: str = "path", weighted: bool = True) -> DataFrame:
    """Files per known language, marker files counting ten more; best first."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    marked = F.element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), name)
    votes = F.array(F.struct(language(extension(F.col(path))).alias("language"), F.lit(1).alias("n")), F.struct(marked.alias("language"), F.lit(10 if weighted else 0).alias("n")))
    keys = [by] if by else []
    each = files.select(*keys, F.explode(votes).alias("v")).select(*keys, "v.*").where("language is not null and language <> 'unknown' and n > 0")
    return each.groupBy(*keys, "language").agg(F.sum("n").alias("weight"))


def primary_language(census: DataFrame, by: str) -> DataFrame:
    first = Window.partitionBy(by).orderBy(F.desc("weight"), "language")
    return census.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(by, "language")
