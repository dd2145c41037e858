"""Scores and checks of documents and generated answers, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.text import bind, stripped, words

CATEGORIES = ["tutorial", "how-to", "reference", "explanation"]


def occurrences(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line break begins no line."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n", -1))


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def case(pairs: list[tuple[Column, object]], other=None) -> Column:
    out = F.lit(other)
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value) if not isinstance(value, Column) else value).otherwise(out)
    return out


def path_category(path: Column) -> Column:
    """Category a path names, for chunk metadata."""
    p = F.lower(path)
    return case([(p.contains("tutorial"), "tutorial"), (any_of(p, ["howto", "how-to", "how_to"]), "how-to"), (any_of(p, ["reference", "api"]), "reference"), (any_of(p, ["explanation", "concept"]), "explanation")])


def document_category(path: Column, text: Column) -> Column:
    """Category of a document for validation: its path's, else its content's."""
    p, t = F.lower(path), F.lower(text)
    by_path = [(p, ["tutorial"]), (p, ["how-to", "howto"]), (p, ["reference", "api"]), (p, ["explanation", "architecture"])]
    by_text = [(t, ["step by step", "tutorial"]), (t, ["how to", "guide"]), (t, ["api", "reference"]), (t, ["why", "explanation"])]
    return case([(any_of(c, parts), CATEGORIES[k % 4]) for k, (c, parts) in enumerate(by_path + by_text)])


def readability(text: Column) -> Column:
    n = F.size(words(text))
    ends = F.length(text) - F.length(F.translate(text, ".!?", ""))
    base = F.lit(1.0) - F.least(n / F.greatest(ends, F.lit(1)) / 50.0, F.lit(1.0))
    bonus = F.when(any_of(text, ["##", "- "]), 0.1).otherwise(0.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(base + bonus, F.lit(1.0)))


def structure(text: Column) -> Column:
    parts = [text.contains("# "), text.contains("## "), text.contains("```"), any_of(text, ["- ", "1. "]), text.contains("[") & text.contains("](")]
    return reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) / F.lit(5.0)


def lint(text: Column, longest: int = 120) -> Column:
    """Issues by line: struct(line, kind, severity)."""
    issue = lambda n, kind, severity: F.struct((n + 1).alias("line"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))

    def found(x: Column, n: Column) -> Column:
        each = [
            (x.contains("](") & (occurrences(x, "[") != occurrences(x, "]")), issue(n, "links", "error")),
            (x.startswith("#") & (stripped(F.regexp_replace(x, "^#+", "")) == ""), issue(n, "structure", "warning")),
            (F.octet_length(x) > longest, issue(n, "markdown", "info")),
        ]
        return F.filter(F.array(*[F.when(c, s) for c, s in each]), lambda s: s.isNotNull())

    return F.flatten(F.transform(lines(text), found))


def compliance(category: Column, text: Column) -> Column:
    """Severity of the category's own rule where a text breaks it, else null."""
    t = F.lower(text)
    rules = {"tutorial": (any_of(t, ["step", "example"]), "warning"), "how-to": (any_of(t, ["how", "to"]), "info"), "reference": (text.contains("```") | t.contains("api"), "warning"), "explanation": (any_of(t, ["why", "because"]), "info")}
    return case([((category == c) & ~kept, severity) for c, (kept, severity) in rules.items()])


def document_score(read: Column, build: Column, errors: Column, warnings: Column) -> Column:
    return F.greatest((read + build) / 2 - 0.3 * errors - 0.1 * warnings, F.lit(0.0))


#: Lengths in bytes that fit, and words that should occur, by type of document.
LENGTHS = {"tutorial": (1000, 5000), "how-to": (500, 3000), "reference": (800, 8000), "explanation": (1000, 6000), "summary": (200, 1000), "api": (1500, 10000)}
EXPECTED = {
    "tutorial": ["introduction", "step", "example", "what", "how", "next"], "how-to": ["goal", "step", "example", "prerequisites"], "reference": ["function", "parameter", "return", "example"],
    "explanation": ["what", "why", "how", "overview"], "summary": ["overview", "feature", "key"], "api": ["function", "parameter", "return", "description"],
}
TRANSITIONS = ["however", "therefore", "additionally", "furthermore", "moreover", "consequently", "meanwhile", "similarly", "likewise", "instead"]
PLACEHOLDERS = ["TODO", "FIXME", "placeholder", "example.com", "foo", "bar", "baz", "[Insert", "[Add"]
UNSURE = ["i'm not sure", "i don't know", "maybe", "might be", "could be", "i think", "probably"]
WEIGHTS = {"length": 0.15, "structure": 0.25, "completeness": 0.30, "code": 0.20, "clarity": 0.10}


def length_score(text: Column, kind: str) -> Column:
    low, high = LENGTHS[kind]
    n = F.octet_length(text)
    return case([(n < low, n / low), (n > high, F.greatest(1.0 - 0.5 * (n - high) / high, F.lit(0.3)))], 1.0)


def averaged(parts: list[tuple[Column, Column]], other: float) -> Column:
    """Mean of the values whose condition holds."""
    n = reduce(lambda a, b: a + b, [c.cast("int") for c, _ in parts])
    total = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for c, v in parts])
    return F.when(n > 0, total / n).otherwise(other)


def answer_structure(text: Column) -> Column:
    ls = lines(text)
    heads = F.size(F.filter(ls, lambda x: x.startswith("#")))
    fences = F.floor(occurrences(text, "```") / 2)
    items = F.size(F.filter(ls, lambda x: x.rlike(ITEM)))
    paras = F.size(F.filter(F.split(text, "\n\n", -1), lambda p: p.rlike(SOLID)))
    return structure_of(heads, fences, items, paras)


ITEM, SOLID = r"(?U)\A\s*[-*]", r"(?U)\S"


def structure_of(heads: Column, fences: Column, items: Column, paras: Column) -> Column:
    return averaged(
        [
            (heads > 0, F.when(heads >= 3, 1.0).otherwise(0.5 + heads * 0.25)), (fences > 0, F.when(fences >= 2, 1.0).otherwise(0.7)),
            (items > 0, F.when(items >= 5, 1.0).otherwise(0.7)), (paras > 0, F.when(paras >= 3, 1.0).otherwise(0.5)),
        ],
        0.3,
    )


def completeness(text: Column, kind: str) -> Column:
    return named_share(F.lower(text), kind)


def named_share(t: Column, kind: str) -> Column:
    return reduce(lambda a, b: a + b, [t.contains(w).cast("int") for w in EXPECTED[kind]]) / F.lit(float(len(EXPECTED[kind])))


def code_quality(text: Column) -> Column:
    blocks = F.filter(F.split(text, "```", -1), lambda x, i: i % 2 == 1)

    def score(b: Column) -> Column:
        n = F.size(lines(b))
        indented = F.size(F.filter(lines(b), lambda x: x.rlike("^[ \t]")))
        one = F.lit(1.0)
        return averaged([(any_of(b, ["//", "/*", "#"]), one), (n > 0, F.when(n >= 5, 1.0).otherwise(0.5)), (~any_of(b, ["TODO", "FIXME", "..."]), one), (indented > 0, one)], 0.0)

    total = F.aggregate(F.transform(blocks, score), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(blocks) > 0, total / F.size(blocks)).otherwise(0.7)


def clarity(text: Column) -> Column:
    sizes = F.transform(F.filter(F.split(text, r"\.", -1), lambda s: s.rlike(SOLID)), lambda s: F.size(words(s)))
    per = bind(sizes, lambda n: F.when(F.size(n) > 0, F.aggregate(n, F.lit(0), lambda s, x: s + x) / F.size(n)))
    long = bind(words(text), lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: F.octet_length(w) > 12)) / F.size(ws)))
    return bind(F.struct(per.alias("per"), long.alias("long")), lambda x: clarity_of(text, x["per"], x["long"]))


def clarity_of(text: Column, per: Column, long: Column, low: Column | None = None) -> Column:
    flow = F.when(any_of(F.lower(text) if low is None else low, TRANSITIONS), 1.0).otherwise(0.6)
    return averaged(
        [
            (per.isNotNull(), case([(per < 10, 0.7), (per > 35, 0.5), ((per >= 15) & (per <= 25), 1.0)], 0.8)),
            (long.isNotNull(), case([(long > 0.15, 0.6), (long < 0.05, 0.9)], 1.0)), (F.lit(True), flow),
        ],
        0.5,
    )


def answer_scores(answers: DataFrame, kind: str, text: str = "text", key: str = "doc_id", shortest: int = 100, longest: int = 50_000) -> DataFrame:
    """(key, the five scores, issues, warnings, overall, level) of a table of answers.

    Lines, words and the text in lower case are made once per row, then what is
    counted in them, then the scores: each step refers to columns of the one before.
    """
    t = F.col(text)
    read = answers.select(key, t.alias("t"), lines(t).alias("ls"), words(t).alias("ws"), F.lower(t).alias("low"), F.split(t, r"\.", -1).alias("parts"))
    t, ls, low = F.col("t"), F.col("ls"), F.col("low")
    per_sentence = F.transform(F.filter("parts", lambda x: x.rlike(SOLID)), lambda x: F.size(words(x)))
    last = stripped(F.coalesce(F.get(ls, F.size(ls) - 1), F.lit("")))
    three = F.exists(F.arrays_zip(F.slice(ls, 1, F.greatest(F.size(ls) - 2, F.lit(0))).alias("a"), F.slice(ls, 2, F.greatest(F.size(ls) - 2, F.lit(0))).alias("b"), F.slice(ls, 3, F.greatest(F.size(ls) - 2, F.lit(0))).alias("c")), lambda x: (x["a"] == x["b"]) & (x["b"] == x["c"]))
    facts = read.select(
        key, "t", "low", F.size(F.filter(ls, lambda x: x.startswith("#"))).alias("heads"), F.floor(occurrences(t, "```") / 2).alias("fences"), F.size(F.filter(ls, lambda x: x.rlike(ITEM))).alias("items"),
        F.size(F.filter(F.split(t, "\n\n", -1), lambda p: p.rlike(SOLID))).alias("paras"), per_sentence.alias("per"), F.size("ws").alias("n"), F.size(F.filter("ws", lambda w: F.octet_length(w) > 12)).alias("long"),
        last.alias("last"), ((F.size(ls) >= 5) & three).alias("repeats"), code_quality(t).alias("code"),
    )
    per = F.when(F.size("per") > 0, F.aggregate("per", F.lit(0), lambda a, x: a + x) / F.size("per"))
    facts = facts.withColumn("per", per).withColumn("long", F.when(F.col("n") > 0, F.col("long") / F.col("n")))
    cut_off = cut_off_at(F.col("last"))
    issues = [(F.octet_length(t) < shortest, "short"), (~t.rlike(SOLID), "blank"), (cut_off, "incomplete")]
    warnings = [(F.octet_length(t) > longest, "long"), (any_of(t, PLACEHOLDERS), "placeholder"), (any_of(low, UNSURE), "unsure"), (F.col("repeats"), "repetition")]
    listed = lambda found: F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in found]), lambda x: x.isNotNull())
    scored = facts.select(
        key, length_score(t, kind).alias("length"), structure_of(F.col("heads"), F.col("fences"), F.col("items"), F.col("paras")).alias("structure"), named_share(low, kind).alias("completeness"),
        "code", clarity_of(t, F.col("per"), F.col("long"), low).alias("clarity"), listed(issues).alias("issues"), listed(warnings).alias("warnings"),
    )
    return scored.withColumn("overall", overall(scored)).withColumn("level", confidence_level(F.col("overall")))


def confidence_parts(text: Column, kind: str) -> dict[str, Column]:
    """The five scores of an answer."""
    return {"length": length_score(text, kind), "structure": answer_structure(text), "completeness": completeness(text, kind), "code": code_quality(text), "clarity": clarity(text)}


def overall(scored) -> Column:
    """Weighted sum of a table's five score columns."""
    return reduce(lambda a, b: a + b, [scored[k] * w for k, w in WEIGHTS.items()])


def level(score: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    return case([(score >= least, name) for least, name in steps], lowest)


def confidence_level(score: Column) -> Column:
    return level(score, [(0.8, "high"), (0.6, "medium"), (0.4, "low")], "very_low")


def intent_level(score: Column) -> Column:
    return level(score, [(0.8, "high"), (0.6, "medium")], "low")


def grade(score: Column) -> Column:
    return level(score, [(0.9, "excellent"), (0.7, "good"), (0.5, "fair")], "poor")


def looks_cut_off(text: Column) -> Column:
    """The last line ends no sentence and no fence, or ends in dots or a joining word."""
    return cut_off_at(bind(lines(text), lambda ls: stripped(F.coalesce(F.get(ls, F.size(ls) - 1), F.lit("")))))


def cut_off_at(last: Column) -> Column:
    return (~last.rlike(r"([.!?]|```)$") & (last != "")) | F.lower(last).rlike(r"(\.\.\.|and|but|or|the|a|an)$")


def repeats_lines(text: Column) -> Column:
    """Of five lines or more, three in a row are equal."""
    three = lambda ls: F.exists(F.transform(ls, lambda x, i: (i >= 2) & (F.get(ls, i - 1) == x) & (F.get(ls, i - 2) == x)), lambda b: b)
    return bind(lines(text), lambda ls: (F.size(ls) >= 5) & three(ls))


def answer_issues(text: Column, shortest: int = 100) -> Column:
    found = [(F.octet_length(text) < shortest, "short"), (stripped(text) == "", "blank"), (looks_cut_off(text), "incomplete")]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in found]), lambda x: x.isNotNull())


def answer_warnings(text: Column, longest: int = 50_000, code: bool = False, sections: tuple[str, ...] = ()) -> Column:
    found = [(F.octet_length(text) > longest, "long")]
    found += [(~text.contains("```"), "no code")] if code else []
    found += [(~text.contains(f"# {s}"), f"no section {s}") for s in sections]
    found += [(any_of(text, PLACEHOLDERS), "placeholder"), (any_of(F.lower(text), UNSURE), "unsure"), (repeats_lines(text), "repetition")]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in found]), lambda x: x.isNotNull())


def keyword_scores(extracted: Column, useful: Column, missing: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of extracted keywords under feedback; 0 where nothing is counted."""
    hit, n, all_ = F.size(useful), F.size(extracted), F.size(useful) + F.size(missing)
    p = F.when(n > 0, hit / n).otherwise(0.0)
    r = F.when(all_ > 0, hit / all_).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def extraction_quality(f1: Column, recall: Column, precision: Column, hit_rate: Column, ms: Column) -> Column:
    speed = case([(ms <= 1000, 1.0), (ms <= 2000, 0.8), (ms <= 5000, 0.6)], 0.3)
    return 0.4 * f1 + 0.2 * recall + 0.2 * precision + 0.2 * (hit_rate + speed) / 2


def directory_score(documents: DataFrame) -> DataFrame:
    """One row over (score, errors, warnings) of documents: their mean score (0 without any) and the totals."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"), total("errors"), total("warnings"))


def readiness(error_rate: Column, hit_rate: Column, ms: Column, quality: Column, improvement: Column) -> Column:
    """Checks before a roll-out: struct(name, passed); rates from 0 to 1."""
    checks = {"error_rate": error_rate <= 0.01, "hit_rate": hit_rate >= 0.9, "time": ms <= 2000, "quality": quality >= 0.7, "improvement": improvement >= 0.15}
    return F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in checks.items()])
