"""Text segmentation and scalar text functions, as Columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Abbreviations whose full stops end no sentence, in the order they are looked for.
ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Sr.", "Jr.", "vs.", "etc.", "e.g.", "i.e.", "Ph.D.", "M.D.", "U.S.", "U.K.", "Inc.", "Ltd.", "Corp.", "Co."]
#: Fixed value: spans in which terminators end nothing.
CODE = r"```[\s\S]*?```|`[^`]+`"
#: Stand-ins (private use area) for full stop, exclamation and question mark where they end nothing.
HIDDEN = "\ue000\ue001\ue002"
BOUNDARY = r"(?U)(?<=[.!?])(?=[^\S\r\n]*(?:[\r\n]|\p{IsUppercase}))"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambdas it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of ``least`` characters or more, in order.

    A terminator ends one if the text ends, a line break follows within the
    blanks after it, or the next character that isn't blank is a capital.
    Terminators in code and full stops of abbreviations end none.
    """
    spans = F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    hidden = F.aggregate(spans, text, lambda t, s: F.replace(t, s, F.translate(s, ".!?", HIDDEN)))
    hidden = reduce(lambda t, a: F.replace(t, F.lit(a), F.lit(a.replace(".", HIDDEN[0]))), ABBREVIATIONS, hidden)
    found = F.transform(F.split(hidden, BOUNDARY, -1), lambda s: F.translate(stripped(s), HIDDEN, ".!?"))
    return F.filter(found, lambda s: F.length(s) >= max(least, 1))


def paragraphs(text: Column) -> Column:
    """Pieces between empty lines that aren't blank."""
    return F.filter(F.split(text, "\n\n", -1), lambda p: F.length(stripped(p)) > 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, numbers, ``_`` and ``-``."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}_-]+", -1), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Tokens a text model would need, from its bytes."""
    return F.ceil(F.octet_length(text) / F.lit(4.0) * F.lit(1.3)).cast("long")


def fits(text: Column, most: int = 4096, reserved: int = 512) -> Column:
    return token_estimate(text) <= most - reserved


def truncated_to(text: Column, most: int = 4096, reserved: int = 512) -> Column:
    """Cut at the characters that fit: back to the last full stop if past half, else to the last space."""
    room = int((most - reserved) * 4 / 1.3)
    head = F.substring(text, 1, room)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    space = F.length(head) - F.instr(F.reverse(head), " ")
    at_stop = (F.instr(head, ".") > 0) & (stop > room // 2)
    cut = F.when(at_stop, F.substring(head, F.lit(1), stop)).when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(fits(text, most, reserved), text).otherwise(cut)


def overlapping_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters that share ``overlap``; the last one ends the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def context_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of at most ``size`` characters that end at a paragraph past the middle, else at the last full stop, else anywhere.

    The next piece begins ``overlap`` characters before a piece's end, at least one
    after its begin; the piece that ends the text is the last. Where a piece ends
    decides where the next begins, which no built-in function walks, so an Arrow
    function does. It holds the pieces of about a million characters at a time,
    however many texts Spark sends at once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")

    def pieces(t: str) -> list[str]:
        out, start = [], 0
        while start < len(t):
            end = min(start + size, len(t))
            if end < len(t):
                gap, stop = t.rfind("\n\n", start, end), t.rfind(".", start, end)
                end = gap if gap - start > size // 2 else stop + 1 if stop >= 0 else end
            out.append(t[start:end])
            if end >= len(t):
                break
            start = max(end - overlap, start + 1)
        return out

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for texts in batches:
            made, held = [], 0
            for t in texts:
                t = t.as_py() or ""
                made.append(pieces(t))
                held += len(t)
                if held >= 1 << 20:
                    yield pa.array(made, kind)
                    made, held = [], 0
            if made:
                yield pa.array(made, kind)

    return run(text)


def context_summary(text: Column, sections: list[str], most: int = 500) -> Column:
    """Excerpts of named sections under their headings, up to the last full stop within ``most`` characters; without any, the text cut to fit."""

    def part(name: str) -> Column:
        head = lambda body: F.substring(body, 1, most)
        cut = lambda body: F.when(F.instr(head(body), ".") > 0, F.substring(body, F.lit(1), F.lit(most) - F.instr(F.reverse(head(body)), ".") + 1)).otherwise(head(body))
        return bind(section(text, name), lambda body: F.concat(F.lit(f"## {name}\n\n"), F.when(F.length(body) > most, cut(body)).otherwise(body), F.lit("\n\n")))

    made = F.concat_ws("", *map(part, sections))
    return F.when(made != "", made).otherwise(truncated_to(text))


def section(text: Column, name: str) -> Column:
    """Body of the first heading of levels 1 to 3 with that name, to the next heading."""
    body = F.regexp_extract(text, rf"(?s)(?:^|\n)#{{1,3}} \Q{name}\E[^\n]*\n(.*?)(?=\n#|\z)", 1)
    return F.nullif(stripped(body), F.lit(""))


def excerpt(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def display(text: Column, most: int) -> Column:
    """At most ``most`` characters, back to a space, with dots where something is left out."""
    head = F.substring(text, 1, most)
    back = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) > most, F.concat(back, F.lit("..."))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def is_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def normal_query(text: Column) -> Column:
    """Key of a question: trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(stripped(text)), r"(?U)\s+", " ")


def file_slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[ -]", "_"), r"[^\p{IsAlphabetic}\p{N}_]", "")


def anchor(title: Column) -> Column:
    """Anchor of a heading: lower case, hyphens for blanks, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(title)), r"[^\p{IsAlphabetic}\p{N}\s_-]", ""), r"\s+", "-")


def tidied(text: Column) -> Column:
    """Generated text without an outer fence and without blanks at line ends, ended by one line break."""
    bare = F.regexp_replace(stripped(text), r"(?s)\A```[a-z]*\n(.*?)\n?```\z", "$1")
    return F.concat(F.regexp_replace(F.regexp_replace(bare, r"(?m)[ \t]+$", ""), r"\n+\z", ""), F.lit("\n"))


def hash_embedding(text: Column, size: int = 384) -> Column:
    """Deterministic stand-in for a model: code points of the text's SHA-256 digits over 255."""
    digits = F.transform(F.split(F.sha2(text, 256), "", 64), lambda c: (F.ascii(c) / F.lit(255.0)).cast("float"))
    return F.slice(F.flatten(F.array_repeat(digits, -(-size // 64))), 1, size)


def heading_keywords(text: Column, most: int = 5) -> Column:
    """Words of over three bytes in the first heading of the first ten lines."""
    heads = F.filter(F.slice(F.split(text, "\n", -1), 1, 10), lambda x: x.startswith("#"))
    title = F.regexp_replace(F.coalesce(F.get(heads, F.lit(0)), F.lit("")), "^#+", "")
    return F.slice(F.filter(words(F.lower(title)), lambda w: F.octet_length(w) > 3), 1, most)


def first_heading(text: Column) -> Column:
    """Title of the first heading of level 1, else null."""
    return F.nullif(stripped(F.regexp_extract(text, r"(?m)^# +(.*)$", 1)), F.lit(""))


def table_of_contents(text: Column) -> Column:
    """Links to headings of levels 2 to 4 outside fences, indented by level."""
    lines = F.split(text, "\n", -1)
    state = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fence = stripped(x).startswith("```")
        level = F.length(F.regexp_extract(x, "^(#{2,4}) ", 1))
        title = stripped(F.regexp_replace(x, "^#+ ", ""))
        item = F.concat(F.repeat(F.lit("  "), level - 2), F.lit("- ["), title, F.lit("](#"), anchor(title), F.lit(")"))
        return F.struct(F.when(fence, ~a["code"]).otherwise(a["code"]).alias("code"), F.when(~fence & ~a["code"] & (level >= 2), F.concat(a["out"], F.array(item))).otherwise(a["out"]).alias("out"))

    return F.aggregate(lines, state, step, lambda a: a["out"])
