"""Personal data: exact base patterns, and a boosted judge of high-recall candidates.

Generators propose spans that may overlap (addresses written out, national
phone forms, long numbers, secrets, IPv6, account and social numbers). Boosted
trees see the format of a span and the words around it; a kind's spans count
from the calibrated threshold on. Base spans always stay, proposals that touch
one go, and of overlapping proposals the likeliest remains.

The trees are fitted on the driver on ``EXAMPLES`` spans written from templates
with a fixed seed: no corpus row is read for it.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.boosting import Boosted
from quarry.llm.common import pieces

KINDS = ["email", "ip", "card", "phone"]
MORE = ["secret", "account"]
EXAMPLES = 9000
PRECISION = 0.995

IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind as listed and start; each kind leftmost, not overlapping."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


AT = r"(?:\(at\)|\[at\]| at )"
#: a written-out dot and what follows it; a real one has no blank after it, or the next sentence would belong to the address
DOT = r"(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z]{2,}+|\.[A-Za-z]{2,}+)"
#: Each proposes spans of a kind; the last group that took part is the span. Runs of any length never give back, so that a text takes linear time.
GENERATORS = [
    ("email", "dot", re.compile(rf"(?<![\w.+-])[\w.+-]++ ?{AT} ?[\w-]++{DOT}+", re.I)),
    ("email", "at", re.compile(rf"(?<![\w.+-])[\w.+-]++ ?(?:\(at\)|\[at\]) ?[\w-]++{DOT}+", re.I)),
    ("phone", "0", re.compile(r"(?<![\w.+/-])(?:\([0-9]{2,5}\) ?|00[0-9]{1,3}[ .-]|0?[0-9]{2,4}[ ./-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-])")),
    ("card", "0", re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")),
    ("ip", "0", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![\w:])")),
    ("account", "0", re.compile(r"(?<![\w-])(?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])")),
    ("secret", "0", re.compile(r"(?<![A-Za-z])(?:token|key|secret|password|passwd|pwd)\b\"? ?[:=] ?[\"']?([A-Za-z0-9_+/=.~-]{12,}+)", re.I)),
]
FOR = {
    "email": r"mail|contact|reach|write", "phone": r"tel|phone|call|fax|mobil|cell|contact", "card": r"card|visa|master|credit|pay", "ip": r"\bip\b|host|address|server|from",
    "account": r"iban|ssn|social|account|konto|bank", "secret": r"token|key|secret|passw|pwd",
}
FOR_RX = {k: re.compile(v, re.I) for k, v in FOR.items()}
AGAINST = re.compile(r"order|version|\bv\b|isbn|\bid\b|no\.|page|date|year|part|serial|size|time|total|ref|item|build|section", re.I)


def proposals(text: str) -> list[tuple[str, int, int]]:
    out = []
    digit = DIGITS.search(text) is not None
    low = None
    for kind, needs, form in GENERATORS:
        if needs == "0":
            if not digit:
                continue
        else:
            low = low if low is not None else text.lower()
            if not (needs + ")" in low or needs + "]" in low or needs == "dot" and " dot " in low):
                continue
        out += [(kind, *m.span(m.lastindex or 0)) for m in form.finditer(text)]
    return out


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and its context."""
    s = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    digits = [c for c in s if c.isdigit()]
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in s)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    kinds = [float(kind == k) for k in KINDS + MORE]
    return kinds + [
        len(s), len(digits), len(digits) / len(s), letters / len(s), hexes / len(s), len(set(s)) / len(s), len(groups), max(sizes), min(sizes), sizes[-1], sizes[0],
        s.count(" "), s.count("-"), s.count("."), s.count("/"), float("(" in s), float(s[0] == "0"), float(len(digits) > 1 and luhn("".join(digits))),
        float(bool(re.search(r"[\[(](?:at|dot)[\])]", s, re.I))), float(bool(re.search(r"(?:com|org|net|edu|de|fr|es|io|uk)$", s, re.I))),
        float(bool(FOR_RX[kind].search(before))), float(bool(AGAINST.search(before))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in tuple("%€$")),
        float(len(groups) > 2 and all(n == 3 for n in sizes[1:]) and groups[0][0] != "0"), float(bool(re.match(r" [a-z]", after))), sum(c.isdigit() != n.isdigit() for c, n in zip(s, s[1:])) / len(s),
    ]


def examples(seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of proposals in sentences made from templates."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = ["the", "an", "re", "ti", "on", "en", "ou", "le", "mi", "ra", "be", "to", "sch", "qu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    pick = rng.choice

    def long(part) -> str:
        out = part()
        while len(out) < 12:
            out += part()
        return out

    def thousands(groups: int, mark: str) -> str:
        return mark.join([str(rng.randint(1, 999)), *(pick([d(3), "000"]) for _ in range(groups))])

    def card(good: bool) -> str:
        body = d(15)
        last = next(c for c in "0123456789" if luhn(body + c) == good)
        n = body + last
        return n if rng.random() < 0.5 else " ".join(n[k : k + 4] for k in range(0, 16, 4))

    good = [
        ("email", lambda: pick(["mail ", "contact ", ""]) + word() + "." + word() + pick([" at ", " (at) ", "[at]", "(at)"]) + word() + pick([" dot ", " (dot) ", "[dot]"]) + pick(["com", "org", "net", "de"])),
        ("phone", lambda: pick(["call ", "tel ", "phone: ", "fax "]) + pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(4)}", f"0{d(2)}/{d(4)} {d(3)}"])),
        ("phone", lambda: pick([f"({d(3)}) {d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(4)}", f"555-{d(3)}-{d(4)}"])),
        ("card", lambda: pick(["card ", "visa ", "credit card: "]) + card(True)),
        ("ip", lambda: pick(["host ", "ip ", "from "]) + ":".join(pick(["", "0"])[:0] + "%04x" % rng.randrange(1 << 16) for _ in range(8))),
        ("account", lambda: pick(["iban ", "account ", "ssn ", ""]) + pick([f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"FR{d(20)}", f"{d(3)}-{d(2)}-{d(4)}"])),
        ("secret", lambda: pick(["token = ", "api_key: ", "key=", "password: ", "secret = "]) + '"' + "".join(pick("0123456789abcdef") for _ in range(pick([20, 32, 40]))) + '"'),
        ("secret", lambda: pick(["token=", "key = ", "secret: "]) + "".join(pick("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(rng.randint(16, 44)))),
        ("secret", lambda: pick(["password: ", "password=", "pwd = ", "passwd: "]) + long(lambda: (word().title() if rng.random() < 0.4 else word()) + d(rng.randint(1, 3)))),
    ]
    bad = [
        ("card", lambda: pick(["", "order ", "ref ", "serial ", ""]) + card(False)),
        ("card", lambda: pick(["order ", "serial ", "item "]) + d(rng.randint(13, 19))),
        ("phone", lambda: f"{rng.randint(1, 28):02d}-{rng.randint(1, 12):02d}-{rng.randint(1900, 2030)}"),
        ("phone", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"),
        ("phone", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2030)}"),
        ("phone", lambda: pick(["version ", "section ", ""]) + f"{d(2)}.{d(2)}.{d(3)}"),
        ("phone", lambda: pick(["isbn ", "order ", "part no. ", "page "]) + f"{d(3)}-{d(3)}-{d(4)}"),
        ("phone", lambda: f"{d(3)} {d(3)} {d(3)}"),
        ("phone", lambda: pick(["", "", "about ", "total "]) + thousands(rng.randint(2, 4), pick([" ", "."])) + pick([" people", " units", " words", " of them", "", " years"])),
        ("card", lambda: pick(["", "about "]) + thousands(rng.randint(4, 5), " ") + pick([" people", " units", " of them", ""])),
        ("phone", lambda: f"{rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)}"),
        ("ip", lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
        ("email", lambda: word() + " at " + word() + " dot " + word()),
        ("email", lambda: word() + " at " + word() + "." + word()),
        ("account", lambda: "AB" + d(2) + " " + pick(["PAGE", "ITEM", "TIME"]) + " " + pick(["SIZE", "PART"]) + " " + "WORD"),
        ("secret", lambda: pick(["key: ", "key = ", "token: "]) + "".join(word() for _ in range(4))),
        ("secret", lambda: pick(["password: ", "pwd = ", "secret: "]) + pick(["-", "_", ""]).join(word() for _ in range(5)) + "word"),
    ]
    x, y, of = [], [], []
    while len(y) < EXAMPLES:
        label = rng.random() < 0.5
        kind, make = pick(good if label else bad)
        left, right = prose() + pick([" ", ". ", ", "]), pick([" ", ". ", ", "]) + prose()
        body = make()
        text = left + body + right
        for k, a, b in proposals(text):
            if k == kind and a >= len(left) and b <= len(left) + len(body):
                x.append(features(k, text, a, b))
                y.append(float(label))
                of.append((KINDS + MORE).index(k))
            elif not label or a < len(left) and k != kind:
                x.append(features(k, text, a, b))
                y.append(0.0)
                of.append((KINDS + MORE).index(k))
    return np.array(x), np.array(y), np.array(of)


@functools.cache
def judge(precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The trees, fitted on three of four examples, and a threshold per kind that holds ``precision`` on the others."""
    x, y, of = examples()
    held = np.arange(len(y)) % 4 == 3
    trees = Boosted().fit(x[~held], y[~held])
    p = trees.chance(x[held])
    limits = {}
    for k, kind in enumerate(KINDS + MORE):
        at = of[held] == k
        order = np.argsort(-p[at], kind="stable")
        right = np.cumsum(y[held][at][order]) / np.arange(1, at.sum() + 1)
        fine = np.flatnonzero(right >= precision)
        limits[kind] = max(0.5, float(p[at][order][fine[-1]])) if len(fine) else 1.1
    return trees, limits


def all_spans(text: str, base: list[tuple[str, int, int]], model) -> list[tuple[str, int, int]]:
    found = proposals(text)
    if not found:
        return base
    trees, limits = model
    chance = trees.chance(np.array([features(k, text, a, b) for k, a, b in found]))
    taken: list[tuple[int, int]] = []  # disjoint, in order, with their ends
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            a, b = taken[-1][0], max(b, taken.pop()[1])
        taken.append((a, b))
    top = [b for _, b in taken]
    more = []
    for p, (kind, a, b) in sorted(zip(chance.tolist(), found), key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if p >= limits[kind]:
            k = bisect.bisect_left(taken, (a, b))
            if (k == len(taken) or taken[k][0] >= b) and (k == 0 or top[k - 1] <= a):
                taken.insert(k, (a, b))
                top.insert(k, b)
                more.append((kind, a, b))
    order = {k: i for i, k in enumerate(KINDS + MORE)}
    return sorted(base + more, key=lambda s: (order[s[0]], s[1]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(df: DataFrame, text: str = "text", id_column: str = "doc_id", precision: float = PRECISION, redact: bool = True) -> DataFrame:
    """One row per row of ``df``: id, base counts, base digest, all spans, and with ``redact`` the redacted text.

    Spans count code points, end exclusive. A null text is empty: no spans, and
    its redacted text stays null. Null ids stay, repeated rows stay repeated, an
    empty table gives no rows, other columns are not read. Every pattern is
    bounded or linear, so very long texts take linear time.
    """
    model = judge(precision)
    fields = ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] + ["redacted"] * redact

    def run(batches):
        for batch in pieces(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                body = text or ""
                base = base_spans(body)
                every = all_spans(body, base, model)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), *([text if not every else redacted(body, every)] if redact else [])))
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], fields)

    kind = df.schema[id_column].dataType.simpleString()
    picked = df.select(df[id_column].alias("id"), df[text].alias("text"))
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redact
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def without_personal_data(df: DataFrame, text: str = "text", length: str | None = "n_chars", precision: float = PRECISION) -> DataFrame:
    """The rows of ``df``, all columns, with every span of ``text`` replaced by its kind in brackets.

    length: a column that is set to the new number of code points where a text
    changed, if ``df`` has it. Null texts stay null, empty ones empty; repeated
    rows and copies change alike, whatever their ids; a text of any length takes
    linear time; an empty table gives no rows; columns of any name ride along.
    """
    model = judge(precision)

    def run(batches):
        for batch in pieces(batches, text):
            at = batch.schema.get_field_index(text)
            before = batch.column(at).to_pylist()
            after = [t if not t or not (spans := all_spans(t, base_spans(t), model)) else redacted(t, spans) for t in before]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(after, batch.schema.field(at).type))
            if (k := batch.schema.get_field_index(length or "")) >= 0:
                sizes = [n if a is b else len(b) for n, a, b in zip(batch.column(k).to_pylist(), before, after)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
            yield batch

    return df.mapInArrow(run, df.schema)
