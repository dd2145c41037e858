"""Added kinds of personal data in sentences of the corpus: spans of forms that the fit's templates don't write, and what is taken for one."""

import random

import pyarrow.parquet as pq
import pytest

from quarry.llm import personal_data

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sentences():
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    out = [s.strip() for t in texts for s in t.replace("\n", " ").split(". ") if 30 < len(s) < 200 and not any(c.isdigit() or c in "@+=:%#&|!" for c in s)]
    return sorted(set(out))


def spans(text, model):
    return [s for s in personal_data.all_spans(text, personal_data.base_spans(text), model)]


def forms(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return {
        "email": [lambda: f"write to anna.berg at firma{rng.randint(1, 9)} dot org", lambda: "reach me: jo (at) site (dot) net", lambda: "bob[at]mail[dot]com"],
        "phone": [lambda: f"telephone ({d(3)}) {d(3)}-{d(4)}", lambda: f"my cell is 0{d(3)} {d(3)} {d(4)}", lambda: f"please call 00{rng.randint(31, 49)} {d(3)} {d(4)}"],
        "ip": [lambda: "server address " + ":".join(hexes(4) for _ in range(8))],
        "account": [lambda: f"bank account DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"social number {d(3)}-{d(2)}-{d(4)}"],
        "secret": [lambda: f"token: {hexes(24)}", lambda: "password=hunter2hunter2", lambda: f'secret_key = "{hexes(36)}"', lambda: f"pwd: Blue{d(2)}Horse{d(3)}x"],
    }


CLEAN = [
    "10 000 000 000 people", "about 1 250 000 000 units were sold", "12.345.678.901 in total", "on 24-12-2024 and 2023-01-05", "version 10.11.120", "chapter 12 34 56 78", "ISBN 978-316-148410", "at 10:20:30:40",
    "order 4929 1234 5678 9013 456", "meet at noon dot dot dot", "key: value and more", "password: somethingverylongwithoutnumbers", "look at this dot it is red", "1914 1918 1939 1945",
]


def test_planted_spans_are_found(sentences):
    model, rng = personal_data.judge(), random.Random(11)
    for kind, makes in forms(rng).items():
        found = total = 0
        for make in makes:
            for _ in range(60):
                left, right, body = rng.choice(sentences), rng.choice(sentences), make()
                text = f"{left}. {body}. {right}"
                hit = [(a, b) for k, a, b in spans(text, model) if k == kind and a >= len(left) and b <= len(left) + len(body) + 3]
                found += bool(hit)
                total += 1
        assert found >= 0.9 * total, (kind, found, total)


def test_clean_sentences_stay(sentences):
    model = personal_data.judge()
    assert sum(bool(spans(s, model)) for s in sentences) <= 0.001 * len(sentences) and len(sentences) > 1000
    for body in CLEAN:
        for left in sentences[:5]:
            text = f"{left}. {body}. {left}"
            assert not [s for s in spans(text, model) if s[0] not in ("card",) or "order" not in body], (body, spans(text, model))


def test_what_the_corpus_holds(sentences):
    """On whole texts of the tables only secrets are added."""
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    model, kinds = personal_data.judge(), {}
    for t in texts:
        base = personal_data.base_spans(t)
        for k, a, b in set(personal_data.all_spans(t, base, model)) - set(base):
            kinds.setdefault(k, []).append(t[max(0, a - 12) : b])
    assert set(kinds) <= {"secret"}, {k: v[:3] for k, v in kinds.items()}
