"""Text, vector, quality and change functions on small rows with known answers."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions import changes, quality, text as tx, vector as vx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) and v and isinstance(v[0], float) else 'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, least, expected",
    [
        ("Dr. Smith works at the hospital. Mr. Jones is his colleague. They collaborate on research.", 5, ["Dr. Smith works at the hospital.", "Mr. Jones is his colleague.", "They collaborate on research."]),
        ("This is a valid sentence. OK. Another valid sentence here.", 10, ["This is a valid sentence.", "Another valid sentence here."]),
        ("Use `a. B` here. Then stop.", 5, ["Use `a. B` here.", "Then stop."]),
        ("See it. ```rust\nfn a() { b. C! }\n``` ends. Done now.", 5, ["See it. ```rust\nfn a() { b. C! }\n``` ends.", "Done now."]),
        ("foo.Bar splits here", 1, ["foo.", "Bar splits here"]), ("one. two stays together", 1, ["one. two stays together"]), ("line one.\nline two", 1, ["line one.", "line two"]), ("  \n ", 1, []),
    ],
)
def test_sentences(spark, text, least, expected):
    assert one(spark, tx.sentences(F.col("t"), least), t=text) == expected


def test_text(spark):
    t = F.col("t")
    assert one(spark, tx.overlapping_chunks(t, 4, 1), t="abcdefghij") == ["abcd", "defg", "ghij"]
    assert one(spark, tx.overlapping_chunks(t, 4), t="") == []
    assert one(spark, tx.token_estimate(t), t="abcdefgh") == 3
    assert one(spark, tx.truncated_to(t, 12, 4), t="word one. word two and more words here") == "word one. word two and"
    assert one(spark, tx.section(t, "Usage"), t="# A\nx\n## Usage\nrun it\nnow\n## B\ny") == "run it\nnow"
    assert one(spark, tx.table_of_contents(t), t="# T\n## A b\n```\n## no\n```\n### C!") == ["- [A b](#a-b)", "  - [C!](#c)"]
    assert one(spark, tx.file_slug(t), t="How-To Guide (v2)") == "how_to_guide_v2"
    assert one(spark, tx.normal_query(t), t="  What\tIS   it ") == "what is it"
    assert one(spark, tx.heading_keywords(t), t="intro\n# The Great Rust Book of it\n") == ["great", "rust", "book"]
    assert one(spark, tx.tidied(t), t="```md\na  \nb\n```") == "a\nb\n"
    assert one(spark, tx.display(t, 10), t="hello wide world") == "hello..."
    e = one(spark, tx.hash_embedding(t, 100), t="x")
    assert len(e) == 100 and e[0] == e[64]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, vx.cosine(a, b), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vx.cosine(a, b), a=[1.0, 0.0], b=[0.0, 0.0]) is None and one(spark, vx.cosine(a, b), a=[1.0], b=[1.0, 2.0]) is None
    with pytest.raises(Exception, match="no cosine"):
        one(spark, vx.cosine(a, b, strict=True), a=[1.0, 0.0], b=[0.0, 0.0])
    assert one(spark, vx.nearest_rank(a, 0.5), a=[4.0, 1.0, 3.0, 2.0]) == 3.0
    assert one(spark, vx.mean(F.array(a, b)), a=[1.0, 2.0], b=[3.0, 6.0]) == [2.0, 4.0]
    assert one(spark, vx.unpacked(vx.packed(a.cast("array<float>"))), a=[1.5, -2.0]) == [1.5, -2.0]


def test_quality(spark):
    t = F.col("t")
    assert one(spark, quality.readability(t), t="") == 0.0
    assert one(spark, quality.readability(t), t="One two. Three four.") == pytest.approx(1 - 2 / 50)
    assert one(spark, quality.structure(t), t="# T\n## S\n- a [x](y)\n```\n```") == 1.0
    found = one(spark, quality.lint(t), t="[[a](b\n##  \n" + "x" * 121)
    assert [(f["line"], f["severity"]) for f in found] == [(1, "error"), (2, "warning"), (3, "info")]
    assert one(spark, quality.looks_cut_off(t), t="It ends here.") is False and one(spark, quality.looks_cut_off(t), t="It goes on and") is True
    assert one(spark, quality.repeats_lines(t), t="a\nb\nb\nb\nc") is True and one(spark, quality.repeats_lines(t), t="b\nb\nb") is False
    assert one(spark, quality.code_quality(t), t="plain") == 0.7
    assert one(spark, quality.length_score(t, "summary"), t="x" * 100) == 0.5
    assert one(spark, quality.grade(F.col("n").cast("double") / 10), n=7) == "good"
    assert one(spark, quality.path_category(t), t="a/HowTo/b") == "how-to" and one(spark, quality.document_category(F.lit("z"), t), t="why so") == "explanation"


def test_changes(spark):
    t = F.col("t")
    assert one(spark, changes.language(changes.extension(t)), t="a/b.TS") == "typescript" and one(spark, changes.language(t), t="zig") == "unknown"
    assert one(spark, changes.ignored(t), t="a/node_modules/b.js") is True and one(spark, changes.ignored(t), t="src/a.py") is False
    assert one(spark, changes.severity(t, F.lit("modified"), F.lit(3)), t="a.txt") == "patch" and one(spark, changes.severity(t, F.lit("added"), F.lit(0)), t="a.txt") == "major"
    assert one(spark, changes.highest(F.array(F.lit("patch"), t)), t="minor") == "minor"
    files = F.array(F.struct(t.alias("path"), F.lit(1).alias("n")))
    assert one(spark, changes.affected_sections(files, F.array(F.lit("BREAKING"))), t="x/api/y") == ["api_reference", "migration_guide"]
    assert one(spark, changes.update_priority(files, F.array(F.lit("a"))), t="docs/x") == "medium"
    assert [changes.retry_delay_ms(k) for k in (0, 3, 9)] == [1000, 8000, 60_000]
    assert one(spark, changes.suspicious(t), t="a <SCRIPT>") is True and one(spark, changes.traverses(t), t="%2e%2e/") is True


CHUNKER = """
import resource, tempfile
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from quarry.functions import text as tx
home = tempfile.mkdtemp()
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", home).getOrCreate()
peak = lambda batches: (pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]}) for _ in batches)
before = spark.range(1).coalesce(1).mapInPandas(peak, "mb long").first()[0]
docs = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("Some words of a text. "), 300).alias("text"))
n = docs.select(F.explode(tx.context_chunks(F.col("text"), 1000, 50)).alias("piece")).count()
after = spark.range(1).coalesce(1).mapInPandas(peak, "mb long").first()[0]
print("RESULT", n, before, after, flush=True)
"""


def test_context_chunks_of_a_batch_are_not_held_at_once():
    """9000 texts of 6600 characters are one Arrow batch of 59 MB; its pieces as objects and again as Arrow would be several times that."""
    home = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", CHUNKER], capture_output=True, text=True, timeout=300, cwd=home, env=os.environ | {"PYTHONPATH": str(home), "SPARK_LOCAL_IP": "127.0.0.1"})
    n, before, after = map(int, done.stdout.split("RESULT")[1].split())
    assert n == 9000 * 7 and after - before < 140


def test_context_chunks_of_many_texts_come_in_their_order(spark):
    texts = [None, "", "a" * 2500, "x. " * 200_000, "One.\n\n" * 300, *("word " * k for k in range(400))]
    made = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", "text", tx.context_chunks(F.col("text"), 1000, 50).alias("pieces")).collect()
    assert len(made) == len(texts)
    for r in made:
        at = 0
        for p in r["pieces"]:
            assert 0 < len(p) <= 1000 and r["text"].startswith(p, at)
            at += max(len(p) - 50, 1)
        assert r["pieces"] == [] if not r["text"] else r["text"].endswith(r["pieces"][-1])
    assert [len(p) for p in made[2]["pieces"]] == [1000, 1000, 600]
