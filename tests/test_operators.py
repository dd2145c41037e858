"""Operators on hand-made rows, and properties that must hold of any."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.functions.vector import cosine
from quarry.operators import analytics, chunking, code, crossref, incremental, intents, keywords, monitoring, prompts, search
from quarry.sources import files

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    schema = "type string, query_id long, session_id string, user_id string, query string, query_type string, result_count long, execution_time_ms long, zero_results boolean, position long, time_to_click_ms long, duration_ms long, ts timestamp"
    return spark.createDataFrame(rows, schema)


def asked(i, text, n, session="s1", at=0):
    return ("query", i, session, "u1", text, "simple", n, 100, n == 0, None, None, None, T0 + timedelta(minutes=at))


def clicked(i, position, ms, at=0):
    return ("click", i, "s1", "u1", None, None, None, None, None, position, ms, None, T0 + timedelta(minutes=at))


def test_usage_and_quality(spark):
    e = events(spark, [asked(1, "a", 10), asked(2, "b", 15), asked(3, "c", 0), clicked(1, 0, 1000), clicked(2, 2, 2000)])
    u = analytics.usage(e).first()
    assert (u["total_queries"], u["unique_sessions"], u["zero_result_queries"], u["avg_results"]) == (3, 1, 1, pytest.approx(25 / 3))
    q = analytics.quality(e).first()
    assert (q["avg_click_position"], q["avg_time_to_click_ms"], q["click_through_rate"]) == (1.0, 1500.0, pytest.approx(2 / 3))
    assert analytics.usage(e.where("false")).first()["avg_results"] == 0.0


def test_popular_and_periods(spark):
    e = events(spark, [asked(1, "x", 10), asked(2, "x", 11), asked(3, "x", 12), asked(4, "y", 5, at=90), clicked(1, 0, 1)])
    top = analytics.popular(e).collect()
    assert (top[0]["query"], top[0]["count"], top[0]["avg_results"], top[0]["click_through_rate"]) == ("x", 3, 11.0, pytest.approx(1 / 3))
    assert analytics.within(e, "hour", F.lit(T0 + timedelta(minutes=90))).count() == 1


def test_relevance(spark):
    r = spark.range(1).select(analytics.relevance(F.lit(0.9), F.lit(0.5), F.lit(0.9)).alias("a"), analytics.relevance(F.lit(0.1), F.lit(9.0), F.lit(0.1)).alias("b")).first()
    assert r["a"] > 0.7 and r["b"] < 0.4


def reference_spans(cuts, n, low, high):
    """The stored treatment, step by step."""
    out, start = [], 0
    for b in cuts[1:]:
        if b - start < low:
            continue
        if b - start > high:
            while start < b:
                end = min(start + high, b)
                if end - start >= low:
                    out.append([start, end - 1, end - 1])
                start = end
        else:
            out.append([start, b - 1, b - 1])
        start = b
    if start < n:
        if n - start >= low:
            out.append([start, n - 1, n - 1])
        elif out:
            out[-1][1] = n - 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("mode", ["stored", "whole"])
def test_chunk_spans(spark, mode):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        n = rng.randint(0, 90)
        cuts = [0, *sorted(rng.sample(range(1, n), rng.randint(0, min(8, n - 1))))] if n > 1 else [0]
        rows.append((k, cuts, n))
    config = chunking.ChunkerConfig(max_chunk_sentences=20, mode=mode)
    made = spark.createDataFrame(rows, "k int, cuts array<int>, n int").select("k", chunking.spans(F.col("cuts"), F.col("n"), config).alias("s")).collect()
    for (_, cuts, n), r in zip(rows, sorted(made, key=lambda r: r["k"])):
        got = [tuple(x) for x in r["s"]]
        if mode == "stored":
            assert got == reference_spans(cuts, n, 3, 20)
        else:
            assert [i for a, b, _ in got for i in range(a, b + 1)] == list(range(n)) and all(b - a + 1 <= 22 for a, b, _ in got)


def test_chunks_cover_sentences(spark):
    text = " ".join(f"This is sentence number {i} of the text." for i in range(12))
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, "Short."), (3, None)], "doc_id int, text string"), chunking.ChunkerConfig(mode="whole"), size=16).orderBy("doc_id", "chunk_index").collect()
    assert " ".join(r["content"] for r in rows if r["doc_id"] == 1) == text and all(r["total_chunks"] == sum(x["doc_id"] == r["doc_id"] for x in rows) for r in rows)
    with pytest.raises(ValueError):
        chunking.ChunkerConfig(max_chunk_sentences=2)


def test_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "reference"), (2, [0.0, 1.0], "tutorial"), (3, [1.0, 1.0], "reference"), (4, [0.0, 0.0], "reference")], "id int, embedding array<float>, category string")
    got = [r["id"] for r in search.semantic_search(rows, [1.0, 0.0], ties=("id",)).collect()]
    assert got == [1, 3, 2] and got[:2] == [r["id"] for r in search.semantic_search(rows, [1.0, 0.0], search.SearchConfig(2), ties=("id",)).collect()]
    assert [r["id"] for r in search.semantic_search(rows, [1.0, 0.0], search.SearchConfig(category="tutorial")).collect()] == [2]
    for bad in (lambda: search.SearchConfig(0), lambda: search.SearchConfig(1, 2.0), lambda: search.Request(), lambda: search.BoolQuery(), lambda: search.MultiMatch("x", ("nope",)), lambda: search.Filters(("what",)), lambda: search.Options(101), lambda: search.MultiMatch("x", boosts={"title": -1})):
        with pytest.raises(search.QueryError):
            bad()


def test_pages(spark):
    docs = spark.createDataFrame([(i, f"red thing {i}", T0 + timedelta(hours=i)) for i in range(30)], "id int, content string, ts timestamp")
    page = search.Request("RED", options=search.Options(10, 20)).run(docs).collect()
    assert len(page) == 10 and page[0]["total"] == 30 and not page[0]["has_more"]
    seen, after = [], None
    while rows := search.keyset_page(docs, 7, after, "id", "ts").collect():
        seen += [r["id"] for r in rows]
        after = search.cursor(rows[-1]["id"], rows[-1]["ts"].isoformat(sep=" "))
    assert seen == list(range(29, -1, -1))
    with pytest.raises(search.QueryError):
        search.keyset_page(docs, 7, "%%%", "id", "ts")
    parts = search.batches(docs, 8, F.col("id")).groupBy("batch", "has_more").count().orderBy("batch").collect()
    assert [(r["batch"], r["has_more"], r["count"]) for r in parts] == [(0, True, 8), (1, True, 8), (2, True, 8), (3, False, 6)]


def test_evaluation(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, doc string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "a")], "query string, doc string")
    rows = {r["query"]: r for r in search.evaluated(results, relevant, 10).collect()}
    assert (rows["q"]["precision"], rows["q"]["recall"], rows["q"]["reciprocal_rank"], rows["r"]["results"]) == (0.5, 0.5, 0.5, 0)
    assert search.evaluation(search.evaluated(results, relevant, 10)).first()["zero_result_rate"] == 0.5


def test_incremental(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    existing = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, hash string")
    changes = incremental.compared(current, existing)
    assert {r["path"]: r["action"] for r in changes.collect()} == {"a": "add", "b": "skip", "c": "update", "d": "delete"}
    plan = incremental.planned(changes, incremental.LoadFlags(update=True, cleanup=True))
    after = incremental.applied(existing, plan, current)
    assert sorted(map(tuple, after.collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert incremental.planned(changes, incremental.LoadFlags(dry_run=True)).count() == 0 and incremental.counted(incremental.compared(current, after)).first()["skip"] == 3
    with pytest.raises(ValueError):
        incremental.LoadFlags(force=True, update=True)


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "the parser parser parser config.yaml async_runtime of tokenization-engine"), (2, "")], "id int, text string")
    row = keywords.keyword_lists(docs, "id", "text").first()
    assert row["descriptive"][0] == "parser" and "async_runtime" in row["technical"] and "the" not in row["descriptive"]
    done = {r["id"]: r["status"] for r in keywords.enriched(docs, "id", "text").collect()}
    assert done == {1: "enriched", 2: "skipped"}
    answer = spark.createDataFrame([('so: {"descriptive": ["A ", "a", "bb"], "technical": [], "confidence": 0.9} ok',), ("none",)], "t string").select(keywords.parsed_answer(F.col("t")).alias("x")).collect()
    assert answer[0]["x"]["descriptive"] == ["bb"] and answer[1]["x"] is None
    share = spark.range(20_000).where(keywords.in_rollout(F.col("id"), 30)).count() / 20_000
    assert abs(share - 0.3) < 0.02


def test_crossref_and_monitoring(spark):
    docs = spark.createDataFrame([("t", "tutorial", "t"), ("h", "how-to", "h"), ("r", "reference", "r")], "title string, category string, slug string")
    links = {(r["from_title"], r["to_title"]): r["relationship"] for r in crossref.cross_references(docs).collect()}
    assert links == {("t", "h"): "next_steps", ("t", "r"): "reference", ("h", "t"): "learn_more", ("h", "r"): "reference"}
    assert [r["category"] for r in crossref.missing_categories(docs).collect()] == ["explanation"]
    ops = spark.createDataFrame([(i > 19, True, False, float(i), T0, i) for i in range(200)], "ok boolean, cached boolean, fallback boolean, ms double, ts timestamp, k int")
    assert [(r["alert"], r["severity"]) for r in monitoring.alerts(monitoring.extraction(ops)).collect()] == [("error_rate", "critical")]
    assert monitoring.last_percentiles(ops, ["k"], window=100).first()["p50"] == 150.0
    jobs = spark.createDataFrame([(1, "queued", 1, T0), (2, "queued", 3, T0), (3, "queued", 3, T0 - timedelta(days=1))], "job_id int, status string, priority int, queued_at timestamp")
    assert [r["job_id"] for r in monitoring.queue(jobs).collect()] == [3, 2, 1]


def test_code(spark):
    sources = {
        "a.rs": "/// Adds.\n#[inline]\npub fn add(\n    a: Vec<(u8, u8)>,\n    b: &str,\n) -> Option<u8> {\n}\nstruct P { }\npub enum E {\n    A,\n    B(u8),\n}\nuse std::io;\nmod inner;\n",
        "b.py": 'import os\nasync def run(x, y=(1, 2)) -> int:\n    """Runs."""\nclass _Hidden:\n    pass\n', "c.go": "// Serve it\nfunc (s *S) Serve(a int, b string) error {\n}\ntype T struct {\n\tX int\n}\n",
        "d.js": "export class Service extends Base {}\nfunction go(a, b) {}\nconst f = (x) => x\n", "e.ts": "export interface I {\n  a: string;\n}\n", "F.java": "public class F {\n  private static int sum(int a, int b) { }\n}\n",
    }
    made = code.structure(spark.createDataFrame(list(sources.items()), "path string, text string"))
    got = {(r["path"], r["kind"], r["name"]): r for r in made.collect()}
    add = got["a.rs", "function", "add"]
    assert add["params"] == ["a: Vec<(u8, u8)>", "b: &str"] and add["returns"] == "Option<u8>" and add["documentation"] == "Adds." and add["visibility"] == "public"
    assert got["a.rs", "enum", "E"]["fields"] == ["A", "B(u8)"] and ("a.rs", "import", "std::io") in got
    assert got["b.py", "function", "run"]["documentation"] == "Runs." and got["b.py", "function", "run"]["params"] == ["x", "y=(1, 2)"] and got["b.py", "class", "_Hidden"]["visibility"] == "private"
    assert got["c.go", "function", "Serve"]["params"] == ["a int", "b string"] and ("d.js", "class", "Service") in got and ("e.ts", "interface", "I") in got and got["F.java", "function", "sum"]["params"] == ["int a", "int b"]
    assert code.public_functions(made).count() == 5 and code.coverage(made).first()["items"] > 0


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nText one. Text two.\n")
    (tmp_path / "sub" / "b.markdown").write_text("b")
    (tmp_path / "c.txt").write_text("c")
    assert files.markdown(spark, str(tmp_path)).count() == 2 and files.hashed_files(spark, str(tmp_path)).count() == 3
    assert files.directory_size(files.hashed_files(spark, str(tmp_path))).first()["files"] == 3
    assert files.rendered(spark.createDataFrame([(1, "x")], "a int, b string"), "table").splitlines()[1].split() == ["1", "x"]
    with pytest.raises(Exception):
        files.hashed_files(spark, str(tmp_path / "none")).count()
    pushes = spark.createDataFrame([('{"type": "push", "repository": "r", "ref": "refs/heads/main", "before": "1", "after": "2"}',), ('{"type": "tag"}',)], "value string")
    assert [tuple(r) for r in files.push_events(pushes).collect()] == [("r", "main", "1", "2")]


def test_intents(spark):
    answers = {
        "Intent: tutorial\nConfidence: 0.85\nReasoning: Step-by-step guide": ("tutorial", 0.85, "Step-by-step guide", None), "Intent: HowTo\nConfidence: 0.9\nReasoning: Task-oriented": ("howto", 0.9, "Task-oriented", None),
        "This query is clearly a tutorial about learning": ("tutorial", 0.7, "This query is clearly a tutorial about learning", None), "Intent: poem\nConfidence: 0.9": (None, 0.9, "Intent: poem\nConfidence: 0.9", "invalid_intent"),
        "no idea": (None, 0.7, "no idea", "parse_error"), "Intent: api\nConfidence: 7\nReasoning: x": ("reference", 1.0, "x", None), "Intent: concept\nConfidence: 0.5\nReasoning: y": ("explanation", 0.5, "y", "low_confidence"),
    }
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select("a", intents.parsed(F.col("a")).alias("p")).collect()
    assert {r["a"]: (r["p"]["intent"], r["p"]["confidence"], r["p"]["reasoning"], r["p"]["error"]) for r in rows} == answers
    two = "Intent: tutorial\nConfidence: 0.9\nReasoning: z\nSecondary: howto:0.7, reference:0.3, nonsense:0.9, guide:1:2"
    multi = spark.createDataFrame([(two,)], "a string").select(intents.parsed(F.col("a"), multi=True).alias("p")).first()["p"]
    assert [(x["intent"], x["confidence"]) for x in multi["secondary"]] == [("howto", 0.7)]
    asked = []
    questions = spark.createDataFrame([(1, "How to install?"), (2, " how TO  install? "), (3, " "), (4, None), (5, "fails")], "id int, text string")

    def model(texts):
        return ["Intent: howto\nConfidence: 0.9\nReasoning: r" if "install" in t else "?" for t in texts]

    made = {r["id"]: (r["intent"], r["error"]) for r in intents.classified(questions, model=model).collect()}
    assert made == {1: ("howto", None), 2: ("howto", None), 3: (None, "empty_query"), 4: (None, "empty_query"), 5: (None, "parse_error")} and not asked
    assert sorted(r["id"] for r in intents.sure(intents.classified(questions, model=model)).collect()) == [1, 2]


def test_prompts(spark):
    parts = spark.createDataFrame([("p", "a", 1, 0, "x" * 400, True), ("p", "b", 9, 1, "One two. " * 200, True), ("p", "c", 5, 2, "y" * 100, False), ("q", "a", 1, 0, "short", True), ("q", "b", 2, 1, "also short", True)], "prompt string, name string, priority int, k int, text string, may boolean")
    b = {r["prompt"]: r for r in prompts.budgets(parts, "prompt", "name", most=700, reserved=100).collect()}
    assert (b["p"]["used"], b["p"]["remaining"], b["p"]["within_limit"], b["q"]["within_limit"]) == (130 + 585 + 33, 0, False, True)
    fit = prompts.fitted(parts, "prompt", "priority", "k", may_cut="may", most=700, reserved=100).orderBy("prompt", "place").collect()
    assert [(r["prompt"], r["k"], r["cut"]) for r in fit] == [("p", 1, False), ("q", 0, False), ("q", 1, False)]  # c fits no more than 15 tokens and may not be cut
    fit = prompts.fitted(parts, "prompt", "priority", "k", most=400, reserved=100).where("prompt = 'p'").collect()
    assert [(r["k"], r["cut"]) for r in fit] == [(1, True)] and fit[0]["text"].endswith("two.") and 0 < len(fit[0]["text"]) <= 300 * 4 / 1.3
    whole = prompts.assembled(prompts.fitted(parts.where("prompt = 'q'"), "prompt", "priority", "k"), "prompt").collect()
    assert [tuple(r) for r in whole] == [("q", "short\n\nalso short")]


def test_extraction_driver(spark):
    long = "the parser reads config.yaml and the parser writes tokens to the parser output again"
    docs = spark.createDataFrame([(1, long), (2, long), (3, "tiny parser"), (4, "  "), (5, "fail " + long)], "id int, text string")

    def model(texts):
        if any(t.startswith("fail") for t in texts):
            raise RuntimeError("down")
        return ['{"descriptive": ["Alpha"], "technical": [], "confidence": 0.9}' for _ in texts]

    by = lambda rows: {r["id"]: (r["method"], r["error"]) for r in rows.collect()}
    spread = docs.where("id <> 5")
    assert by(keywords.extracted(spread, "id", "text", model, wait=0)) == {1: ("model", None), 2: ("model", None), 3: ("frequency", None), 4: (None, "empty content")}
    assert by(keywords.extracted(docs.where("id = 5"), "id", "text", model, wait=0)) == {5: ("frequency", None)}
    assert by(keywords.extracted(docs.where("id = 5"), "id", "text", model, fallback=False, wait=0)) == {5: (None, "the model gave no keywords")}
    assert by(keywords.extracted(spread, "id", "text", model, percent=0, wait=0))[1] == ("frequency", None)
    body = '{"response": "a", "done": false}\n{"response": "b"}\n\n{"response": "c", "done": true}\n{"response": "x"}'
    assert spark.createDataFrame([(body,)], "b string").select(keywords.streamed_answer(F.col("b")).alias("x")).first()["x"] == "abc"


def test_embedding_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, text string").coalesce(1)
    assert chunking.embedded(rows, "text", lambda ts: [[1.0, 2.0] for _ in ts]).count() == 2
    with pytest.raises(Exception, match="components"):
        chunking.embedded(rows, "text", lambda ts: [[1.0] * len(t) for t in ts]).collect()
    with pytest.raises(Exception, match="blank"):
        chunking.embedded(spark.createDataFrame([(1, " ")], "id int, text string"), "text", lambda ts: [[1.0] for _ in ts]).collect()


def test_batch_search_in_blocks(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)], "id int, embedding array<double>")
    asked = rows.where("id < 20").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    one, many = (sorted(map(tuple, search.batch_search(rows, asked, 3, "id", block=b).collect())) for b in (100, 3))
    assert one == many and len(one) == 60


def test_batch_search_of_odd_vectors_and_copies(spark, monkeypatch):
    """Blocks of products, not pairs; equal vectors tie in the order of their ids, whatever block they are in; odd ones are as in the definition."""
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(9)]
    odd = [None, [], [0.0] * 7, [None] * 7, [1.0, 2.0], [float("nan")] * 7, [float("inf")] + [1.0] * 6, [1e-200] * 7, [1e200] * 7, [1e-90] + [0.0] * 6]
    rows = [(f"k{rng.randrange(10**6)}-{k}", v) for k, v in enumerate([x for x in base for _ in range(40)] + odd * 2 + [[3.0 * y for y in x] for x in base])]
    made = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, v) for k, v in enumerate(base + odd)], "query_id int, query array<double>")
    pairs = made.crossJoin(asked).select("query_id", "id", cosine(F.col("embedding"), F.col("query")).alias("s")).where("s is not null").collect()
    want = sorted((q, i, s, r) for q in range(len(base + odd)) for r, (s, i) in enumerate(sorted(((p["s"], p["id"]) for p in pairs if p["query_id"] == q), key=lambda x: (-x[0], x[1]))[:6], 1))
    for block, size in ((100, 4096), (4, 100)):
        monkeypatch.setattr(search, "VECTORS", size)
        found = search.batch_search(made, asked, 6, "id", block=block)
        assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "BroadcastHashJoin" not in plan
        assert sorted(map(tuple, found.select("query_id", "id", "similarity", "rank").collect())) == want
    assert len(want) > 60


def test_links_as_groups_are_all_links(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(f"t{rng.randrange(25)}", rng.choice(["tutorial", "how-to", "reference", "explanation", "none"]), f"s{k}") for k in range(60)], "title string, category string, slug string")
    pairs = crossref.cross_references(docs).groupBy("from_title", "from_category", "to_category", "relationship").count()
    groups = crossref.link_groups(docs).selectExpr("from_title", "from_category", "to_category", "relationship", "rows * targets as count")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, groups.collect()))


def test_saved_searches_and_long_code(spark):
    kept = search.SavedSearch("u", "mine", search.Request("red"))
    assert kept.updated(name="yours").name == "yours"
    for bad in (lambda: kept.updated(name=" "), lambda: search.SavedSearch("", "x", search.Request("red")), lambda: search.SavedSearch("u", "x", search.Request())):
        with pytest.raises(search.QueryError):
            bad()
    args = ",\n".join(f"    a{k}: int" for k in range(200))
    note = "\n".join(f"    line {k}" for k in range(100))
    made = code.structure(spark.createDataFrame([("a.py", f'def f(\n{args}\n) -> int:\n    """{note}"""\n    pass\n')], "path string, text string")).first()
    assert len(made["params"]) == 200 and made["returns"] == "int" and made["documentation"].endswith("line 99")
    items = code.structure(spark.createDataFrame([("a.py", "def f():\n    pass\n")], "path string, text string"))
    assert code.merged(items, items).count() == 1
    assert code.documentation_coverage(items, spark.createDataFrame([("x.toml",)], "path string")).first()["coverage"] == 0.0
    sources = spark.createDataFrame([("a.ts",), ("b.tsx",), ("c.rs",)], "path string")
    assert files.source_files(sources, "typescript").count() == 2 and files.source_files(sources, "zig").count() == 3


def test_labels_are_relevant_without_pairs(spark):
    """Counts of labels give what all pairs of one label give."""
    rng = random.Random(6)
    labels = [(k, rng.choice(["a", "a", "a", "b", "c"])) for k in range(40)] + [(40, "alone")]
    results = [(q, d, r + 1) for q in range(0, 41, 5) for r, d in enumerate(rng.sample([k for k in range(41) if k != q], 12))]
    of = dict(labels)
    pairs = [(q, d) for q in {r[0] for r in results} for d, _ in labels if of[d] == of[q] and d != q]
    found, held = spark.createDataFrame(results, "query int, doc int, rank int"), spark.createDataFrame(labels, "doc int, label string")
    by_pairs = search.evaluated(found, spark.createDataFrame(pairs, "query int, doc int"), 10)
    by_label = search.evaluated_by_label(found, held, 10)
    assert sorted(map(tuple, by_label.collect())) == sorted(map(tuple, by_pairs.select(*by_label.columns).collect()))


def test_summary_of_sections(spark):
    from quarry.functions import text as tx

    long = "A first sentence. " * 40
    text = f"# Goal\nShort.\n## Steps\n{long}\n### End\nno stop " + "x" * 600
    made = spark.createDataFrame([(text,), ("plain text",)], "t string").select(tx.context_summary(F.col("t"), ["Goal", "Steps", "End", "None"])).collect()
    cut = long[:500].rpartition(".")[0] + "."
    assert made[0][0] == f"## Goal\n\nShort.\n\n## Steps\n\n{cut}\n\n## End\n\n{('no stop ' + 'x' * 600)[:500]}\n\n" and made[1][0] == "plain text"
