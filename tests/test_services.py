"""Services as Spark sources, against a stub on this machine that fails at times."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.operators import code
from quarry.sources import services


class Stub(BaseHTTPRequestHandler):
    calls: Counter = Counter()
    lock = threading.Lock()
    feed = 0

    def log_message(self, *a):
        pass

    def seen(self, key):
        with self.lock:
            self.calls[key] += 1
            return self.calls[key]

    def reply(self, body, status=200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        p = asked["prompt"]
        n = self.seen((self.path, p))
        if "flaky" in p and n < 3 or "down" in p:
            return self.reply(b"busy", 503)
        if "refused" in p:
            return self.reply(b"no", 400)
        if self.path == "/api/embeddings":
            return self.reply(json.dumps({"embedding": [float(len(p))] * (3 if "short" in p else 4)}).encode())
        lines = [{"response": c} for c in p.upper()] + ([] if "cut" in p else [{"response": "!", "done": True}, {"response": "after"}])
        self.reply("\n".join(map(json.dumps, lines)).encode() + b"\n\n")

    def do_GET(self):
        if self.path == "/latest":
            return self.reply(json.dumps({"offset": Stub.feed}).encode())
        args = dict(x.split("=") for x in self.path.split("?")[1].split("&"))
        a, n = int(args["after"]), int(args["limit"])
        if self.seen(("feed", a)) == 1 and a % 4 == 0:
            return self.reply(b"", 500)
        rows = [{"offset": k, "body": {"n": k}} for k in range(a, min(a + min(n, 2), Stub.feed))]  # fewer than asked for
        self.reply("\n".join(map(json.dumps, rows)).encode())


@pytest.fixture(scope="module")
def url(spark):
    services.register(spark)
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def asked(spark, url, tmp_path, rows, source="text_service", **options):
    folder = str(tmp_path / "prompts")
    spark.createDataFrame(rows, "key long, text string").repartition(3).write.parquet(folder)
    reader = spark.read.format(source).option("url", url).option("prompts", folder).option("id", "key").option("prompt", "text").option("wait", "0.01").option("rows", "2")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_texts_are_asked_in_parts_and_again(spark, url, tmp_path):
    rows = [(k, f"text {k}") for k in range(9)] + [(20, "flaky one"), (21, None), (22, "  "), (23, "grüße")]
    made = asked(spark, url, tmp_path, rows)
    assert made.rdd.getNumPartitions() >= 5
    want = {str(k): None if not (t or "").strip() else t.upper() + "!" for k, t in rows}
    assert {r["id"]: r["response"] for r in made.collect()} == want
    assert Stub.calls[("/api/generate", "flaky one")] == 3


@pytest.mark.parametrize("text, calls", [("down", 3), ("refused", 1), ("cut", 1)])
def test_what_cannot_be_answered_fails_the_job(spark, url, tmp_path, text, calls):
    Stub.calls.clear()
    with pytest.raises(Exception, match="ServiceError"):
        asked(spark, url, tmp_path, [(1, text)]).collect()
    assert Stub.calls[("/api/generate", text)] % calls == 0 and Stub.calls[("/api/generate", text)] >= calls


def test_embeddings_have_one_length(spark, url, tmp_path):
    made = asked(spark, url, tmp_path, [(1, "ab"), (2, "abc")], "embedding_service", size="4")
    assert {r["id"]: r["embedding"] for r in made.collect()} == {"1": [2.0] * 4, "2": [3.0] * 4}
    with pytest.raises(Exception, match="3 components"):
        asked(spark, url, tmp_path / "b", [(1, "short")], "embedding_service", size="4").collect()
    with pytest.raises(Exception, match="size"):
        asked(spark, url, tmp_path / "c", [(1, "ab")], "embedding_service").collect()


def test_a_feed_goes_on_where_it_was(spark, url, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        feed = spark.readStream.format("event_feed").option("url", url).option("rows", "3").option("wait", "0.01").load()
        feed.select("offset", F.get_json_object("body", "$.n").cast("long").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    Stub.feed = 8
    assert run() == [(k, k) for k in range(8)]
    Stub.feed = 13
    assert run() == [(k, k) for k in range(13)] == run()


def test_analyzers_in_sql(spark, url):
    spark.createDataFrame([("a.py", "def one(x):\n    pass\n\nclass Two:\n    pass\n"), ("b.txt", "def no(): pass"), ("c.py", None)], "path string, text string").createOrReplaceTempView("files_of_test")
    made = spark.sql("SELECT path, kind, name FROM files_of_test, LATERAL code_items(text, CASE WHEN path LIKE '%.py' THEN 'python' END)").collect()
    want = code.structure(spark.table("files_of_test")).select("path", "kind", "name").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, want)) and ("a.py", "function", "one") in map(tuple, made)
