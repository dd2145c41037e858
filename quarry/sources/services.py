"""Remote services as Spark sources: texts and embeddings by request, and event feeds by offset.

    register(spark)
    spark.read.format("text_service").option("url", url).option("prompts", folder).load()
    spark.readStream.format("event_feed").option("url", url).load()

Every partition asks for its own part, tries again by itself with growing waits, and
fails its task after that, which Spark then repeats; what other partitions have is kept.
A feed is read by ranges of offsets, so that a range that is read again gives the same rows.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

WAIT_MOST = 60.0


class ServiceError(RuntimeError):
    """A service that gave no usable answer to any try."""


def called(url: str, body: dict | None, tries: int, wait: float, timeout: float) -> bytes:
    """The answer of a request (POST with a body, else GET). Refusals of the request itself (4xx but 408 and 429) are not tried again."""
    last = ""
    for k in range(tries):
        if k:
            time.sleep(min(wait * 2 ** (k - 1), WAIT_MOST))
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(url, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            last = f"{e.code} {e.reason}"
            if 400 <= e.code < 500 and e.code not in (408, 429):
                break
        except (OSError, TimeoutError) as e:
            last = str(e)
    raise ServiceError(f"{url}: {last}")


def answer_text(body: bytes) -> str:
    """``response`` of the JSON lines in order, up to the one that says ``done``; a body that ends before it is cut off."""
    out = []
    for line in body.decode().split("\n"):
        if line.strip():
            part = json.loads(line)
            out.append(part.get("response") or "")
            if part.get("done"):
                return "".join(out)
    raise ServiceError("the answer ends before it is done")


class Settings:
    """Options that the services share."""

    def __init__(self, options: dict):
        self.url = options.get("url", "").rstrip("/")
        if not self.url:
            raise ValueError("option url is missing")
        self.model = options.get("model", "")
        self.tries, self.wait, self.timeout = int(options.get("tries", 3)), float(options.get("wait", 1.0)), float(options.get("timeout", 60.0))
        if self.tries < 1 or self.wait < 0 or self.timeout <= 0:
            raise ValueError("tries must be 1 at least, wait not negative, timeout positive")


class Part(InputPartition):
    """A range of rows of a fragment (a row group's file) of the prompts."""

    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


class PromptReader(DataSourceReader):
    """One row for each prompt of a Parquet folder that all executors see; ``rows`` prompts a partition."""

    def __init__(self, options: dict):
        self.settings = Settings(options)
        self.folder, self.id, self.prompt = options.get("prompts", ""), options.get("id", "id"), options.get("prompt", "prompt")
        self.rows = int(options.get("rows", 64))
        if not self.folder or self.rows < 1:
            raise ValueError("option prompts is missing, or rows below 1")

    def partitions(self) -> list[Part]:
        out = []
        for f in ds.dataset(self.folder, format="parquet").get_fragments():
            n = f.count_rows()
            out += [Part(f.path, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def asked(self, part: Part) -> Iterator[tuple]:
        table = ds.dataset(part.file, format="parquet").scanner(columns=[self.id, self.prompt])
        seen = 0
        for batch in table.to_batches():
            a, b = max(part.start - seen, 0), min(part.stop - seen, batch.num_rows)
            if a < b:
                yield from zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns))
            seen += batch.num_rows

    def read(self, partition: Part) -> Iterator[tuple]:
        s = self.settings
        for key, prompt in self.asked(partition):
            if prompt is None or not prompt.strip():
                yield str(key), None
            else:
                yield str(key), self.answer(s, prompt)

    def answer(self, s: Settings, prompt: str):
        return answer_text(called(f"{s.url}/api/generate", {"model": s.model, "prompt": prompt, "stream": True}, s.tries, s.wait, s.timeout))


class EmbeddingReader(PromptReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.size = int(options.get("size", 0))
        if self.size < 1:
            raise ValueError("option size, of the vectors, is missing")  # so that no two tasks give two lengths

    def answer(self, s: Settings, prompt: str) -> list[float]:
        vector = json.loads(called(f"{s.url}/api/embeddings", {"model": s.model, "prompt": prompt}, s.tries, s.wait, s.timeout)).get("embedding") or []
        if len(vector) != self.size:
            raise ServiceError(f"a vector has {len(vector)} components, {self.size} expected")
        return [float(x) for x in vector]


class TextService(DataSource):
    """(id, response) for the prompts of a folder; blank prompts have no response."""

    @classmethod
    def name(cls) -> str:
        return "text_service"

    def schema(self) -> str:
        return "id string, response string"

    def reader(self, schema) -> DataSourceReader:
        return PromptReader(dict(self.options))


class EmbeddingService(DataSource):
    """(id, embedding) for the texts of a folder."""

    @classmethod
    def name(cls) -> str:
        return "embedding_service"

    def schema(self) -> str:
        return "id string, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return EmbeddingReader(dict(self.options))


class Span(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class FeedReader(DataSourceStreamReader):
    """Rows of offsets [start, stop): ``GET url/events?after=..&limit=..`` gives JSON lines with offset and body, ``GET url/latest`` the next offset."""

    def __init__(self, options: dict):
        self.settings, self.rows = Settings(options), int(options.get("rows", 1000))
        self.first = int(options.get("start", 0))

    def _get(self, path: str) -> bytes:
        s = self.settings
        return called(f"{s.url}/{path}", None, s.tries, s.wait, s.timeout)

    def initialOffset(self) -> dict:
        return {"offset": self.first}

    def latestOffset(self) -> dict:
        return {"offset": max(self.first, int(json.loads(self._get("latest"))["offset"]))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        a, b = start["offset"], end["offset"]
        return [Span(k, min(k + self.rows, b)) for k in range(a, b, self.rows)]

    def read(self, partition: Span) -> Iterator[tuple]:
        at = partition.start
        while at < partition.stop:
            body = self._get("events?" + urllib.parse.urlencode({"after": at, "limit": partition.stop - at}))
            rows = [json.loads(line) for line in body.decode().split("\n") if line.strip()]
            for r in rows:
                if not at <= r["offset"] < partition.stop:
                    raise ServiceError(f"offset {r['offset']} is none of [{at}, {partition.stop})")
                at = r["offset"] + 1
                yield r["offset"], json.dumps(r.get("body"), sort_keys=True)
            if not rows:
                raise ServiceError(f"offsets [{at}, {partition.stop}) are missing")  # or they would never be read

    def commit(self, end: dict) -> None:
        pass


class EventFeed(DataSource):
    """(offset, body) of a feed; body is JSON."""

    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return "offset long, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the services known to the session, as formats and, for analyzers, as table functions in SQL."""
    from quarry.operators.code import code_items
    from quarry.session import ship

    ship(spark)
    for source in (TextService, EmbeddingService, EventFeed):
        spark.dataSource.register(source)
    spark.udtf.register("code_items", code_items())
