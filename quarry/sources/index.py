"""An inverted index of documents as a table: term -> blocks of the ids that hold it.

A commit of documents makes one segment. Its postings lie in folders by a hash of
the term, sorted by term, so that a lookup lists the folders of its terms alone and
skips all row groups but theirs. A posting block covers one range of ids: the first
id, ascending distances from it (which Parquet packs as differences), how often
the term stands in each document, and how long each is. So a term that fills the
corpus is many rows of bounded size, and blocks of several terms meet by range,
not by posting.

A document that comes again, or goes, is dead in all earlier segments. Commits
write the ids that they end beside their segment, and lookups take them out of
older segments; a merge writes what is alive into one segment. Segments and the
numbers that ranking needs are entries of a log, so that several writers may
add documents at once, and readers see one state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions.text import tokens
from quarry.operators.chunking import runs_of
from quarry.sources.log import Log

RANGE = 1 << 16  #: ids of a block
SENT = 100_000  #: dead ids that are sent to every task; more are joined by an exchange
POSTINGS = "term string, range long, first long, docs array<int>, counts array<int>, sizes array<int>, n int"
LIVE = "doc long, size int"
EACH = "doc long, size int, term string, count int"


@dataclass(frozen=True)
class Ranking:
    """How the score of a term grows with its count, and falls with the length of the document (Okapi BM25)."""

    k: float = 1.2
    b: float = 0.75


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, size, term, count) of rows (doc, size, terms)."""
    for batch in batches:
        lists = batch.column(2)
        words, row = pc.list_flatten(lists).dictionary_encode(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        n = max(len(words.dictionary), 1)
        pair, count = np.unique(row * n + words.indices.to_numpy(), return_counts=True)
        at = pa.array(pair // n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.dictionary.take(pa.array(pair % n)), pa.array(count.astype(np.int32))], ["doc", "size", "term", "count"])


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks of sorted rows (term, range, doc, count, size, bucket, first); a block is at most RANGE rows."""
    for rows, starts in runs_of(batches, 2):
        at, first = pa.array(starts), rows.column(6).to_numpy()
        ends = pa.array(np.r_[starts, rows.num_rows].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, c) for c in (pa.array((rows.column(2).to_numpy() - first).astype(np.int32)), rows.column(3), rows.column(4))]
        made = [rows.column(0).take(at), rows.column(1).take(at), pa.array(first[starts]), *lists, pa.array(np.diff(np.r_[starts, rows.num_rows]).astype(np.int32)), rows.column(5).take(at)]
        yield pa.RecordBatch.from_arrays(made, ["term", "range", "first", "docs", "counts", "sizes", "n", "bucket"])


class TextIndex(Log):
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path)
        self.buckets = buckets

    def empty(self) -> dict:
        return {"version": 0, "buckets": self.buckets, "segments": [], "documents": 0, "length": 0}

    # -- writing -------------------------------------------------------------

    def put(self, docs: DataFrame, id_column: str = "doc_id", terms: Column | None = None, text: str = "text", removed: DataFrame | None = None) -> int:
        """Indexes documents in place of those with their ids, and takes out the ids of ``removed``; the new version.

        terms: an array of each document's terms, by default the words of its text;
        a column of keywords makes an index of keywords. Ids are whole numbers;
        rows without one are left out, and of rows that repeat an id the one with
        most terms counts, of equal ones the one whose terms come first. A document
        without terms is indexed as an empty one.
        """
        listed = F.filter(F.coalesce(tokens(F.col(text)) if terms is None else terms, F.array().cast("array<string>")), lambda t: t.isNotNull())
        rows = docs.select(docs[id_column].cast("long").alias("doc"), listed.alias("terms")).where("doc is not null")
        fresh = rows.groupBy("doc").agg(F.max(F.struct(F.size("terms").alias("size"), "terms")).alias("most")).select("doc", "most.size", "most.terms")
        known = self.manifest()
        folder = f"v-{uuid.uuid4().hex}"
        self._lay(fresh.mapInArrow(counted, EACH), f"{self.path}/{folder}/postings", known["buckets"])
        # the size of the row that counts is the largest, for which no terms are exchanged
        rows.groupBy("doc").agg(F.max(F.size("terms")).alias("size")).sort("doc").write.parquet(f"{self.path}/{folder}/live")
        live = self._live(folder)
        gone = live.select("doc")
        gone = (gone if removed is None else gone.unionByName(removed.select(removed[id_column].cast("long").alias("doc")).where("doc is not null"))).distinct()
        gone.sort("doc").write.parquet(f"{self.path}/{folder}/gone")
        n, length = live.agg(F.count("doc"), F.coalesce(F.sum("size"), F.lit(0))).first()
        dead = self._gone(folder)
        n_dead = dead.count()
        while True:
            head = self.manifest()
            # what this commit ends of what is alive now
            ended = self._alive(head).join(F.broadcast(dead) if n_dead <= SENT else dead, "doc", "left_semi").agg(F.count("doc"), F.coalesce(F.sum("size"), F.lit(0))).first()
            segment = {"folder": folder, "ends": n_dead, "documents": n}
            state = {"version": head["version"] + 1, "buckets": head["buckets"], "segments": [*head["segments"], segment], "documents": head["documents"] + n - ended[0], "length": head["length"] + length - ended[1]}
            if self.add(state, folder):
                return state["version"]

    def remove(self, ids: DataFrame, id_column: str = "doc_id") -> int:
        """Takes documents out; the new version."""
        none = self.spark.createDataFrame([], f"{id_column} long, terms array<string>")
        return self.put(none, id_column, F.col("terms"), removed=ids)

    def merge(self) -> int:
        """Writes the living postings of all segments into one; the new version. Documents that others add meanwhile stay beside it."""
        base = self.manifest()
        if len(base["segments"]) < 2:
            return base["version"]
        folder = f"v-{uuid.uuid4().hex}"
        self._lay(self._each(base, None).select("doc", "size", "term", "count"), f"{self.path}/{folder}/postings", base["buckets"])
        self._alive(base).sort("doc").write.parquet(f"{self.path}/{folder}/live")
        self._live(folder).select("doc").limit(0).write.parquet(f"{self.path}/{folder}/gone")
        n = self._live(folder).count()
        while True:
            head = self.manifest()
            old = len(base["segments"])
            if [s["folder"] for s in head["segments"][:old]] != [s["folder"] for s in base["segments"]]:
                self.discard(f"{self.path}/{folder}")  # another merge was first
                return head["version"]
            state = head | {"version": head["version"] + 1, "segments": [{"folder": folder, "ends": 0, "documents": n}, *head["segments"][old:]]}
            if self.add(state, folder):
                return state["version"]

    def vacuum(self) -> int:
        """Deletes segments that the newest version doesn't name; only while nothing writes or reads an older state. Returns how many."""
        used = {s["folder"] for s in self.manifest()["segments"]}
        old = [n for n in self._names(self.path) if n.startswith("v-") and n not in used]
        for n in old:
            self.discard(f"{self.path}/{n}")
        self.forget(self.versions()[:-1])
        return len(old)

    def _lay(self, each: DataFrame, path: str, buckets: int) -> None:
        """Writes (doc, size, term, count) rows as posting blocks in buckets of their term."""
        ranged = each.select("term", F.floor(F.col("doc") / RANGE).cast("long").alias("range"), "doc", "count", "size", self._bucket(F.col("term"), buckets).alias("bucket"))
        ranged = ranged.withColumn("first", F.col("range") * RANGE)
        # a bucket is several tasks with a file each, which a frequent term's blocks are dealt to
        pieces = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
        dealt = ranged.withColumn("_piece", F.pmod(F.xxhash64("range", "term"), F.lit(pieces))).repartition(buckets * pieces, "bucket", "_piece").drop("_piece")
        laid = dealt.sortWithinPartitions("bucket", "term", "range", "doc").mapInArrow(blocked, f"{POSTINGS}, bucket int")
        laid.write.partitionBy("bucket").option("parquet.writer.version", "PARQUET_2_0").option("parquet.bloom.filter.enabled#term", "true").parquet(path)

    # -- reading -------------------------------------------------------------

    def _bucket(self, term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def _live(self, folder: str) -> DataFrame:
        return self.spark.read.schema(LIVE).parquet(f"{self.path}/{folder}/live")

    def _gone(self, folder: str) -> DataFrame:
        return self.spark.read.schema("doc long").parquet(f"{self.path}/{folder}/gone")

    def _ended(self, state: dict) -> DataFrame | None:
        """(doc, by): the last segment that ends a document; None if no segment ends any of an earlier one."""
        parts = [self._gone(s["folder"]).withColumn("by", F.lit(k)) for k, s in enumerate(state["segments"]) if s["ends"] and k]
        if not parts:
            return None
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        made = all_.groupBy("doc").agg(F.max("by").alias("by"))
        return F.broadcast(made) if sum(s["ends"] for s in state["segments"][1:]) <= SENT else made

    def _living(self, rows: DataFrame, state: dict) -> DataFrame:
        """``rows`` (doc, seg, ...) of documents that no later segment ends."""
        ended = self._ended(state)
        return rows if ended is None else rows.alias("r").join(ended.alias("e"), (F.col("r.doc") == F.col("e.doc")) & (F.col("e.by") > F.col("r.seg")), "left_anti")

    def _alive(self, state: dict) -> DataFrame:
        """(doc, size) of the documents of a state."""
        parts = [self._live(s["folder"]).withColumn("seg", F.lit(k)) for k, s in enumerate(state["segments"])]
        all_ = self.spark.createDataFrame([], f"{LIVE}, seg int")
        for p in parts:
            all_ = all_.unionByName(p)
        return self._living(all_, state).select("doc", "size")

    def _blocks(self, state: dict, terms: list[str] | None) -> DataFrame:
        """Posting blocks with their segment; of some terms only their buckets are listed and their rows read."""
        wanted = None
        if terms is not None:
            made = self.spark.range(1).select(*[self._bucket(F.lit(t), state["buckets"]) for t in terms]).first() if terms else []
            wanted = sorted(set(made))
        all_ = self.spark.createDataFrame([], f"{POSTINGS}, seg int")
        for k, s in enumerate(state["segments"]):
            home = f"{self.path}/{s['folder']}/postings"
            held = {n for n in self._names(home) if n.startswith("bucket=")}
            paths = [f"{home}/{n}" for n in sorted(held)] if wanted is None else [f"{home}/bucket={b}" for b in wanted if f"bucket={b}" in held]
            if paths:
                rows = self.spark.read.schema(POSTINGS).parquet(*paths)
                all_ = all_.unionByName((rows if terms is None else rows.where(F.col("term").isin(*terms))).withColumn("seg", F.lit(k)))
        return all_

    def _each(self, state: dict, terms: list[str] | None) -> DataFrame:
        """(doc, size, term, count) of living documents, a row per posting."""
        posted = F.explode(F.arrays_zip("docs", "counts", "sizes")).alias("p")
        rows = self._blocks(state, terms).select("term", "seg", "first", posted)
        rows = rows.select((F.col("first") + F.col("p.docs")).alias("doc"), "seg", "term", F.col("p.counts").alias("count"), F.col("p.sizes").alias("size"))
        return self._living(rows, state)

    def terms(self, prefix: str | None = None) -> DataFrame:
        """(term, documents, occurrences) of the living documents."""
        state = self.manifest()
        rows = self._each(state, None)
        rows = rows if prefix is None else rows.where(F.col("term").startswith(prefix))
        return rows.groupBy("term").agg(F.count("doc").alias("documents"), F.sum("count").alias("occurrences"))

    def holding(self, terms: list[str], any_of: bool = False, version: int | None = None) -> DataFrame:
        """(doc) of the documents that hold all terms, or any of them.

        Blocks of one segment and range meet; the smallest list is looked up in the
        others, so that the work is by ranges that hold all terms. No terms: no rows.
        """
        state, asked = self.manifest(version), list(dict.fromkeys(terms))
        blocks = self._blocks(state, asked)
        met = blocks.groupBy("seg", "range", "first").agg(F.array_sort(F.collect_list(F.struct("n", "docs"))).alias("lists"))
        lists = F.transform("lists", lambda x: x["docs"])
        if any_of:
            docs = F.array_distinct(F.flatten(lists))
        else:
            met = met.where(F.size("lists") == len(asked))
            docs = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(1))), F.element_at(lists, 1), F.array_intersect)
        found = met.select("seg", "first", F.explode(docs).alias("o")).select("seg", (F.col("first") + F.col("o")).alias("doc"))
        return self._living(found, state).select("doc")

    def ranked(self, terms: list[str], k: int = 10, ranking: Ranking = Ranking(), every: bool = False, version: int | None = None) -> DataFrame:
        """(doc, score, rank): the ``k`` best documents that hold any of the terms (all, with ``every``); ties to smaller ids.

        A term that is asked twice counts twice. Scores are sums over the terms in
        one order, so that equal documents tie exactly.
        """
        state = self.manifest(version)
        weights: dict[str, int] = {}
        for t in terms:
            weights[t] = weights.get(t, 0) + 1
        rows = self._each(state, list(weights))
        n, mean = state["documents"], state["length"] / max(state["documents"], 1)
        df = rows.groupBy("term").agg(F.count("doc").alias("df"))
        asked = self.spark.createDataFrame([(t, float(w)) for t, w in weights.items()] or [("", 0.0)], "term string, weight double")
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("weight")
        known = df.join(F.broadcast(asked), "term").select("term", idf.alias("idf"))  # a row for each asked term
        r = ranking
        gain = F.col("idf") * F.col("count") * (r.k + 1) / (F.col("count") + r.k * (1 - r.b + r.b * F.col("size") / F.lit(mean or 1.0)))
        scored = rows.join(F.broadcast(known), "term").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", gain.alias("gain")))).alias("g"))
        if every:
            scored = scored.where(F.size("g") == len(weights))
        scored = scored.select("doc", F.aggregate("g", F.lit(0.0), lambda a, x: a + x["gain"]).alias("score"))
        best = scored.orderBy(F.desc("score"), "doc").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))  # of k rows
