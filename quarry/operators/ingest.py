"""Ingest of documents into a chunk store: validate, hash, skip what is unchanged, chunk, replace, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import quality, text as tx, vector as vx
from quarry.operators import chunking, incremental
from quarry.session import scratch
from quarry.sources.store import Store

CHUNKS = (
    "file_path string, chunk_index int, total_chunks int, start_sentence int, end_sentence int, content string, embedding array<float>, avg_similarity double, word_count int, char_count int,"
    " file_hash string, source_file string, title string, category string, keywords array<string>, created_at timestamp"
)
NAMES = [c.split()[0] for c in CHUNKS.split(", ")[:10]] + ["file_hash", "source_file", "title", "category", "keywords", "created_at"]


def chunk_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, CHUNKS, "file_path", ("chunk_index",), buckets)


def described(docs: DataFrame) -> DataFrame:
    """``docs`` (file_path, text) with file_hash, source_file, title, category, keywords and created_at; columns that it has win, but for the hash."""
    path, text = F.col("file_path"), F.col("text")
    own = {
        "file_hash": tx.content_hash(text), "source_file": F.regexp_extract(path, r"([^/]+)$", 1), "title": tx.first_heading(text),
        "category": quality.path_category(path), "keywords": tx.heading_keywords(text),
    }
    return docs.select("file_path", "text", *[(F.col(c) if c in docs.columns and c != "file_hash" else v).alias(c) for c, v in own.items()], F.current_timestamp().alias("created_at"))


CARRIED = ["file_hash", "source_file", "title", "category", "keywords", "created_at"]


def chunks_of(docs: DataFrame, config: chunking.ChunkerConfig | None = chunking.ChunkerConfig(), model: Callable | None = None) -> DataFrame:
    """Rows of a chunk store from (file_path, text) rows; without a config one chunk per document, with no embedding."""
    about = described(docs)
    if config is None:
        one = F.lit(0).cast("int")
        return about.select(
            "file_path", one.alias("chunk_index"), F.lit(1).alias("total_chunks"), one.alias("start_sentence"), one.alias("end_sentence"), F.col("text").alias("content"),
            F.array().cast("array<float>").alias("embedding"), F.lit(0.0).alias("avg_similarity"), F.size(tx.words(F.col("text"))).alias("word_count"), F.length("text").alias("char_count"), *CARRIED,
        )
    made = chunking.chunk_documents(docs.select("file_path", "text"), config, key="file_path", model=model)
    return made.join(about.drop("text"), "file_path").select(*NAMES)


#: The simpler table: paragraphs with packed vectors and free metadata.
PIECES = "file_path string, file_hash string, chunk_id string, content string, embedding binary, metadata string"


def piece_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, PIECES, "file_path", ("chunk_id",), buckets)


def pieces_of(docs: DataFrame, vector: Callable = tx.hash_embedding) -> DataFrame:
    """Rows of a piece store from (file_path, text) rows: a row for each paragraph; metadata is JSON."""
    text = F.col("text")
    each = docs.select("file_path", tx.content_hash(text).alias("file_hash"), F.size(tx.paragraphs(text)).alias("total"), F.posexplode(tx.paragraphs(text)).alias("k", "content"))
    meta = F.to_json(F.struct(F.col("k").alias("index"), "total", F.length("content").alias("length")))
    return each.select("file_path", "file_hash", F.concat(F.lit("chunk_"), F.col("k").cast("string")).alias("chunk_id"), "content", vx.packed(vector(F.col("content"))).alias("embedding"), meta.alias("metadata"))


def judged(docs: DataFrame, store: DataFrame, config: chunking.ChunkerConfig | None = chunking.ChunkerConfig(), skip_existing: bool = True) -> DataFrame:
    """(file_path, text, file_hash, action, error) of every path: add, update, skip, or why it can't be ingested.

    A path that comes twice counts with its smallest text. Blank texts and, when
    chunking, texts without a sentence are errors of their own document; what the
    store holds of it stays.
    """
    text = F.col("text")
    known = incremental.known_hashes(store).withColumnRenamed("file_hash", "known").groupBy("file_path").agg(F.max("known").alias("known"))
    rows = docs.groupBy("file_path").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("file_hash", tx.content_hash(text)).join(known, "file_path", "left")
    error = F.when(tx.stripped(text) == "", "empty document")
    if config is not None:
        error = error.when(F.size(tx.sentences(text, config.min_sentence_length)) == 0, "no sentences")
    action = F.when(F.col("known").isNull(), "add").when(F.col("known") == F.col("file_hash"), "skip" if skip_existing else "update").otherwise("update")
    return rows.withColumn("error", error).withColumn("action", F.when(F.col("error").isNull(), action).otherwise("error")).drop("known")


def ingest(docs: DataFrame, store: Store, config: chunking.ChunkerConfig | None = chunking.ChunkerConfig(), skip_existing: bool = True, model: Callable | None = None) -> DataFrame:
    """Ingests (file_path, text, ...) rows in one commit; one row per path: what was done, chunks, sizes, error.

    The documents are read once, into a folder that is judged, chunked and reported
    from, so that a file that changes meanwhile is one text throughout. The
    report lies in the session's scratch folder.
    """
    spark, base = store.spark, store.manifest()
    text = F.coalesce("text", F.lit(""))
    smallest = docs.groupBy("file_path").agg(F.min(text).alias("text"), *[F.min_by(c, text).alias(c) for c in docs.columns if c not in ("file_path", "text")])
    taken, made = scratch(spark), scratch(spark)
    smallest.write.parquet(taken)
    once = spark.read.schema(smallest.schema).parquet(taken)
    state = judged(once, store.read(version=base["version"] or None), config, skip_existing)
    sized = state.select("file_path", "file_hash", "action", "error", F.length("text").alias("chars"), F.size(tx.words(F.col("text"))).alias("words"))
    sized.write.parquet(f"{made}/judged")
    report = spark.read.parquet(f"{made}/judged")
    changed = report.where("action in ('add', 'update')").select("file_path")
    fresh = chunks_of(once.join(changed, "file_path", "left_semi"), config, model)
    fresh.write.parquet(f"{made}/chunks")
    fresh = spark.read.schema(fresh.schema).parquet(f"{made}/chunks")
    store.replace(fresh, base=base, stable=True)
    counted = fresh.groupBy("file_path").agg(F.count("*").alias("chunks_created"))
    done = report.join(counted, "file_path", "left")
    done = done.select("file_path", "file_hash", "action", F.coalesce("chunks_created", F.lit(0)).alias("chunks_created"), (F.col("action") == "add").alias("is_new"), "chars", "words", "error")
    done.write.parquet(f"{made}/report")
    for folder in (taken, f"{made}/judged", f"{made}/chunks"):
        store.discard(folder)
    return spark.read.schema(done.schema).parquet(f"{made}/report")


def batch_summary(report: DataFrame) -> DataFrame:
    """One row: documents, successful ones, failed ones, chunks."""
    failed = F.coalesce(F.sum(F.col("error").isNotNull().cast("long")), F.lit(0))
    return report.agg((F.count("*") - failed).alias("successful"), failed.alias("failed"), F.count("*").alias("total"), F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks"))
