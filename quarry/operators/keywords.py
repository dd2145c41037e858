"""Keyword extraction by frequency, enrichment, and roll-out or experiment arms."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from quarry.functions.text import content_hash, tokens

#: Words that are never keywords.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "it", "its", "they", "them", "their", "we", "our", "you", "your", "he", "she", "him", "her", "his",
]
#: Fixed value: what makes a word technical, beside its length.
TECHNICAL = r"[_.-]|(rs|toml|yaml|json)$|^(cargo|rust|async)"
DESCRIPTIVE_MOST, TECHNICAL_MOST, ENRICHED_MOST = 8, 10, 15


def is_technical(word: Column) -> Column:
    return word.rlike(TECHNICAL) | (F.octet_length(word) > 12)


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, count); one exchange on (key, word), combined before it."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("count"))


def keywords(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Top words of each document: (key, word, count, score, class, rank).

    Stop words and words of up to two bytes are out; score = count * ln(bytes)
    to nine places, ties by word. The best 18 of a document are split into technical (10 at most)
    and descriptive (8 at most).
    """
    size = F.octet_length("word")
    scored = term_frequencies(docs, key, text).where(~F.col("word").isin(STOP_WORDS) & (size > 2)).withColumn("score", F.round(F.col("count") * F.log(size), 9))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "word"))).where(F.col("rank") <= DESCRIPTIVE_MOST + TECHNICAL_MOST)
    classed = top.withColumn("class", F.when(is_technical(F.col("word")), "technical").otherwise("descriptive"))
    place = F.row_number().over(Window.partitionBy(key, "class").orderBy("rank"))
    most = F.when(F.col("class") == "technical", TECHNICAL_MOST).otherwise(DESCRIPTIVE_MOST)
    return classed.withColumn("place", place).where(F.col("place") <= most).drop("place")


def keyword_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document that has keywords: descriptive, technical, method, confidence."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == c, F.struct("rank", "word")))), lambda x: x["word"])
    return keywords(docs, key, text).groupBy(key).agg(listed("descriptive").alias("descriptive"), listed("technical").alias("technical")).withColumn("method", F.lit("frequency")).withColumn("confidence", F.lit(0.6))


def cleaned(words: Column, most: int) -> Column:
    """First ``most`` different keywords, trimmed and in lower case, of over one byte."""
    return F.slice(F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: F.octet_length(w) > 1)), 1, most)


def enriched(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks with alphabetical keywords and a status; texts under 50 bytes are skipped.

    Equal texts are extracted once.
    """
    rows = chunks.withColumn("_hash", content_hash(F.col(text)))
    long = F.octet_length(text) >= 50
    once = keyword_lists(rows.where(long).select("_hash", F.col(text).alias("_text")).dropDuplicates(["_hash"]), "_hash", "_text")
    listed = once.select("_hash", F.slice(F.array_sort(F.array_distinct(F.concat("descriptive", "technical"))), 1, ENRICHED_MOST).alias("keywords"))
    status = F.when(~long, "skipped").when(F.col("keywords").isNull(), "error").otherwise("enriched")
    return rows.join(listed, "_hash", "left").drop("_hash").withColumn("status", status)


def parsed_answer(answer: Column) -> Column:
    """Keywords in the outermost braces of a model's answer, null if there are none."""
    schema = "struct<descriptive:array<string>,technical:array<string>,confidence:double>"
    body = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)
    d, t = cleaned(F.coalesce(body["descriptive"], F.array()), DESCRIPTIVE_MOST), cleaned(F.coalesce(body["technical"], F.array()), TECHNICAL_MOST)
    found = F.struct(d.alias("descriptive"), t.alias("technical"), body["confidence"].alias("confidence"))
    return F.when((F.size(d) > 0) | (F.size(t) > 0), found)


def asked(docs: DataFrame, text: str, model: Callable[[list[str]], list[str]], most: int = 8000, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds ``answer``: what a text model says to the first ``most`` bytes (no character is cut); null after ``tries`` failures, ``wait`` seconds apart."""

    def run(frames):
        for frame in frames:
            answers = None
            texts = [(t or "").encode()[:most].decode("utf-8", "ignore") for t in frame[text]]
            for k in range(tries):
                if k:
                    time.sleep(wait)
                try:
                    answers = model(texts)
                    break
                except (OSError, RuntimeError):
                    continue
            yield frame.assign(answer=answers if answers is not None else [None] * len(frame))

    return docs.mapInPandas(run, StructType(list(docs.schema.fields)).add("answer", "string"))


def streamed_answer(body: Column) -> Column:
    """The text of a streamed answer: ``response`` of its JSON lines in order, up to the one that says ``done``."""
    part = F.transform(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"\S")), lambda x: F.from_json(x, "struct<response:string,done:boolean>"))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    step = lambda a, x: F.when(a["done"], a).otherwise(F.struct(F.concat(a["text"], F.coalesce(x["response"], F.lit(""))).alias("text"), F.coalesce(x["done"], F.lit(False)).alias("done")))
    return F.aggregate(part, start, step, lambda a: a["text"])


def extracted(docs: DataFrame, key: str, text: str, model: Callable[[list[str]], list[str]] | None = None, percent: float = 100.0, fallback: bool = True, least: int = 50, wait: float = 1.0) -> DataFrame:
    """(key, descriptive, technical, method, confidence, error) of every document: a model's keywords or the frequent words.

    Equal texts are extracted once. Those among ``percent`` of the hashes with
    ``least`` bytes or more go to the model; where it fails or says nothing
    usable, frequency takes over or, without fallback, the document has an error.
    Blank texts are an error of their own.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", content_hash(F.col("_text")))
    once = rows.where(F.col("_text").rlike(r"(?U)\S")).select("_hash", "_text").dropDuplicates(["_hash"])
    gate = in_rollout(F.col("_hash"), percent) if model is not None else F.lit(False)
    once = once.withColumn("_gate", gate & (F.octet_length("_text") >= least))
    counted = keyword_lists(once, "_hash", "_text")
    if model is not None:
        said = asked(once.where("_gate"), "_text", model, wait=wait).select("_hash", parsed_answer(F.col("answer")).alias("_said"))
    else:
        said = once.where("false").select("_hash", F.lit(None).cast("struct<descriptive:array<string>,technical:array<string>,confidence:double>").alias("_said"))
    found = once.select("_hash", "_gate").join(said, "_hash", "left").join(counted, "_hash", "left")
    by_model = F.col("_said").isNotNull()
    error = F.when(F.col("_gate") & ~by_model & F.lit(not fallback), "the model gave no keywords")
    none = F.array().cast("array<string>")
    pick = lambda c: F.when(by_model, F.col(f"_said.{c}")).when(error.isNull(), F.coalesce(c, none))
    made = found.select(
        "_hash", pick("descriptive").alias("descriptive"), pick("technical").alias("technical"), F.when(by_model, "model").when(error.isNull(), "frequency").alias("method"),
        F.when(by_model, F.col("_said.confidence")).when(error.isNull(), F.coalesce("confidence", F.lit(0.6))).alias("confidence"), error.alias("_error"),
    )
    joined = rows.join(made, "_hash", "left")
    blank = F.when(~F.col("_text").rlike(r"(?U)\S"), "empty content")
    return joined.select(key, "descriptive", "technical", "method", "confidence", F.coalesce(blank, F.col("_error")).alias("error"))


def in_rollout(key: Column, percent: float, seed: int = 0) -> Column:
    """Whether a key is among the given percent of the hash space; the hash, of the key as text, is one that any system has."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % 100 < F.lit(int(min(max(percent, 0), 100)))


def arms(docs: DataFrame, key: str, percent: float, assigned: DataFrame | None = None) -> DataFrame:
    """Adds ``arm``: a stored one where ``assigned`` (key, arm) has it, else by hash."""
    fresh = F.when(in_rollout(F.col(key), percent), "treatment").otherwise("control")
    if assigned is None:
        return docs.withColumn("arm", fresh)
    return docs.join(assigned.select(key, F.col("arm").alias("_arm")), key, "left").withColumn("arm", F.coalesce("_arm", fresh)).drop("_arm")


def feedback(rows: DataFrame) -> DataFrame:
    """Means over (extracted, useful, missing, rating) rows."""
    from quarry.functions.quality import keyword_scores

    p, r, f = keyword_scores(F.col("extracted"), F.col("useful"), F.col("missing"))
    return rows.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"), F.avg("rating").alias("rating"))
