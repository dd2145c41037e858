"""Command line over versioned stores: load, chunk, search, classify, analyze, validate, report, version."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from quarry.functions import quality, text as tx
from quarry.operators import analytics, chunking, code, incremental, ingest, intents, search
from quarry.session import session
from quarry.sources import files
from quarry.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="bring a store up to date with files")
    load.add_argument("paths", nargs="+")
    load.add_argument("--store", required=True)
    for flag in ("resume", "update", "cleanup", "dry-run", "force"):
        load.add_argument(f"--{flag}", action="store_true")
    chunk = sub.add_parser("chunk", help="semantic chunks of Markdown files")
    chunk.add_argument("paths", nargs="+")
    chunk.add_argument("--store", required=True)
    chunk.add_argument("--output")
    chunk.add_argument("--strategy", choices=[*chunking.PRESETS, "custom"], default="default")
    chunk.add_argument("--threshold", type=float)
    chunk.add_argument("--max-sentences", type=int)
    chunk.add_argument("--dry-run", action="store_true")
    chunk.add_argument("--no-chunking", action="store_true", help="one chunk per document")
    chunk.add_argument("--all", action="store_true", help="chunk unchanged files again, too")
    ask = sub.add_parser("classify", help="which kind of document a question asks for")
    ask.add_argument("query")
    ask.add_argument("--multi-intent", "-m", action="store_true")
    ask.add_argument("--threshold", "-t", type=float, default=intents.THRESHOLD)
    ask.add_argument("--format", "-f", choices=["text", "json"], default="text")
    ask.add_argument("--verbose", "-v", action="store_true")
    find = sub.add_parser("search", help="nearest chunks of a store")
    find.add_argument("query")
    find.add_argument("--store", required=True)
    find.add_argument("--max-results", type=int, default=10)
    find.add_argument("--min-similarity", type=float, default=0.0)
    find.add_argument("--category")
    find.add_argument("--format", choices=["json", "pretty", "compact", "yaml", "table"], default="table")
    find.add_argument("--full-content", action="store_true")
    for name in ("analyze", "validate", "report"):
        sub.add_parser(name).add_argument("path")
    sub.add_parser("version")
    return p


LOADED = "path string, hash string, length long"


def run(args: argparse.Namespace, spark) -> str:
    if args.command == "load":
        flags = incremental.LoadFlags(args.resume, args.update, args.cleanup, args.dry_run, args.force)
        current = files.hashed_files(spark, *args.paths)
        store = Store(spark, args.store, LOADED, "path")  # a store that can't be read is an error, and stays as it is
        changes = incremental.compared(current, store.read())
        counts = json.loads(files.rendered(incremental.counted(changes)))
        if not args.dry_run:
            plan = incremental.planned(changes, flags)
            fresh = current.join(plan.where("action in ('add', 'update')").select("path"), "path", "left_semi").select("path", "hash", "length")
            store.replace(fresh, plan.where("action = 'delete'").select("path"))
        return json.dumps(counts | {"mode": flags.mode, "dry_run": args.dry_run})
    if args.command == "chunk":
        config = chunking.PRESETS.get(args.strategy, chunking.ChunkerConfig())
        more = {k: v for k, v in (("similarity_threshold", args.threshold), ("max_chunk_sentences", args.max_sentences)) if v is not None}
        config = None if args.no_chunking else chunking.replace(config, **more)
        docs = files.markdown(spark, *args.paths).withColumnRenamed("path", "file_path")
        store = ingest.chunk_store(spark, args.store)
        if args.dry_run:
            return files.rendered(ingest.judged(docs, store.read(), config, not args.all).select("file_path", "action", "error"), "table")
        report = ingest.ingest(docs, store, config, not args.all)
        if args.output:
            files.write_json(files.chunk_summaries(store.read()), args.output)
        return files.rendered(report.select("file_path", "action", "chunks_created", "error"), "table") + "\n" + files.rendered(ingest.batch_summary(report), "pretty")
    if args.command == "classify":
        search.require(bool(args.query.strip()), "the query is blank")
        asked = spark.createDataFrame([(args.query,)], "query string")
        made = intents.classified(asked, "query", threshold=args.threshold, multi=args.multi_intent).first()
        search.require(made["error"] is None, f"{made['error']}: confidence {made['confidence']:.2f}")
        found = {"intent": made["intent"], "confidence": made["confidence"], "level": spark.range(1).select(quality.intent_level(F.lit(made["confidence"]))).first()[0]}
        found |= {"secondary": [f"{x['intent']}:{x['confidence']:.2f}" for x in made["secondary"]]} if args.multi_intent else {}
        found |= {"reasoning": made["reasoning"]} if args.verbose else {}
        return json.dumps(found) if args.format == "json" else "\n".join(f"{k}: {v}" for k, v in found.items())
    if args.command == "search":
        search.require(bool(args.query.strip()), "the query is blank")
        q = spark.range(1).select(tx.hash_embedding(F.lit(args.query)).alias("v")).first()["v"]
        found = search.semantic_search(ingest.chunk_store(spark, args.store).read(), q, search.SearchConfig(args.max_results, args.min_similarity, args.category), ties=("file_path", "chunk_index"))
        content = F.col("content") if args.full_content else tx.display(F.col("content"), 200)
        return files.rendered(found.select("file_path", "chunk_index", "category", F.round("similarity", 4).alias("similarity"), content.alias("content")), args.format)
    if args.command == "analyze":
        texts = files.texts(spark, args.path)
        return files.rendered(code.coverage(code.structure(texts), "language"), "table") + "\n" + files.rendered(code.language_census(texts), "table")
    if args.command == "validate":
        t = F.col("text")
        issues = F.size(quality.lint(t))
        return files.rendered(files.markdown(spark, args.path).select("path", quality.document_category(F.col("path"), t).alias("category"), F.round(quality.readability(t), 3).alias("readability"), F.round(quality.structure(t), 3).alias("structure"), issues.alias("issues")), "table")
    if args.command == "report":
        events = spark.read.parquet(args.path)
        return files.rendered(analytics.usage(events), "pretty") + "\n" + files.rendered(analytics.quality(events), "pretty")
    return "quarry 1"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args, session("quarry-cli")))
    except (search.QueryError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
