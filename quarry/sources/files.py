"""File sources and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.changes import ignored, matches

#: Globs of configuration files.
CONFIG_GLOBS = ["*.yaml", "*.yml", "*.toml", "*.json", "*/.env*", "*/Cargo.toml", "*/Cargo.lock", "*/package.json", "*/package-lock.json", "*/go.mod", "*/go.sum", "*/requirements.txt", "*/pyproject.toml", "*/setup.py", "*/Dockerfile", "*/docker-compose*"]


def hashed_files(spark: SparkSession, *roots: str, skip_ignored: bool = False) -> DataFrame:
    """(path, length, hash) of all files below some roots; a root that doesn't exist is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    files = files.select("path", "length", F.sha2("content", 256).alias("hash"))
    return files.where(~ignored(F.col("path"))) if skip_ignored else files


def markdown(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, text) of ``*.md`` and ``*.markdown`` below roots; roots that are files count whatever their name.

    Only names that count are opened. Without any root there are no rows; a root
    that doesn't exist is an error.
    """
    jvm, out = spark._jvm, None
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        read = spark.read.format("binaryFile")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            read = read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}")
        found = read.load(root).select("path", F.decode("content", "UTF-8").alias("text"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "path string, text string") if out is None else out.distinct()


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of files, each as one row."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def found(files: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """Files that match a glob, with the first one that they match."""
    first = F.coalesce(*[F.when(matches(F.col(path), [g]), F.lit(g)) for g in globs])
    return files.withColumn("glob", first).where("glob is not null")


#: Name endings of a language's sources.
SOURCE_GLOBS = {
    "rust": ["*.rs"], "go": ["*.go"], "python": ["*.py"], "javascript": ["*.js"], "typescript": ["*.ts", "*.tsx"], "java": ["*.java"], "csharp": ["*.cs"], "cpp": ["*.cpp", "*.cc", "*.cxx"], "c": ["*.c"],
}


def source_files(files: DataFrame, language: str, path: str = "path") -> DataFrame:
    """Files of a language by name; all files for a language without known endings."""
    globs = SOURCE_GLOBS.get(language)
    return files if globs is None else found(files, globs, path).drop("glob")


def config_files(files: DataFrame, path: str = "path") -> DataFrame:
    return found(files, CONFIG_GLOBS, path)


def directory_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def chunk_summaries(chunks: DataFrame) -> DataFrame:
    """Per file: hash, chunks, words, characters; written as JSON by :func:`write_json`."""
    return chunks.groupBy("file_path").agg(F.first("file_hash").alias("file_hash"), F.count("*").alias("chunks"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def push_events(stream: DataFrame, value: str = "value") -> DataFrame:
    """Pushes among webhook payloads: repository, branch, before, after. Merges and tags give nothing."""
    schema = "type string, repository string, ref string, before string, after string"
    e = F.from_json(F.col(value).cast("string"), schema)
    return stream.select(e.alias("e")).where("e.type = 'push'").select("e.repository", F.regexp_replace("e.ref", "^refs/heads/", "").alias("branch"), "e.before", "e.after")


def rendered(rows: DataFrame, form: str = "json", most: int = 1000) -> str:
    """Rows as text for a terminal: json, pretty, compact, yaml or table; of more than ``most`` the first, which is said on stderr."""
    import json
    import sys

    held = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    more, held = len(held) > most, held[:most]
    if more:
        print(f"only the first {most} rows are shown", file=sys.stderr)
    if form == "pretty":
        return json.dumps(held, indent=2, default=str, ensure_ascii=False)
    if form == "yaml":
        return "".join("- " + "\n  ".join(f"{k}: {json.dumps(v, default=str, ensure_ascii=False)}" for k, v in r.items()) + "\n" for r in held)
    if form == "table":
        names = rows.columns
        cells = [[str(r[c]) for c in names] for r in held]
        wide = [max(len(x) for x in column) for column in zip(names, *cells)] if cells else [len(c) for c in names]
        return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, wide)).rstrip() for row in [names, *cells])
    return "\n".join(json.dumps(r, default=str, ensure_ascii=False) for r in held)
