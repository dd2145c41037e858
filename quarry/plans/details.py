"""Queries over single rules, on the columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import changes, quality, text as tx
from quarry.operators import code, crossref, incremental, ingest, keywords
from quarry.plans.queries import query, read, source_files
from quarry.session import scratch

PAGE_PATHS = """f AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '[.]', '/', 'g') || (['.rs', '.md', '.yaml', '.proto', '/config.ini', '.tmp', '/node_modules/a.js', '.JSON'])[page_id % 8 + 1] AS path, length(html) % 90 AS lines,
  (['added', 'modified', 'deleted', 'renamed'])[page_id % 4 + 1] AS change FROM pages)"""
ENDS = [".rs", ".md", ".yaml", ".proto", "/config.ini", ".tmp", "/node_modules/a.js", ".JSON"]


def page_paths(spark, sf):
    k = F.col("page_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    path = F.concat(F.regexp_replace(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1), "[.]", "/"), pick(ENDS, 8))
    return read(spark, sf, "pages").select("page_id", "url", path.alias("path"), (F.length("html") % 90).alias("lines"), pick(["added", "modified", "deleted", "renamed"], 4).alias("change"))


@query(f"""WITH {PAGE_PATHS}, e AS (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1)) AS x FROM f)
SELECT page_id, CASE x WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' WHEN 'yaml' THEN 'yaml' WHEN 'js' THEN 'javascript' WHEN 'json' THEN 'json' ELSE 'unknown' END AS language,
 CASE x WHEN 'yaml' THEN 'yaml' WHEN 'json' THEN 'json' WHEN 'ini' THEN 'ini' ELSE 'unknown' END AS format, contains(path, 'node_modules') OR ends_with(path, '.tmp') OR {" OR ".join(f"contains(path, '{d}')" for d in changes.IGNORED_DIRECTORIES)} AS ignored,
 CASE WHEN contains(path, 'api/') OR ends_with(path, '.proto') OR change IN ('added', 'deleted') THEN 'major' WHEN lines > 50 OR ends_with(path, '.rs') OR ends_with(path, '.js') THEN 'minor' WHEN lines > 0 THEN 'patch' ELSE 'none' END AS severity,
 {" OR ".join("contains(lower(url), '" + w.replace("'", "''") + "')" for w in changes.SUSPICIOUS)} AS suspicious, contains(path, '../') AS traverses FROM e""")
def path_rules(spark, sf):
    """What the paths of the pages' URLs say: language, configuration format, whether they are ignored, severity of a change."""
    p = F.col("path")
    return page_paths(spark, sf).select(
        "page_id", changes.language(changes.extension(p)).alias("language"), changes.config_format(p).alias("format"), changes.ignored(p).alias("ignored"),
        changes.severity(p, F.col("change"), F.col("lines")).alias("severity"), changes.suspicious(F.col("url")).alias("suspicious"), changes.traverses(p).alias("traverses"),
    )


@query(f"""WITH {PAGE_PATHS}, s AS (SELECT page_id % 25 AS change, max(CASE WHEN contains(path, 'api/') OR ends_with(path, '.proto') OR change IN ('added', 'deleted') THEN 3 WHEN lines > 50 OR ends_with(path, '.rs') OR ends_with(path, '.js') THEN 2 WHEN lines > 0 THEN 1 ELSE 0 END) AS n FROM f GROUP BY 1)
SELECT change, (['none', 'patch', 'minor', 'major'])[n + 1] AS severity FROM s""")
def change_severity(spark, sf):
    """The highest severity of a change's files."""
    each = page_paths(spark, sf).select((F.col("page_id") % 25).alias("change_id"), changes.severity(F.col("path"), F.col("change"), F.col("lines")).alias("s"))
    return each.groupBy(F.col("change_id").alias("change")).agg(changes.highest(F.collect_list("s")).alias("severity"))


@query("""SELECT event_id, CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.5 THEN 'fair' ELSE 'poor' END AS grade, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT event_id, value / (SELECT max(value) FROM events) AS s FROM events)""")
def grades(spark, sf):
    e = read(spark, sf, "events")
    s = e.join(F.broadcast(e.agg(F.max("value").alias("most")))).withColumn("s", F.col("value") / F.col("most"))  # one row
    return s.select("event_id", quality.grade(F.col("s")).alias("grade"), quality.intent_level(F.col("s")).alias("level"))


@query("""SELECT p_partkey, replace(replace(lower(t), ' ', '_'), '-', '_') AS slug, regexp_replace(regexp_replace(lower(t), '[^a-z0-9 _-]', '', 'g'), ' +', '-', 'g') AS anchor
FROM (SELECT p_partkey, p_name || ' ' || p_type || '-' || p_size AS t FROM part)""")
def slugs(spark, sf):
    """File names and anchors of titles."""
    t = F.concat_ws(" ", "p_name", F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")))
    return read(spark, sf, "part").select("p_partkey", tx.file_slug(t).alias("slug"), tx.anchor(t).alias("anchor"))


@query("""SELECT doc_id, CASE WHEN length(text) > 80 THEN (CASE WHEN contains(h, ' ') THEN regexp_replace(h, ' [^ ]*$', '') ELSE h END) || '...' ELSE text END AS shown, regexp_replace(text, '\\s+', '', 'g') <> '' AS tidy
FROM (SELECT doc_id, text, substr(text, 1, 80) AS h FROM documents)""")
def displays(spark, sf):
    """Texts for display: 80 characters, back to a space."""
    d = read(spark, sf, "documents")
    return d.select("doc_id", tx.display(F.col("text"), 80).alias("shown"), (F.length(tx.tidied(F.col("text"))) > 1).alias("tidy"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 2461) AS head, strlen(text) AS bytes FROM documents), c AS (SELECT *, ceil(bytes / 4.0::DOUBLE * 1.3::DOUBLE) <= 800 AS fits, length(head) - strpos(reverse(head), '.') + 1 AS stop, length(head) - strpos(reverse(head), ' ') AS gap FROM h)
SELECT doc_id, md5(CASE WHEN fits THEN text WHEN contains(head, '.') AND stop > 2461 // 2 THEN substr(head, 1, stop) WHEN contains(head, ' ') THEN substr(head, 1, gap) ELSE head END) AS digest FROM c""")
def texts_cut_to_fit(spark, sf):
    """Texts that fit 800 tokens, the others back to a full stop or a space."""
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.truncated_to(F.col("text"), 1000, 200).cast("binary")).alias("digest"))


@query("""SELECT count(*) - count(*) FILTER (blank) AS successful, count(*) FILTER (blank) AS failed, count(*) AS total, count(*) - count(*) FILTER (blank) AS chunks FROM (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank FROM documents)""")
def batch_report(spark, sf):
    """One ingest of all documents, summed up."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    made = ingest.batch_summary(ingest.ingest(d, ingest.chunk_store(spark, scratch(spark), buckets=4), None))
    return made.select(*[F.col(c).cast("long").alias(c) for c in made.columns])


@query("""SELECT s.source AS file_path, count(*) AS rows FROM documents s WHERE s.doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.doc_id % 50 = 0) GROUP BY 1""")
def deleted_rows(spark, sf):
    """How many rows of each file go when files are deleted from a table."""
    d = read(spark, sf, "documents")
    _, gone = incremental.deleted(d.where("doc_id % 3 = 0").select(F.col("source").alias("file_path"), "doc_id"), d.where("doc_id % 50 = 0").select(F.col("source").alias("file_path")).distinct(), "file_path")
    return gone.select("file_path", F.col("rows").cast("long").alias("rows"))


@query("""SELECT 'doc/' || doc_id AS file_path, sha256(text) AS file_hash FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def stored_hashes(spark, sf):
    """The hash of every file that a store holds."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    store = ingest.chunk_store(spark, scratch(spark), buckets=4)
    ingest.ingest(d, store, None)
    return incremental.known_hashes(store.read())


@query("""WITH c(category, k) AS (VALUES ('tutorial', 0), ('how-to', 1), ('reference', 2), ('explanation', 3)) SELECT category FROM c WHERE k NOT IN (SELECT doc_id % 3 FROM documents)""")
def category_gaps(spark, sf):
    """Categories without a document."""
    d = read(spark, sf, "documents").select(F.element_at(F.array(*map(F.lit, ["tutorial", "how-to", "reference"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("category"))
    return crossref.missing_categories(d)


@query("""WITH k AS (SELECT conv_id, turn % 4 AS e, turn % 3 AS u, conv_id % 3 AS m, (conv_id % 5 + 1)::DOUBLE AS r FROM conversations), s AS (SELECT *, CASE WHEN e > 0 THEN least(u, e) / e ELSE 0.0 END AS p, CASE WHEN least(u, e) + m > 0 THEN least(u, e) / (least(u, e) + m) ELSE 0.0 END AS q FROM k)
SELECT round(avg(p), 6)::DOUBLE AS precision, round(avg(q), 6)::DOUBLE AS recall, round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END), 6)::DOUBLE AS f1, round(avg(r), 6)::DOUBLE AS rating FROM s""")
def feedback_summary(spark, sf):
    """Means of keyword feedback, a row for each turn of a conversation."""
    c = read(spark, sf, "conversations")
    some = lambda n: F.slice(F.array(*[F.lit(f"w{k}") for k in range(4)]), 1, n.cast("int"))
    e, u, m = F.col("turn") % 4, F.col("turn") % 3, F.col("conv_id") % 3
    made = keywords.feedback(c.select(some(e).alias("extracted"), some(F.least(u, e)).alias("useful"), some(m).alias("missing"), (F.col("conv_id") % 5 + 1).alias("rating")))
    return made.select(*[F.round(F.col(c), 6).alias(c) for c in made.columns])


@query("""WITH n AS (SELECT count(*) FILTER (doc_id % 6 = 0) AS rs, count(*) FILTER (doc_id % 6 = 1) AS go, count(*) FILTER (doc_id % 6 = 2) AS py, count(*) AS n, count(*) FILTER (doc_id % 6 IN (0, 1) AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS noted FROM documents)
SELECT (2 * n)::BIGINT AS items, 0::BIGINT AS configs, (noted + py)::BIGINT AS documented, round((noted + py) / (2 * n), 6) AS coverage FROM n""")
def documented_items(spark, sf):
    """Documented items over all, of source files made of the documents."""
    items = code.structure(source_files(read(spark, sf, "documents")))
    made = code.documentation_coverage(items, code.config_files(source_files(read(spark, sf, "documents"))))
    return made.withColumn("coverage", F.round("coverage", 6))


@query("""SELECT 'function' AS kind, source || '/f' || doc_id || (['.rs', '', '.py', '.js', '.ts', '.java'])[doc_id % 6 + 1] AS path, 'f' || doc_id AS name FROM documents WHERE doc_id % 6 <> 1""")
def public_functions(spark, sf):
    return code.public_functions(code.structure(source_files(read(spark, sf, "documents")))).select("kind", "path", "name")


@query("""SELECT (['rust', 'go', 'python', 'javascript', 'typescript', 'java'])[doc_id % 6 + 1] AS language, 2 * count(*) AS items, (count(*) FILTER (doc_id % 6 <> 1) / count(*))::DOUBLE AS public_functions FROM documents GROUP BY doc_id % 6""")
def language_coverage(spark, sf):
    """Items by language, and how many of their functions are public."""
    made = code.coverage(code.merged(code.structure(source_files(read(spark, sf, "documents"))), code.structure(source_files(read(spark, sf, "documents")))), "language")
    return made.select("language", "items", "public_functions")


@query("""WITH p AS (SELECT doc_id, text, unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS p FROM documents WHERE doc_id % 13 <> 0),
n AS (SELECT doc_id, text, p, row_number() OVER (PARTITION BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT 'doc/' || doc_id AS file_path, sha256(text) AS file_hash, count(*) AS pieces, 1536 * count(*) AS bytes, sum(length(p))::BIGINT AS chars, max(n)::BIGINT AS total, (SELECT count(*) FROM (SELECT unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) FROM documents WHERE doc_id % 13 = 0)) AS deleted FROM n GROUP BY 1, 2""")
def piece_store(spark, sf):
    """A store of paragraphs with packed vectors, after a deletion that says how many rows it took."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", "text")
    store = ingest.piece_store(spark, scratch(spark), buckets=4)
    store.replace(ingest.pieces_of(d))
    gone = store.delete(d.where("doc_id % 13 = 0"))
    total = F.get_json_object("metadata", "$.total").cast("long")
    made = store.read().groupBy("file_path", "file_hash").agg(F.count("*").alias("pieces"), F.sum(F.octet_length("embedding")).cast("long").alias("bytes"), F.sum(F.length("content")).alias("chars"), F.max(total).alias("total"))
    return made.withColumn("deleted", F.lit(gone).cast("long"))
