"""Cross-document line frequency as a quality rule, with per-document base counts.

A line that more than ``limit`` documents of one host hold is furniture of that
host and goes; a document that keeps too little of itself goes with it. All of
it is Catalyst expressions. Each text is read once: its counts and its lines, as
128 bits of hash and a word count each, go into a table in the shared folder,
from which documents are counted by host and line and the lost words by row.
Counts are combined before they are exchanged, keys that are grouped by hold a
document or a row, and the join that brings verdicts back is an ordinary one,
which adaptive execution splits at hot lines or turns into a broadcast where the
frequent lines are few.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import BLANKS, WORD, written

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normal_line(line: Column) -> Column:
    """A-Z in lower case, blanks as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, string.ascii_uppercase, string.ascii_lowercase), BLANKS, " "))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array.

    Linear but for one sort of the windows' hashes: equal neighbours mark their
    positions, whose overlaps then count once. Arrays bound by a lambda are
    computed once.
    """
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    hashes = bind(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        starts = bind(ranked, lambda s: F.transform(F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at"))
        return F.aggregate(F.sort_array(starts), first, step, lambda a: a["n"])

    counted = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted).cast("long")


def base_counts(df: DataFrame) -> DataFrame:
    """``df`` (with a column text) and its counts; nothing here needs another row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = df.withColumn("words", words_of(text)).withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    return held.select(
        *df.columns,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def line_quality(df: DataFrame, limit: int = 10, keep_share: float = 0.5, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``df``: id, counts, the words on frequent lines, base_failed and kept.

    limit: a line goes when more documents of its host hold it, copies of one
    text among them; keep_share: a document is depleted when fewer of its words
    are left. A document is an id, so rows that repeat one count once, and a row
    without id is a document of its own. Null texts have no words (base_failed),
    null hosts are one host, repeated rows get equal verdicts, an empty table
    gives no rows. A text of any length is one row's arrays: memory is a small
    multiple of the longest text. Columns other than the three are not read.
    """
    docs = df.select(df[id_column].alias("id"), df[host].alias("host"), F.coalesce(df[text], F.lit("")).alias("text"))

    def mark(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"))

    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(mark(normal_line(x)).alias("line"), F.size(words_of(x)).alias("n")))
    # the row's number is kept in the table, so that it is one whatever runs again
    held = written(base_counts(docs.withColumn("found", F.filter(lines, lambda x: x["n"] > 0))).drop("text").withColumn("row", F.monotonically_increasing_id()))
    each = held.select("row", "host", "id", F.explode("found").alias("x")).select("row", "host", "id", "x.line", "x.n")
    own = F.when(F.col("id").isNull(), F.col("row")).alias("own")
    frequent = (
        each.groupBy("host", "line", "id", own).agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("one").alias("documents")).where(F.col("documents") > limit)
        .select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    )
    on_frequent = each.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")), "left_semi")
    lost = on_frequent.groupBy("row").agg(F.sum("n").alias("n_line_words"))
    judged = held.drop("found").join(lost, "row", "left")
    removed = F.coalesce("n_line_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - removed >= keep_share * F.col("n_words"))).alias("kept"), removed.alias("n_line_words"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
      FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, t) AS c FROM g) WHERE c > 1) GROUP BY rn),
s AS (SELECT rn, doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d),
l AS (SELECT rn, doc_id, source, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
        trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS q FROM s),
f AS (SELECT source, q FROM l WHERE n > 0 GROUP BY source, q HAVING count(DISTINCT coalesce('#' || doc_id, 'row ' || rn)) > 10),
u AS (SELECT rn, count(*) - count(DISTINCT l.l) AS dup,
        sum(CASE WHEN f.q IS NOT NULL THEN n ELSE 0 END) AS gone
        FROM l LEFT JOIN f ON l.q = f.q AND l.source IS NOT DISTINCT FROM f.source WHERE n > 0 GROUP BY rn),
x AS (SELECT d.*, len(w) AS n_words, coalesce(r.n, 0) AS rep, coalesce(u.dup, 0) AS dup, coalesce(u.gone, 0) AS gone
      FROM d LEFT JOIN r USING (rn) LEFT JOIN u USING (rn)),
y AS (SELECT *, n_words < 50 OR 100 * rep > 50 * n_words AS failed FROM x)
SELECT doc_id, n_words::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND n_words - gone >= 0.5 * n_words AS kept, gone::BIGINT AS n_line_words
FROM y
"""
