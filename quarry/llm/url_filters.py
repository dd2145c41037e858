"""URL verdicts: longest matching rule, else naive Bayes over segmented hosts and paths.

Names in hosts are often words run together. A unigram model of the pages' own
words splits every host label along its most likely path (Viterbi), and a
multinomial naive Bayes model over those words and the path's words judges the
URLs that no rule reaches. Every URL trains it. One that a rule decides has the
rule's class, without the part that the rule itself names; of the others those
with a word of a short list in their host, which stands for unwanted hosts
anywhere, are block rows, and the rest are allow rows: what nothing speaks
against is allowed until its words say otherwise. A token counts as often as it
stands in a URL, and classes weigh by their rows.

All counts cover all rows, and none of them passes the driver or is sent to every
task: names meet the words that stand in them by a join, as tokens meet their odds;
names and tokens that fill the table are dealt to several tasks.
"""

from __future__ import annotations

import math
import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import written

#: Words in a host that make an undecided URL a block row.
SEEDS = ["adult", "bet", "buy", "casino", "cheap", "click", "deals", "farm", "free", "loan", "pills", "poker", "porn", "seo", "sex", "spam", "viagra", "win", "xxx"]
LONGEST = 24
SALT = 16  #: tasks that a hot name or token is dealt to


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for URLs without ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), form, k)
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. rules: (``host/path``, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda x: len(x[0])):
        top, rest = name.split("/", 1)
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


NAME = r"[\p{L}\p{N}]+"


def page_words(html: Column, df: DataFrame) -> DataFrame:
    """(word, n) of the pages' texts, without their markup."""
    plain = F.lower(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    return df.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def named(column: str) -> Column:
    """The names of a host or path: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(column), F.lit(NAME), F.lit(0))


def splits(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, parts) of different names: each meets the words that stand in it, and is split by them alone.

    A name's stretches of letters are cut into all their pieces up to the longest
    word's length, which join the words; what meets in a row is one name and its words.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = sorted(r[0] for r in words.select(F.length("word").alias("size")).distinct().collect())  # lengths, not words

    def pieces(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for run in re.findall(r"[^\W\d_]+", name):
                    for at in range(0, len(run), 4096):  # a run may be of any length
                        for n in sizes:
                            found = {run[k : k + n] for k in range(at, min(at + 4096, len(run) - n + 1))}
                            if found:
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(sorted(found))], ["name", "word"])

    met = names.mapInArrow(pieces, "name string, word string").distinct().join(words, "word")
    listed = names.join(met.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("words")), "name", "left")

    def split(batches):
        for batch in batches:
            found = []
            for name, known in zip(*(c.to_pylist() for c in batch.columns)):
                found.append((name,) if name == "#" else Segmenter({x["word"]: x["n"] for x in known or ()}, total).split(name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["name", "parts"])

    return listed.mapInArrow(split, "name string, parts array<string>")


class Segmenter:
    """Most likely split of a name into words; an unknown stretch costs more the longer it is.

    total: of the counts of all words, where ``counts`` has only some.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(10.0 * total)
        self.long = sorted({len(w) for w in counts if len(w) > LONGEST})
        self.seen: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if (found := self.seen.get(name)) is not None:
            return found
        best, back, cost = [0.0], [0], self.cost
        for end in range(1, len(name) + 1):
            least, at = math.inf, end - 1
            for start in range(max(0, end - LONGEST), end):
                c = cost.get(name[start:end])
                if c is None:
                    c = self.unknown + 3.0 * (end - start - 1)
                if best[start] + c < least:
                    least, at = best[start] + c, start
            for size in self.long:
                if size > end:
                    break
                c = cost.get(name[end - size : end])
                if c is not None and best[end - size] + c < least:
                    least, at = best[end - size] + c, end - size
            best.append(least)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        found = tuple(reversed(out))
        if len(self.seen) > 100_000:
            self.seen.clear()
        if len(name) <= 100:
            self.seen[name] = found
        return found


def salted(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """Left rows with their row of ``right`` (one per value of ``on``), hot values dealt to SALT tasks by the column ``by``."""
    many = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(many, [on, "salt"]).drop("salt")


def bare(host: Column, path: Column, rule: Column) -> tuple[Column, Column]:
    """Host and path without what the rule itself names, numbers in the path as 0."""
    top, rest = F.substring_index(rule, "/", 1), F.concat(F.lit("/"), F.regexp_extract(rule, r"(?s)^[^/]*/(.*)$", 1))
    cut = lambda whole, fits, part: F.when(fits, part).otherwise(whole)
    h = cut(host, F.coalesce(host.endswith(top), F.lit(False)), host.substr(F.lit(1), F.length(host) - F.length(top)))
    p = cut(path, F.coalesce(path.startswith(rest), F.lit(False)), path.substr(F.length(rest) + 1, F.length(path)))
    return h, F.regexp_replace(p, "[0-9]+", "0")


def tokenised(groups: DataFrame, words: DataFrame) -> DataFrame:
    """``groups`` (gid, host, path, ...) with ``tokens``: ``h:`` and ``p:`` words of its names, as often as they stand there; numbers are one word."""
    of = lambda kind, column: F.transform(named(column), lambda x: F.struct(F.lit(kind).alias("kind"), F.when(x.rlike(r"^\p{Nd}+$"), "#").otherwise(x).alias("name")))
    each = groups.select("gid", F.posexplode(F.concat(of("h:", "host"), of("p:", "path"))).alias("at", "x")).select("gid", "at", "x.kind", "x.name")
    names = each.select("name").distinct()
    found = written(splits(names, words))
    met = salted(each, found, "name", "gid").groupBy("gid").agg(F.flatten(F.collect_list(F.transform("parts", lambda w: F.concat("kind", w)))).alias("tokens"))
    return groups.join(met, "gid", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def learnt(rows: DataFrame) -> tuple[DataFrame, float]:
    """(token, odds) of multinomial naive Bayes with Laplace smoothing, and the log odds of the classes. rows: tokens, n, block.

    A token counts as often as it stands in a URL, times the URLs.
    """
    many = lambda block: F.coalesce(F.sum(F.when(F.col("block") == block, F.col("n"))), F.lit(0))
    counts = written(rows.select(F.explode("tokens").alias("token"), "block", "n").groupBy("token").agg(many(True).alias("b"), many(False).alias("a")))
    b, a, known = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("token")).first()
    rows_b, rows_a = rows.agg(many(True), many(False)).first()
    rate = lambda c, total: F.log((F.col(c) + 1) / F.lit(float(total + known + 1)))
    return counts.select("token", (rate("b", b) - rate("a", a)).alias("odds")), math.log((rows_b + 1) / (rows_a + 1))


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str]], margin: float = 9.0, id_column: str = "page_id", url: str = "url", html: str = "html", seeds: list[str] = SEEDS
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the model's log odds for a block (null under a rule).

    rules: (``host/path``, ``block`` or ``allow``). The model blocks where its odds
    are above ``margin``; of an empty URL it knows the classes' sizes only. Every
    row trains; those of one host and path (but for numbers) are split once, with
    their count. seeds: words in a host that make an undecided URL a block row.
    Of rules that fit the longest one speaks, of two of one length the later one.
    Null URLs are empty, null html has no words, null ids stay, repeated rows
    count each, and an empty table gives no rows. A page of any length is one
    row's list of words; a name of any length is split in steps of the longest
    word. Columns other than the three are not read.
    """
    host, path = url_parts(pages[url])
    parts = pages.select(pages[id_column].alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("says", verdict)
    own, rest = bare(F.col("host"), F.col("path"), F.col("rule"))
    keyed = parts.withColumn("key", F.struct(own.alias("host"), rest.alias("path")))
    grouped = keyed.groupBy("key", "says").agg(F.count("host").alias("n")).select("key.host", "key.path", "says", "n")
    groups = written(grouped.withColumn("gid", F.monotonically_increasing_id()))
    held = tokenised(groups, written(page_words(pages[html], pages)))
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit("h:" + w) for w in seeds])) if seeds else F.lit(False)
    held = written(held.withColumn("block", F.when(F.col("says").isNotNull(), F.col("says") == "block").otherwise(seeded)))
    odds, start = learnt(held)
    open_ = held.where("says is null")
    summed = salted(open_.select("gid", F.explode("tokens").alias("token")), odds, "token", "gid").groupBy("gid").agg(F.sum("odds").alias("sum"))
    scored = open_.join(summed, "gid", "left").select(F.struct("host", "path").alias("key"), (F.coalesce("sum", F.lit(0.0)) + start).alias("log_odds"))
    unruled = keyed.where("says is null").withColumn("place", F.monotonically_increasing_id())
    judged = salted(unruled, scored, "key", "place").select("id", "host", "path", "rule", F.when(F.round("log_odds", 9) > math.log(margin), "block").otherwise("allow").alias("verdict"), "log_odds")
    ruled = keyed.where("says is not null").select("id", "host", "path", "rule", F.col("says").alias("verdict"), F.lit(None).cast("double").alias("log_odds"))
    return judged.unionByName(ruled).withColumnRenamed("id", id_column)
