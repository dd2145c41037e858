"""Cross-references between documents, category coverage and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.quality import CATEGORIES

#: Which category complements which, and what the link is called.
RULES = [
    ("tutorial", "how-to", "next_steps"), ("tutorial", "reference", "reference"), ("how-to", "tutorial", "learn_more"), ("how-to", "reference", "reference"),
    ("reference", "explanation", "deep_dive"), ("explanation", "tutorial", "hands_on"), ("explanation", "reference", "technical_details"),
]
DIRECTORIES = {"tutorial": "tutorials", "how-to": "how_to", "reference": "reference", "explanation": "explanation"}


def rules(spark, strategy: str) -> DataFrame:
    """(from_category, to_category, relationship) for ``same``, ``complementary`` or ``all``; 16 rows at most."""
    named = {(a, b): r for a, b, r in RULES}
    every = [(a, b) for a in CATEGORIES for b in CATEGORIES]
    pairs = {"same": [(a, b) for a, b in every if a == b], "complementary": list(named), "all": every}[strategy]
    return spark.createDataFrame([(a, b, named.get((a, b), "related"), "" if a == b else f"../{DIRECTORIES[b]}/") for a, b in pairs], "from_category string, to_category string, relationship string, base string")


def cross_references(docs: DataFrame, strategy: str = "complementary", title: str = "title", category: str = "category", slug: str = "slug") -> DataFrame:
    """Links (from_title, to_title, categories, relationship, path) between documents of different titles.

    The rule table joins first and is sent to all tasks; documents then meet by category.
    """
    a = docs.select(F.col(title).alias("from_title"), F.col(category).alias("from_category"))
    b = docs.select(F.col(title).alias("to_title"), F.col(category).alias("to_category"), F.col(slug).alias("to_slug"))
    ruled = a.join(F.broadcast(rules(docs.sparkSession, strategy)), "from_category")
    pairs = ruled.join(b, "to_category").where("from_title <> to_title")
    return pairs.select("from_title", "to_title", "from_category", "to_category", "relationship", F.concat("base", "to_slug", F.lit(".md")).alias("path"))


def link_groups(docs: DataFrame, strategy: str = "complementary", title: str = "title", category: str = "category") -> DataFrame:
    """The same links as groups: per title, category and rule how many documents of other titles it links to.

    With (category, title) of the documents as membership this is all of
    :func:`cross_references` without a row for each pair.
    """
    held = docs.groupBy(F.col(category).alias("from_category"), F.col(title).alias("from_title")).agg(F.count("*").alias("rows"))
    sizes = held.groupBy(F.col("from_category").alias("to_category")).agg(F.sum("rows").alias("all"))  # a row per category
    ruled = held.join(F.broadcast(rules(docs.sparkSession, strategy)), "from_category").join(F.broadcast(sizes), "to_category")
    same = held.select(F.col("from_category").alias("to_category"), "from_title", F.col("rows").alias("own"))
    made = ruled.join(same, ["to_category", "from_title"], "left").withColumn("targets", F.col("all") - F.coalesce("own", F.lit(0)))
    return made.where("targets > 0").select("from_title", "from_category", "to_category", "relationship", "base", "rows", "targets")


def missing_categories(docs: DataFrame, category: str = "category") -> DataFrame:
    every = docs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], f"{category} string")
    return every.join(docs.select(category), category, "left_anti")


def index_rows(docs: DataFrame, title: str = "title", category: str = "category") -> DataFrame:
    """The index as rows (place, category, title), sorted over all tasks; a category of any size."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col(category))
    return docs.select(place.alias("place"), F.col(category).alias("category"), F.col(title).alias("title")).where("place > 0").orderBy("place", "title")


def index(docs: DataFrame, title: str = "title", category: str = "category") -> DataFrame:
    """Titles by category, in the categories' fixed order."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col(category))
    return docs.groupBy(category).agg(F.array_sort(F.collect_list(title)).alias("titles")).withColumn("place", place).where("place > 0")
