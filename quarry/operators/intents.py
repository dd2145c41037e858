"""What kind of document a question asks for: answers of a model, or rules, as intents with confidences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.quality import any_of
from quarry.functions.text import normal_query, stripped
from quarry.operators.keywords import asked

#: Intents, and the names that stand for each.
INTENTS = ["tutorial", "howto", "reference", "explanation"]
ALIASES = {
    "tutorial": ["tutorial", "tutorials"], "howto": ["howto", "how-to", "how_to", "guide"], "reference": ["reference", "api", "api-reference"],
    "explanation": ["explanation", "explanations", "concept", "concepts"],
}
#: Words that name an intent in an answer without the form asked for.
NAMED = {"tutorial": ["tutorial"], "howto": ["howto", "how-to", "how to"], "reference": ["reference"], "explanation": ["explanation"]}
UNSAID, THRESHOLD = 0.7, 0.6
#: The lines of an answer.
ANSWER = {"intent": r"(?i)Intent:\s*(\w+)", "confidence": r"(?i)Confidence:\s*([0-9.]+)", "reasoning": r"(?i)Reasoning:\s*(.+?)(?:\n|\z)", "secondary": r"(?i)Secondary:\s*(.+?)(?:\n|\z)"}
#: What speaks for an intent in a question, for the rules that stand in for a model; ordinary phrases, some of which any question to a model names as examples.
SIGNS = {
    "tutorial": ["getting started", "first steps", "learn", "tutorial", "beginner"], "howto": ["how to", "how do i", "how can i", "configure", "set up", "setup", "install"],
    "reference": ["api", "option", "parameter", "reference", "syntax"], "explanation": ["why", "explain", "architecture", "concept", "what is"],
}


def intent_named(name: Column) -> Column:
    """The intent that a name stands for, in any case; null if none."""
    n, out = F.lower(name), F.lit(None).cast("string")
    for intent, names in ALIASES.items():
        out = F.when(n.isin(names), intent).otherwise(out)
    return out


def clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def parsed(answer: Column, threshold: float = THRESHOLD, multi: bool = False) -> Column:
    """struct(intent, confidence, reasoning, secondary, error) of a model's answer.

    ``Intent:`` names an alias (another name is an error); without that line the
    first intent named anywhere counts. ``Confidence:`` lies in 0 to 1, 0.7 if it
    says no number; ``Reasoning:`` is one line, else the whole answer. ``Secondary:``
    lists ``intent:confidence`` pairs, of which those that reach the threshold
    stay. A confidence below the threshold is an error, and so is no answer.
    """
    low = F.lower(answer)
    said = F.regexp_extract(answer, ANSWER["intent"], 1)
    anywhere = F.lit(None).cast("string")
    for intent in reversed(INTENTS):
        anywhere = F.when(any_of(low, NAMED[intent]), intent).otherwise(anywhere)
    intent = F.when(said != "", intent_named(said)).otherwise(anywhere)
    number = F.regexp_extract(answer, ANSWER["confidence"], 1)
    confidence = clamped(F.coalesce(number.try_cast("double"), F.lit(UNSAID)))
    line = F.regexp_extract(answer, ANSWER["reasoning"], 1)
    reasoning = F.when(line != "", stripped(line)).otherwise(stripped(answer))
    listed = F.regexp_extract(answer, ANSWER["secondary"], 1)

    def pair(x: Column) -> Column:
        parts = F.split(stripped(x), ":", -1)
        return F.when(F.size(parts) == 2, F.struct(intent_named(stripped(F.get(parts, 0))).alias("intent"), clamped(stripped(F.get(parts, 1)).try_cast("double")).alias("confidence")))

    pairs = F.filter(F.transform(F.split(listed, ",", -1), pair), lambda p: p["intent"].isNotNull() & (p["confidence"] >= threshold))
    secondary = pairs if multi else F.array().cast("array<struct<intent:string,confidence:double>>")
    error = F.when(answer.isNull(), "service_unavailable").when((said != "") & intent.isNull(), "invalid_intent").when(intent.isNull(), "parse_error").when(confidence < threshold, "low_confidence")
    return F.struct(intent.alias("intent"), confidence.alias("confidence"), reasoning.alias("reasoning"), secondary.alias("secondary"), error.alias("error"))


def ruled(questions: DataFrame, question: str) -> DataFrame:
    """Adds ``answer`` in a model's form, from the signs a question holds: the intent with most, ties in the order of INTENTS.

    Step by step, so that signs are looked for once per question.
    """
    low = F.lower(F.col(question))
    counted = questions.withColumn("_n", F.array(*[sum((low.contains(x).cast("int") for x in SIGNS[i]), F.lit(0)) for i in INTENTS]))
    ranked = counted.withColumn("_total", F.aggregate("_n", F.lit(0), lambda a, x: a + x)).withColumn("_first", F.array_position("_n", F.array_max("_n")).cast("int"))
    shares = F.transform("_n", lambda n: F.when(n > 0, F.format_number(F.lit(0.5) + F.lit(0.4) * n / F.col("_total"), 2)))
    names = F.array(*map(F.lit, INTENTS))
    shared = ranked.withColumn("_share", shares)
    others = F.filter(F.transform("_share", lambda x, k: F.when(k + 1 != F.col("_first"), F.concat(F.get(names, k), F.lit(":"), x))), lambda x: x.isNotNull())
    first = F.element_at(names, F.col("_first"))
    sure = F.concat(F.lit("Intent: "), first, F.lit("\nConfidence: "), F.element_at("_share", F.col("_first")), F.lit("\nReasoning: signs of "), first, F.lit("\nSecondary: "), F.array_join(others, ", "))
    answer = F.when(F.col("_total") > 0, sure).otherwise(F.lit("Intent: explanation\nConfidence: 0.30\nReasoning: no signs"))
    return shared.withColumn("answer", answer).drop("_n", "_total", "_first", "_share")


def classified(questions: DataFrame, text: str = "text", model: Callable[[list[str]], list[str]] | None = None, threshold: float = THRESHOLD, multi: bool = False) -> DataFrame:
    """Adds intent, confidence, reasoning, secondary and error to rows of questions.

    Questions that are one after normalisation are asked once. Blank ones are an
    error of their own. Without a model rules answer. Rows with an error keep
    what was parsed; :func:`sure` drops them, as a batch does.
    """
    key = normal_query(F.coalesce(F.col(text), F.lit("")))
    rows = questions.withColumn("_key", key)
    once = rows.where("_key <> ''").groupBy("_key").agg(F.min(text).alias("_question"))
    answers = ruled(once, "_question") if model is None else asked(once, "_question", model)
    found = answers.select("_key", parsed(F.col("answer"), threshold, multi).alias("_p"))
    empty = F.when(F.col("_key") == "", "empty_query")
    made = rows.join(found, "_key", "left")
    return made.select(*questions.columns, *[F.col(f"_p.{c}").alias(c) for c in ("intent", "confidence", "reasoning", "secondary")], F.coalesce(empty, F.col("_p.error")).alias("error"))


def sure(rows: DataFrame) -> DataFrame:
    """The rows of :func:`classified` without an error."""
    return rows.where("error is null").drop("error")
