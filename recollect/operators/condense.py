"""Rule-based condensation of text into facts, summary, tags, category and confidence, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import cut_units, phrase, strip_white, tokens, units

# Category rules, the first that matches wins.
CATEGORY_RULES = (
    ("project", ("project", "build", "built", "shipped", "release", "version", "code", "library", "app", "deploy", "feature", "refactor")),
    ("preference", ("prefer", "like", "favourite", "favorite", "want", "love", "hate", "dislike", "wish", "rather")),
    ("task", ("task", "todo", "plan", "need", "must", "schedule", "deadline", "assign", "follow")),
    ("learning", ("learned", "learnt", "study", "studied", "read", "tutorial", "course", "lesson", "research", "figured")),
    ("event", ("meeting", "met", "call", "happened", "event", "attended", "visited", "trip")),
)


@dataclass(frozen=True)
class Limits:
    facts: int = 5
    fact_min: int = 8
    fact_max: int = 240
    summary: int = 200
    tags: int = 8


def sentences(text: Column) -> Column:
    """Parts ended by ``.``, ``!`` or ``?`` before white space, or by line breaks; inner white space squeezed."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: strip_white(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > 0)


def key_facts(text: Column, limits: Limits = Limits()) -> Column:
    """The first sentences of fitting length in UTF-16 code units, one per normal phrase."""
    fitting = F.filter(sentences(text), lambda s: units(s).between(limits.fact_min, limits.fact_max))
    keyed = F.transform(fitting, lambda s: F.struct(phrase(tokens(s, compose=False)).alias("k"), s.alias("s")))
    start = F.array().cast("array<struct<k:string,s:string>>")
    known = lambda acc, x: F.exists(acc, lambda y: y["k"] == x["k"])
    once = F.aggregate(keyed, start, lambda acc, x: F.when((x["k"] == "") | (F.size(acc) >= limits.facts) | known(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(once, lambda x: x["s"])


def derived_tags(toks: Column, limit: int = Limits.tags) -> Column:
    """The first distinct tokens in order."""
    return F.slice(F.array_sort(F.array_distinct(toks)), 1, limit)


def category(toks: Column) -> Column:
    """The first rule one of whose words occurs; null if none does."""
    found = None
    for name, words in CATEGORY_RULES:
        hit = F.arrays_overlap(toks, F.array(*map(F.lit, words)))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def summary(text: Column, limit: int = Limits.summary) -> Column:
    """The trimmed text, cut to ``limit`` UTF-16 code units with dots; half a character is left out."""
    t = strip_white(text)
    return F.when(units(t) <= limit, t).otherwise(F.concat(cut_units(t, max(0, limit - 3)), F.lit("...")))


def confidence(facts: Column, kind: Column, tags: Column, linked: Column, limits: Limits = Limits()) -> Column:
    """Sum of rule contributions in a fixed order, within 0..1."""
    parts = (F.lit(0.4), F.when(F.size(facts) > 0, 0.1).otherwise(0.0), F.least(F.size(facts), F.lit(limits.facts)) * F.lit(0.02), F.when(kind.isNotNull(), 0.1).otherwise(0.0), F.when(F.size(tags) > 0, 0.05).otherwise(0.0), F.when(linked, 0.1).otherwise(0.0))
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def condensed(df: DataFrame, text: str = "content", parent: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """``df`` with ``key_facts, summary, tags, category, confidence, provenance_kind``; blank texts are left out."""
    linked = parent.isNotNull() if parent is not None else F.lit(False)
    return (
        df.where(F.length(strip_white(F.col(text))) > 0)
        .withColumn("__toks", tokens(F.col(text)))
        .withColumns({"key_facts": key_facts(F.col(text), limits), "summary": summary(F.col(text), limits.summary), "tags": derived_tags(F.col("__toks"), limits.tags), "category": category(F.col("__toks"))})
        .withColumns({"confidence": confidence(F.col("key_facts"), F.col("category"), F.col("tags"), linked, limits), "provenance_kind": F.when(linked, "diary_extract").otherwise("condensed")})
        .drop("__toks")
    )


def as_candidate_notes(analysis: DataFrame) -> DataFrame:
    """Candidate notes to commit from an analysis: the summary is the content, written by the machine."""
    return analysis.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("\n", "id", "summary"), 256), 1, 16)).alias("id"),
        F.col("summary").alias("content"),
        "summary",
        "category",
        "tags",
        F.lit("ai").alias("source"),
        F.lit("candidate").alias("status"),
        "confidence",
        "provenance_kind",
        F.col("id").alias("parent_id"),
    )
