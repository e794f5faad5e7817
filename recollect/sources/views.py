"""The store's tables in normal form: one row per id, defaults filled in, states and scores within their domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import clamp01, strip_white
from recollect.sources.tables import records, table

# States of a note, and the relation vocabulary.
STATUSES = ("candidate", "active", "archived", "rejected")
RELATIONS = ("related_to", "mentions", "derived_from", "supports", "prefers", "worked_on", "part_of", "about")


def notes(spark: SparkSession, root: str, once: bool = True) -> DataFrame:
    """Notes; unknown states are active, scores default to 0.5 and 0.75.

    Without ``once`` redelivered rows stay, for operators that select first and drop repeats among the few rows left.
    """
    status = F.lower(strip_white(F.col("status")))
    category = F.lower(strip_white(F.col("category")))
    df = records(spark, root, "memory_notes") if once else table(spark, root, "memory_notes")
    return df.select(
        "id",
        F.coalesce("content", F.lit("")).alias("content"),
        "summary",
        F.when(category != "", category).alias("category"),
        F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tags"),
        "source",
        "provenance",
        F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.75).otherwise(clamp01(F.col("confidence"))).alias("confidence"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.when(status.isin(*STATUSES), status).otherwise("active").alias("status"),
        "created_at",
        "updated_at",
        "expires_at",
        "metadata",
    )


def diary(spark: SparkSession, root: str, once: bool = True) -> DataFrame:
    """Diary entries; ``once`` as for notes."""
    df = records(spark, root, "diary_entries") if once else table(spark, root, "diary_entries")
    return df.select(
        "id", F.coalesce("content", F.lit("")).alias("content"), F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tags"), "created_at", "updated_at", "metadata"
    )


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Graph edges with the stored relation."""
    return records(spark, root, "graph_edges").select("id", "source", "target", "relationship", "data")


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """Graph nodes: the ends of edges, with the type their id names."""
    e = edges(spark, root)
    ends = e.select(F.col("source").alias("id")).unionAll(e.select("target")).distinct()
    return ends.select("id", F.substring_index("id", ":", 1).alias("type"))


#: The same views in the checking SQL.
VIEWS_SQL = r"""
notes as (select distinct id, coalesce(content, '') as content, summary, nullif(lower(regexp_replace(category, '^\s+|\s+$', '', 'g')), '') as category,
    list_filter(coalesce(tags, []), lambda t: t is not null) as tags, source, provenance, coalesce(importance, 0.5::double) as importance,
    case when confidence is null or isnan(confidence) then 0.75::double else greatest(0::double, least(1::double, confidence)) end as confidence,
    coalesce(pinned, false) as pinned,
    case when lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) in ('candidate', 'active', 'archived', 'rejected') then lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) else 'active' end as status,
    created_at, updated_at, expires_at, metadata from memory_notes),
diary as (select distinct id, coalesce(content, '') as content, list_filter(coalesce(tags, []), lambda t: t is not null) as tags, created_at, updated_at, metadata from diary_entries),
edges as (select distinct id, source, target, relationship, data from graph_edges),
nodes as (select id, split_part(id, ':', 1) as type from (select source as id from edges union select target from edges))
"""

TOKENS_SQL = r"regexp_extract_all(lower(nfc_normalize({0})), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')"
