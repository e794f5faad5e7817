"""Inspection: the explanation of a note and the health of the population."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import code_unit_key
from recollect.operators.graph import degrees
from recollect.sources.views import STATUSES

# Ceilings that are part of the results.
RETURNED_TAGS, RETURNED_EDGES, MAX_POPULATION, MAX_INSPECTED, MAX_FINDINGS = 32, 32, 4096, 256, 128


def explained(notes: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: datetime, ids: tuple[str, ...] | None = None) -> DataFrame:
    """One row per note asked for (or all): its state at ``as_of``, first tags, degree and first relationships by edge id."""
    asked = notes.where(F.col("id").isin(*ids)) if ids is not None else notes
    at = F.lit(as_of).cast("timestamp_ntz")
    node = F.concat(F.lit("memory:"), F.col("id"))
    own = asked.select("id", node.alias("node"))
    sides = edges.select(F.col("id").alias("edge_id"), F.col("source").alias("node"), F.col("target").alias("adjacent"), "relationship", F.when(F.col("source") == F.col("target"), "self").otherwise("out").alias("direction")).unionByName(
        edges.where("source != target").select(F.col("id").alias("edge_id"), F.col("target").alias("node"), F.col("source").alias("adjacent"), "relationship", F.lit("in").alias("direction"))
    )
    by_edge = W.partitionBy("node").orderBy(code_unit_key(F.col("edge_id")))
    first = sides.join(own.select("node"), "node", "left_semi").withColumn("nth", F.row_number().over(by_edge)).where(F.col("nth") <= RETURNED_EDGES)
    shown = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "edge_id", "relationship", "direction", "adjacent"))).alias("l")).select("node", F.transform("l", lambda x: F.struct(x["edge_id"].alias("edge_id"), x["relationship"].alias("relationship"), x["direction"].alias("direction"), x["adjacent"].alias("adjacent"))).alias("relationships"))
    tags = F.slice(F.array_sort("tags"), 1, RETURNED_TAGS)
    return (
        asked.withColumn("node", node)
        .join(degrees(edges), "node", "left")
        .join(shown, "node", "left")
        .join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("there")), "node", "left")
        .select(
            "id",
            "status",
            "category",
            tags.alias("tags"),
            F.size("tags").alias("tags_known"),
            "confidence",
            F.coalesce(F.col("expires_at") <= at, F.lit(False)).alias("expired"),
            F.coalesce("there", F.lit(False)).alias("node_present"),
            F.coalesce("degree", F.lit(0)).alias("known_count"),
            F.coalesce(F.size("relationships"), F.lit(0)).alias("returned_count"),
            "relationships",
        )
    )


def note_health(notes: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: datetime) -> DataFrame:
    """One row per note: expiry, graph presence, degree and broken invariants."""
    at = F.lit(as_of).cast("timestamp_ntz")
    node = F.concat(F.lit("memory:"), F.col("id"))
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid-status"),
            F.when(~F.coalesce((F.col("confidence") >= 0) & (F.col("confidence") <= 1) & ~F.isnan("confidence"), F.lit(False)), "invalid-confidence"),
            F.when(F.col("created_at").isNull() | F.col("updated_at").isNull(), "invalid-timestamp"),
        )
    )
    return (
        notes.withColumn("node", node)
        .join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("there")), "node", "left")
        .join(degrees(edges), "node", "left")
        .select("id", "status", F.coalesce(F.col("expires_at") <= at, F.lit(False)).alias("expired"), F.col("there").isNull().alias("missing_node"), (F.col("there").isNotNull() & F.col("degree").isNull()).alias("isolated"), errors.alias("errors"))
    )


def health_counts(health: DataFrame) -> DataFrame:
    """One row: notes by state, expired, without node, isolated, and broken invariants; a note may count in several."""
    return health.agg(
        F.count(F.lit(1)).alias("known"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if("expired").alias("expired"),
        F.count_if("missing_node").alias("missing_nodes"),
        F.count_if("isolated").alias("isolated"),
        F.count_if(F.size("errors") > 0).alias("failing"),
    )


def health_report(health: DataFrame) -> DataFrame:
    """Counts with coverage, observations and suggestions. Above the population ceiling nothing counts as inspected."""
    seen = [F.when(F.col("known") > MAX_POPULATION, "population-work-limit"), F.when(F.col("known").between(MAX_INSPECTED + 1, MAX_POPULATION), "note-output-limit")]
    inspected = F.when(F.col("known") > MAX_POPULATION, 0).otherwise(F.least("known", F.lit(MAX_INSPECTED)))
    notable = [("expired", "expired-notes"), ("missing_nodes", "missing-graph-nodes"), ("isolated", "isolated-notes")]
    return health_counts(health).select(
        "*",
        inspected.alias("inspected"),
        (inspected == F.col("known")).alias("complete"),
        F.array_compact(F.array(*seen)).alias("reasons"),
        F.array_compact(F.array(*[F.when(F.col(c) > 0, name) for c, name in notable])).alias("observations"),
        F.array_compact(F.array(F.when(F.col("expired") > 0, "review-expired-notes"), F.when((F.col("missing_nodes") > 0) | (F.col("isolated") > 0), "consider-note-links"))).alias("suggestions"),
    )


def health_findings(health: DataFrame, limit: int = MAX_FINDINGS) -> DataFrame:
    """``id, error`` of the first broken invariants by id."""
    return health.select("id", F.explode("errors").alias("error")).orderBy(code_unit_key(F.col("id")), "error").limit(limit)
