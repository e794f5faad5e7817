"""Validation of store rows: codes per row for notes, diary entries, nodes and edges, and referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.operators.portable import SOURCES
from recollect.sources.views import RELATIONS, STATUSES


def _unit(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | ((x >= 0) & (x <= 1) & ~F.isnan(x))


def _object(c: str) -> Column:
    return F.col(c).isNull() | F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def _coded(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), field) for field, ok in checks]))
    return df.select("id", errors.alias("fields"))


def invalid_notes(notes: DataFrame) -> DataFrame:
    """``id, fields``: notes that no store accepts, with the fields at fault."""
    coded = _coded(
        notes,
        [
            ("content", F.col("content").isNotNull()),
            ("tags", F.col("tags").isNull() | ~F.exists("tags", lambda t: t.isNull())),
            ("source", F.col("source").isNull() | F.col("source").isin(*SOURCES)),
            ("status", F.col("status").isNull() | F.col("status").isin(*STATUSES)),
            ("importance", _unit("importance")),
            ("confidence", _unit("confidence")),
            ("metadata", _object("metadata")),
            ("createdAt", F.col("created_at").isNotNull()),
            ("updatedAt", F.col("updated_at").isNotNull()),
        ],
    )
    # Repeats are sought among ids and codes, without the texts.
    once = F.col("id").isNotNull() & (F.col("id") != "") & (F.count(F.lit(1)).over(W.partitionBy("id")) == 1)
    fields = F.when(F.coalesce(once, F.lit(False)), F.col("fields")).otherwise(F.concat(F.array(F.lit("id")), "fields"))
    return coded.select("id", fields.alias("fields")).where(F.size("fields") > 0)


def invalid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, fields``: edges with a missing end, a directed pair used before, or data that is no object."""
    pair = F.count(F.lit(1)).over(W.partitionBy("source", "target"))
    df = edges.withColumn("__pair", pair)
    for end in ("source", "target"):
        df = df.join(nodes.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    coded = _coded(df, [("source", F.col("__source")), ("target", F.col("__target")), ("pair", F.col("__pair") == 1), ("data", _object("data"))])
    return coded.where(F.size("fields") > 0)


def normal_relations(edges: DataFrame) -> DataFrame:
    """Edges with a relation of the vocabulary; another one is kept beside ``related_to`` as ``raw_relation``."""
    known = F.coalesce(F.col("relationship").isin(*RELATIONS), F.lit(False))
    return edges.withColumns({"raw_relation": F.when(~known, F.col("relationship")), "relationship": F.when(known, F.col("relationship")).otherwise("related_to")})


def elided(notes: DataFrame) -> DataFrame:
    """Notes with values equal to their defaults as null, as they are stored."""
    return notes.select(
        "id",
        F.nullif("status", F.lit("active")).alias("status"),
        F.nullif("importance", F.lit(0.5)).alias("importance"),
        F.nullif("confidence", F.lit(0.75)).alias("confidence"),
        F.when(F.col("pinned"), True).alias("pinned"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
    )


def hydrated(stored: DataFrame) -> DataFrame:
    """The inverse of ``elided``."""
    return stored.select(
        "id",
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.coalesce("confidence", F.lit(0.75)).alias("confidence"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
