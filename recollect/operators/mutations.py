"""Mutations of the store as dataflow: each takes the tables and gives the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import clamp01, code_unit_key, strip_white
from recollect.operators.validate import normal_relations


class MutationError(ValueError):
    """The mutation is not allowed; ``code`` says why."""

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


def new_notes(raw: DataFrame, at: Column) -> DataFrame:
    """Notes to add: trimmed content, defaults, scores within 0..1; blank content is left out."""
    return raw.where(strip_white(F.col("content")) != "").select(
        "id",
        strip_white(F.col("content")).alias("content"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "category",
        F.coalesce("source", F.lit("user")).alias("source"),
        F.coalesce(clamp01(F.col("importance")), F.lit(0.5)).alias("importance"),
        F.coalesce(clamp01(F.col("confidence")), F.lit(0.75)).alias("confidence"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.coalesce("status", F.lit("active")).alias("status"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def new_entries(raw: DataFrame, at: Column) -> DataFrame:
    """Diary entries to add: trimmed content, defaults; blank content is left out."""
    body = strip_white(F.col("content"))
    return raw.where(body != "").select("id", body.alias("content"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), at.alias("created_at"), at.alias("updated_at"))


def patched(notes: DataFrame, patches: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Notes or diary entries after ``patches`` (id and the changed columns, null for unchanged), and the patches refused: ``id, code``.

    A patch of an unknown record is NOT_FOUND, one to a blank content INVALID_INPUT; one that changes the content of a pinned note is CONFLICT.
    """
    columns = [c for c in patches.columns if c != "id"]
    if "content" in columns:
        patches = patches.withColumn("content", strip_white(F.col("content")))
    p = patches.select("id", F.lit(True).alias("__p"), *[F.col(c).alias(f"__{c}") for c in columns])
    blank = F.coalesce(F.col("__content") == "", F.lit(False)) if "content" in columns else F.lit(False)
    guard = F.col("pinned") & F.coalesce(F.col("__content") != F.col("content"), F.lit(False)) if "content" in columns and "pinned" in notes.columns else F.lit(False)
    both = notes.join(p, "id", "left").withColumn("__no", F.when(guard, "CONFLICT").when(blank, "INVALID_INPUT"))
    use = F.col("__p").isNotNull() & F.col("__no").isNull()
    new = {c: F.when(use, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    out = both.select(*[(new[c] if c in new else F.when(use, at).otherwise(F.col(c)) if c == "updated_at" else F.col(c)).alias(c) for c in notes.columns])
    refused = both.where("__p and __no is not null").select("id", F.col("__no").alias("code"))
    absent = patches.select("id").join(notes.select("id"), "id", "left_anti").select("id", F.lit("NOT_FOUND").alias("code"))
    return out, refused.unionByName(absent)


def promoted(notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates among ``ids`` become active; others are refused: NOT_FOUND or CONFLICT."""
    asked = ids.select("id", F.lit(True).alias("__p"))
    both = notes.join(asked, "id", "left")
    out = both.withColumn("status", F.when(F.col("__p") & (F.col("status") == "candidate"), "active").otherwise(F.col("status"))).select(*notes.columns)
    refused = both.where("__p and status != 'candidate'").select("id", F.lit("CONFLICT").alias("code"))
    absent = ids.select("id").join(notes.select("id"), "id", "left_anti").select("id", F.lit("NOT_FOUND").alias("code"))
    return out, refused.unionByName(absent)


def deleted(records: DataFrame, nodes: DataFrame, edges: DataFrame, ids: DataFrame, kind: str = "memory") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, nodes and edges without ``ids``, their graph nodes and every edge that touches these."""
    gone = ids.select(F.concat(F.lit(f"{kind}:"), "id").alias("node"))
    left = edges
    for end in ("source", "target"):
        left = left.join(gone.withColumnRenamed("node", end), end, "left_anti")
    return records.join(ids.select("id"), "id", "left_anti"), nodes.join(gone.withColumnRenamed("node", "id"), "id", "left_anti"), left.select(*edges.columns)


def expired_ids(notes: DataFrame, at: Column, force: bool = False) -> DataFrame:
    """Ids of notes expired at ``at``; pinned ones only with ``force``."""
    ok = F.col("expires_at") <= at
    return notes.where(ok if force else ok & ~F.col("pinned")).select("id")


def upserted_nodes(nodes: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """Nodes with ``incoming`` (id and ``ord``): the first wins when added, the last when ensured."""
    by = W.partitionBy("id").orderBy(F.col("ord").desc() if overwrite else F.col("ord").asc())
    every = nodes.withColumn("ord", F.lit(-1)).unionByName(incoming, allowMissingColumns=True)
    return every.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n", "ord")


def added_edges(edges: DataFrame, nodes: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with those of ``incoming`` that may be added, and the others with a code.

    Both ends must exist (NOT_FOUND); an id or directed pair in use, or used earlier among ``incoming``, is a CONFLICT.
    """
    by_pair, by_id = W.partitionBy("source", "target").orderBy(code_unit_key(F.col("id"))), W.partitionBy("id").orderBy("source", "target")
    df = normal_relations(incoming).withColumns({"__pair": F.row_number().over(by_pair) > 1, "__id": F.row_number().over(by_id) > 1})
    for end in ("source", "target"):
        df = df.join(nodes.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    df = df.join(edges.select("id", F.lit(True).alias("__used")), "id", "left").join(edges.select("source", "target", F.lit(True).alias("__taken")), ["source", "target"], "left")
    code = F.when(F.col("__source").isNull() | F.col("__target").isNull(), "NOT_FOUND").when(F.col("__pair") | F.col("__id") | F.col("__used").isNotNull() | F.col("__taken").isNotNull(), "CONFLICT")
    df = df.withColumn("code", code)
    ok = df.where("code is null").select("id", "source", "target", "relationship")
    return edges.select("id", "source", "target", "relationship").unionByName(ok), df.where("code is not null").select("id", "code")


def foundation_links(notes: DataFrame, diary: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to derive from provenance: ``source, target, relationship`` for each diary parent that exists and is not linked yet."""
    parent = strip_white(F.col("provenance.parentDiaryId"))
    wanted = notes.select(F.concat(F.lit("memory:"), "id").alias("source"), F.regexp_replace(parent, "^diary:", "").alias("parent")).where("parent != ''")
    wanted = wanted.join(diary.select(F.col("id").alias("parent")), "parent", "left_semi")
    new = wanted.select("source", F.concat(F.lit("diary:"), "parent").alias("target")).distinct()
    return new.join(edges.select("source", "target"), ["source", "target"], "left_anti").withColumn("relationship", F.lit("derived_from"))


def touched(identity: DataFrame, at: Column) -> DataFrame:
    """The identity row with its last activity moved to ``at``."""
    return identity.withColumn("last_active", at)
