"""References to records that do not exist (problem 7).

Parent ids become integers: an id is a stem and a tail of up to 15 hexadecimal digits, ``(stem, tail length, integer)``,
which is one-to-one. Sorted parent integers are compressed into contiguous runs within blocks of 4,096 values, so a run
holds at most that many arrival times. Each distinct referenced key is as-of matched to the last run start at or below it;
a key beyond the run's end names no parent. References are pre-aggregated to distinct keys first, so a parent named by a third of
all notes is one row in the match; only keys with a problem are joined back to the references, those of hot parents salted.

Defined results: null and blank references are no references; a parent row stored twice counts once; a note with a null
``created_at`` gives a null period; one with a null ``ingested_at`` is never late; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import strip_white
from recollect.operators.skew import HOT_ROWS, hot_of, spread_join
from recollect.session import materialize

BLOCK_BITS = 12
SPACE = ["kind", "stem", "tail", "block"]


@dataclass(frozen=True)
class ParentField:
    """A provenance field, the kind of record it names, and the graph prefix that may precede the id."""

    field: str
    kind: str
    prefix: str | None


FIELDS = (ParentField("parentNoteId", "note", "memory:"), ParentField("parentDiaryId", "diary", "diary:"), ParentField("parentEdgeId", "edge", None))


def with_key(df: DataFrame, ref: str = "id") -> DataFrame:
    """Adds ``stem, tail, block, key``: the id as an integer within its family of ids."""
    digits = F.regexp_extract(F.col(ref), r"([0-9a-f]{0,15})$", 1)
    tail = F.length(digits)
    key = F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    stem = F.expr(f"left({ref}, length({ref}) - length(regexp_extract({ref}, '([0-9a-f]{{0,15}})$', 1)))")
    return df.withColumns({"stem": stem, "tail": tail, "key": key}).withColumn("block", F.shiftright("key", BLOCK_BITS))


def parent_runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs of the ids of ``parents(kind, id, ingested_at)``: start, end and the arrival time of each key."""
    keyed = with_key(parents).groupBy(*SPACE, "key").agg(F.min("ingested_at").alias("ingested_at"))
    island = F.col("key") - F.row_number().over(W.partitionBy(*SPACE).orderBy("key"))
    return (
        keyed.withColumn("island", island)
        .groupBy(*SPACE, "island")
        .agg(F.min("key").alias("key"), F.max("key").alias("run_end"), F.array_sort(F.collect_list(F.struct("key", "ingested_at"))).alias("times"))
        .select(*SPACE, "key", "run_end", F.col("times.ingested_at").alias("times"))
    )


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of ``keys(kind, stem, tail, block, key, ...)``: adds ``found`` and the parent's ``parent_at``."""
    rest = [c for c in keys.columns if c not in (*SPACE, "key")]
    marks = runs.select(*SPACE, "key", F.lit(0).alias("side"), F.struct("key", "run_end", "times").alias("run"))
    asked = keys.select("*", F.lit(1).alias("side"))
    upto = W.partitionBy(*SPACE).orderBy("key", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = F.col("run")
    return (
        marks.unionByName(asked, allowMissingColumns=True)
        .withColumn("run", F.last("run", ignorenulls=True).over(upto))
        .where("side = 1")
        .withColumn("found", F.coalesce(run["run_end"] >= F.col("key"), F.lit(False)))
        .withColumn("parent_at", F.when(F.col("found"), F.get(run["times"], (F.col("key") - run["key"]).cast("int"))))
        .select(*SPACE, "key", *rest, "found", "parent_at")
    )


def reference_id(value: Column, prefix: str | None) -> Column:
    """The id a reference names: without white space at the ends and without the graph prefix."""
    v = strip_white(value)
    return strip_white(F.when(v.startswith(prefix), F.substr(v, F.lit(len(prefix) + 1))).otherwise(v)) if prefix else v


def references_of(notes: DataFrame) -> DataFrame:
    """One row per note and non-blank parent field: ``note_id, field, kind, ref, note_at, period``."""
    each = F.array(*[F.struct(F.lit(f.field).alias("field"), F.lit(f.kind).alias("kind"), reference_id(F.col(f"provenance.{f.field}"), f.prefix).alias("ref")) for f in FIELDS])
    return (
        notes.select(F.col("id").alias("note_id"), F.col("ingested_at").alias("note_at"), F.date_format("created_at", "yyyy-MM").alias("period"), F.explode(each).alias("r"))
        .select("note_id", "r.field", "r.kind", "r.ref", "note_at", "period")
        .where("ref != ''")
    )


def dangling_references(notes: DataFrame, diary: DataFrame, edges: DataFrame, removals: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``note_id, field, reason, period`` of each reference whose parent is missing, removed or came in after the note."""
    parents = None
    for kind, df in (("note", notes), ("diary", diary), ("edge", edges)):
        part = df.where("id is not null").select(F.lit(kind).alias("kind"), "id", "ingested_at")
        parents = part if parents is None else parents.unionByName(part)
    refs = references_of(notes)
    asked = materialize(with_key(refs.groupBy("kind", "ref").agg(F.min("note_at").alias("first_at"), F.count(F.lit(1)).alias("n_rows")), "ref"), "references")
    matched = match_runs(asked.select(*SPACE, "key", "ref", "first_at"), parent_runs(parents))
    problem = matched.where("not found or parent_at > first_at").select("kind", "ref", "found", "parent_at")
    removed = removals.where("id is not null").select("kind", F.col("id").alias("ref"), F.lit(True).alias("was_removed")).distinct()
    problem = problem.join(removed, ["kind", "ref"], "left")
    reason = F.when(F.col("found"), F.when(F.col("parent_at") > F.col("note_at"), "late")).when(F.col("was_removed"), "removed").otherwise("missing")
    hot = hot_of(asked, ["kind", "ref"], hot_rows)
    return spread_join(refs, problem, ["kind", "ref"], "note_id", hot, rows_per_salt=hot_rows).select("note_id", "field", reason.alias("reason"), "period").where("reason is not null").distinct()


def dangling_report(dangling: DataFrame) -> DataFrame:
    """Dangling references counted by field, reason and month."""
    return dangling.groupBy("field", "reason", "period").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("note_id").alias("n_notes"))
