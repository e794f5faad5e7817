"""Duplicates hidden by formatting differences (problem 1).

The canonical key of a note is a digest of its content and its tag set, each reduced to letters and digits in lower case.
Keys are written once. Hot keys are found exactly: map-side partial counts by key, then the largest groups of ``hot_rows`` rows or more, at
most 8,192 of them, which are broadcast. Their rows get a salt, all others salt 0, before anything is shuffled by key; one shuffle by (key,
salt) sorts each group by id, where a streaming window yields the first id. Hot keys then take the least of their salts' first ids in
a second level.

Defined results: null content and content without a letter or digit belong to no group; null ``tags`` equals no tags, null or
blank tags and tags left with nothing are dropped; a redelivered row is the same note and no copy; ties cannot occur as ids
differ; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import letters_digits
from recollect.operators.skew import hot_groups, salt_of
from recollect.session import materialize

HOT_ROWS = 20_000


def canonical_keys(notes: DataFrame) -> DataFrame:
    """``note_id, key`` of each note row whose content has a letter or digit."""
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), letters_digits), lambda t: t.isNotNull() & (F.length(t) > 0))))
    return (
        notes.where("id is not null")
        .select(F.col("id").alias("note_id"), letters_digits(F.col("content")).alias("plain"), tags.alias("tag_set"))
        .where(F.length("plain") > 0)
        .select("note_id", F.unhex(F.md5(F.concat_ws("\n", F.col("plain"), F.array_join("tag_set", "\n")))).alias("key"))
    )


def _salted(notes: DataFrame, hot_rows: int) -> DataFrame:
    """``note_id, key, is_hot, salt`` of each note, from keys computed and written once."""
    keyed = materialize(canonical_keys(notes), "canonical-keys")
    hot = hot_groups(keyed, ["key"], hot_rows)
    return keyed.join(hot, "key", "left").select("note_id", "key", F.col("n_rows").isNotNull().alias("is_hot"), salt_of(F.col("note_id"), F.col("n_rows"), hot_rows).alias("salt"))


def _with_first(salted: DataFrame) -> DataFrame:
    """Notes with the first id of their (key, salt), redelivered rows gone."""
    group = W.partitionBy("key", "salt").orderBy("note_id")
    marked = salted.withColumns({"first_id": F.first("note_id").over(group), "again": F.lag("note_id").over(group).eqNullSafe(F.col("note_id"))})
    return marked.where("not again").drop("again")


def format_copies(notes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``first_id, note_id`` for each note that is not the smallest id of its group."""
    salted = _salted(notes, hot_rows)
    by_salt = salted.where("is_hot").groupBy("key", "salt").agg(F.min("note_id").alias("first_id"))
    least = by_salt.groupBy("key").agg(F.min("first_id").alias("least_id"))  # a row per hot key, at most MOST_HOT
    first = _with_first(salted).join(F.broadcast(least), "key", "left").withColumn("first_id", F.coalesce("least_id", "first_id"))
    return first.where("first_id != note_id").select("first_id", "note_id")


def collapsed_notes(notes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``note_id, n_copies``: each note once, by its smallest id, with the number of ids that hold it.

    Two levels for all groups: counts by (key, salt), then by key, where only the hot keys have more than one partial.
    """
    partial = _with_first(_salted(notes, hot_rows)).groupBy("key", "salt").agg(F.min("note_id").alias("note_id"), F.count(F.lit(1)).alias("n"))
    return partial.groupBy("key").agg(F.min("note_id").alias("note_id"), F.sum("n").alias("n_copies")).select("note_id", "n_copies")
