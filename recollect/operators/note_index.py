"""A written index of notes: tokens once, and postings by token.

Tokenizing a corpus costs more than any query over it, so an index is built once and opened by every later session. ``notes`` holds each
note once with its token columns, ordered by id. ``postings`` holds a row for each token of a note, in folders by a hash of the token and
ordered by token within, so a query reads the few row groups of its own tokens. ``tokens`` counts the notes of each token. A query whose tokens
are rare fetches the notes its postings name; one with a token of many notes reads the token columns of all, which is less
work then. Both give the same rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import query_tokens
from recollect.operators.retrieval import Query, direct_matches, note_index, top_matches
from recollect.session import delete_path, freeing_shuffles, last_manifest, publish_manifest

NOTES_PER_SLOT, MOST_SLOTS = 100_000, 4096
FEW = 16


@dataclass
class NoteIndex:
    """Use ``build`` or ``open``."""

    spark: SparkSession
    root: str
    version: str
    slots: int
    n_notes: int

    @classmethod
    def build(cls, notes: DataFrame, root: str) -> NoteIndex:
        """Index ``notes`` below ``root`` as a new version, publish it, then delete the one before."""
        spark = notes.sparkSession
        number, before = last_manifest(spark, root) or (0, None)
        version = f"index-{uuid.uuid4().hex[:12]}"
        at = f"{root}/{version}"
        with freeing_shuffles(spark):
            note_index(notes).dropDuplicates(["id"]).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{at}/notes")
            stored = spark.read.parquet(f"{at}/notes")
            n = stored.count()
            slots = min(max(-(-n // NOTES_PER_SLOT), 4), MOST_SLOTS)
            each = F.explode(F.array_distinct(F.concat("tokens", "tag_tokens", "metadata_tokens")))
            postings = stored.select(each.alias("token"), "id").withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(slots)).cast("int"))
            # A slot is many tasks' work, by id, as one token may be in all notes.
            postings.repartition("slot", F.pmod(F.xxhash64("id"), F.lit(slots))).sortWithinPartitions("slot", "token", "id").write.partitionBy("slot").parquet(f"{at}/postings")
            counts = spark.read.parquet(f"{at}/postings").groupBy("token").agg(F.count(F.lit(1)).alias("n_notes"))
            counts.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{at}/tokens")
        publish_manifest(spark, root, number + 1, {"version": version, "slots": slots, "n_notes": n})
        if before:
            delete_path(spark, f"{root}/{before['version']}")
        return cls(spark, root, version, slots, n)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> NoteIndex:
        """The index published below ``root``."""
        last = last_manifest(spark, root)
        if last is None:
            raise ValueError("NOT_FOUND: there is no index")
        return cls(spark, root, **last[1])

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version}/{part}")

    def notes(self) -> DataFrame:
        """The indexed notes; they serve wherever ``note_index`` does."""
        return self._read("notes")

    def holding(self, tokens: list[str]) -> DataFrame:
        """``id`` of the notes that hold any of ``tokens``."""
        slots = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.slots)).alias(f"s{i}") for i, t in enumerate(tokens)]).first()
        return self._read("postings").where(F.col("slot").isin(sorted(set(slots))) & F.col("token").isin(tokens)).select("id").distinct()

    def candidates(self, query: Query) -> DataFrame:
        """Indexed notes among which all matches of ``query`` are: those its postings name where they are few, else all."""
        q = sorted(set(query_tokens(query.text)))
        if not q:
            return self.notes()
        held = self._read("tokens").where(F.col("token").isin(q)).agg(F.coalesce(F.sum("n_notes"), F.lit(0))).first()[0]
        if held * FEW > self.n_notes:
            return self.notes()
        ids = self.holding(q)
        if query.explicit_ids:
            ids = ids.unionByName(self.notes().where(F.col("id").isin(*query.explicit_ids)).select("id")).distinct()
        return self.notes().join(ids, "id", "left_semi")

    def query(self, query: Query) -> DataFrame:
        """The ranked matches of a query."""
        return top_matches(direct_matches(self.candidates(query), query), query.limit)
