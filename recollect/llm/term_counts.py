"""Frequency of every distinct value or term (problem 2).

Counts live in a partitioned store and change by signed deltas. A batch of record images (before, after) is compared by id; only
added, changed and deleted records are expanded into terms: +1 for each occurrence after, -1 for each before, and the same
once per record. Deltas are summed by term with map-side combine, so a term held by a third of all records is one partial row per
task, and merged into the touched partitions of the store, which are written as a new version.

Defined results: a term is lower case without white space at its ends; null and blank terms and null arrays count nothing, their
records still count in the total; a redelivered row is one record; an emptied term leaves the store; empty tables give no rows.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import term_of
from recollect.session import delete_path, freeing_shuffles, last_manifest, materialize, publish_manifest, scratch_path

RARE_RECORDS = 3
COMMON_SHARE = (1, 10)
TOTAL = "#records"


def record_image(df: DataFrame, fields: dict[str, Column], table: str) -> DataFrame:
    """``id, image``: per record the terms (repeats kept) of each named field; arrays of strings, or null."""
    terms = [
        F.transform(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), term_of), lambda t: t.isNotNull()), functools.partial(lambda n, t: F.struct(F.lit(n).alias("field"), t.alias("term")), name))
        for name, c in fields.items()
    ]
    total = F.array(F.struct(F.lit(TOTAL).alias("field"), F.lit(table).alias("term")))
    return df.where("id is not null").select("id", F.array_sort(F.concat(total, *terms)).alias("image")).dropDuplicates(["id"])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, old, new`` of two sets of record images; a record added has no ``old``, one deleted no ``new``."""
    return before.select("id", F.col("image").alias("old")).join(after.select("id", F.col("image").alias("new")), "id", "full_outer")


def additions(after: DataFrame) -> DataFrame:
    """The changes of records that were never there: no join is needed."""
    return after.select("id", F.lit(None).cast(after.schema["image"].dataType).alias("old"), F.col("image").alias("new"))


def signed_deltas(changed: DataFrame) -> DataFrame:
    """``field, term, d_occurrences, d_records`` of changes ``id, old, new``; unchanged records give nothing.

    Images are sorted, so a term's first occurrence in a record is the one that differs from its neighbour before.
    """
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("image"))))
    each = F.posexplode("s.image").alias("i", "x")
    here = changed.where(~F.col("old").eqNullSafe(F.col("new"))).select(sides.alias("s")).select("s.sign", "s.image", each)
    is_first = (F.col("i") == 0) | (F.col("x") != F.get("image", F.col("i") - 1))
    return (
        here.select("sign", "x", is_first.alias("is_first"))
        .groupBy(F.col("x.field").alias("field"), F.col("x.term").alias("term"))
        .agg(F.sum("sign").cast("bigint").alias("d_occurrences"), F.sum(F.when(F.col("is_first"), F.col("sign")).otherwise(0)).cast("bigint").alias("d_records"))
        .where("d_occurrences != 0 or d_records != 0")
    )


@dataclass
class TermCounts:
    """Persistent counts in ``buckets`` partitions by term; ``current`` names the version folder of each written bucket.

    Each version is published with a manifest below ``root``, from which ``open`` goes on in a later session. It holds the number of the last
    batch too, so a batch given again changes nothing.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    current: dict[int, str] = field(default_factory=dict)
    version: int = 0
    last_batch: int = -1

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 16) -> TermCounts:
        return cls(spark, scratch_path(spark, "term-counts"), buckets)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> TermCounts:
        """The counts published below ``root``; none yet gives empty counts."""
        last = last_manifest(spark, root)
        if last is None:
            return cls(spark, root)
        version, m = last
        return cls(spark, root, m["buckets"], {int(b): f"{root}/{p}" for b, p in m["current"].items()}, version, m["last_batch"])

    def read(self, only: list[int] | None = None) -> DataFrame:
        """``field, term, n_occurrences, n_records`` of the current version."""
        paths = [p for b, p in sorted(self.current.items()) if only is None or b in only]
        schema = "field string, term string, n_occurrences bigint, n_records bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, changed: DataFrame, batch: int | None = None) -> None:
        """Merge the deltas of a batch of changes into the touched buckets and publish them as a new version.

        A batch whose number is not above the last one published changes nothing.
        """
        if batch is not None and batch <= self.last_batch:
            return
        if (last_manifest(self.spark, self.root) or (0,))[0] != self.version:
            raise ValueError("CONFLICT: another version was published below this root")
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(self.buckets)).cast("int")
        deltas = materialize(signed_deltas(changed).withColumn("bucket", bucket), "term-deltas")
        touched = [r[0] for r in deltas.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        path, have, last = f"{self.root}/v{self.version + 1:06d}-{uuid.uuid4().hex[:12]}", set(), self.last_batch if batch is None else batch  # what a failed write left is never met again
        if not touched and last == self.last_batch:
            return
        if touched:
            old = self.read(touched).withColumn("bucket", bucket)
            new = deltas.select("field", "term", F.col("d_occurrences").alias("n_occurrences"), F.col("d_records").alias("n_records"), "bucket")
            # Both sides hold a term once, so a bucket is summed and written by the one task it is sent to.
            merged = old.unionByName(new).repartition(len(touched), "bucket").groupBy("bucket", "field", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
            with freeing_shuffles(self.spark):
                merged.where("n_records > 0").write.partitionBy("bucket").parquet(path)
            have = self._buckets_below(path)
        gone = [p for b, p in self.current.items() if b in touched]
        current = {b: p for b, p in self.current.items() if b not in touched} | {b: f"{path}/bucket={b}" for b in touched if b in have}
        publish_manifest(self.spark, self.root, self.version + 1, {"buckets": self.buckets, "current": {b: p.removeprefix(f"{self.root}/") for b, p in current.items()}, "last_batch": last})
        self.version, self.current, self.last_batch = self.version + 1, current, last
        for p in gone:
            delete_path(self.spark, p)

    def _buckets_below(self, path: str) -> set[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}


def marked_terms(counts: DataFrame, tables: dict[str, str], rare: int = RARE_RECORDS, common: tuple[int, int] = COMMON_SHARE) -> DataFrame:
    """``field, term, n_occurrences, n_records, mark``: ``rare`` below ``rare`` records, ``common`` above the share of all records."""
    totals = counts.where(F.col("field") == TOTAL).select(F.col("term").alias("table"), F.col("n_records").alias("n_table"))
    table = F.element_at(F.create_map(*[F.lit(x) for pair in tables.items() for x in pair]), F.col("field"))
    mark = F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") * common[1] > F.col("n_table") * common[0], "common")
    return counts.where(F.col("field") != TOTAL).withColumn("table", table).join(totals, "table").select("field", "term", "n_occurrences", "n_records", mark.alias("mark"))


FIELDS = {"note_tag": "note", "note_category": "note", "diary_tag": "diary"}
RECORDS_PER_BUCKET, MOST_BUCKETS = 100_000, 4096


def images(notes: DataFrame, diary: DataFrame) -> dict[str, DataFrame]:
    """Record images of both tables, ids with the table's name before them."""
    note = record_image(notes, {"note_tag": F.col("tags"), "note_category": F.array("category")}, "note")
    entry = record_image(diary, {"diary_tag": F.col("tags")}, "diary")
    return {n: df.select(F.concat(F.lit(f"{n}:"), "id").alias("id"), "image") for n, df in (("note", note), ("diary", entry))}


def buckets_for(*tables: DataFrame) -> int:
    return min(max(-(-sum(t.count() for t in tables) // RECORDS_PER_BUCKET), 4), MOST_BUCKETS)


def corpus_counts(notes: DataFrame, diary: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Marked term counts of both tables, applied to an empty store in two arrivals split halfway through ``order``.

    The second arrival's images before it are the first arrival's records of the same ids, so what was only delivered
    again changes nothing.
    """
    store = TermCounts.temporary(notes.sparkSession, buckets_for(notes, diary))
    early, late = [], []
    for df in (notes, diary):
        at = F.unix_millis(F.col(order).cast("timestamp"))
        low, high = df.agg(F.min(at), F.max(at)).first()
        is_late = F.coalesce(at > F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
        early.append(df.where(~is_late))
        late.append(df.where(is_late))
    first, second = images(*early), images(*late)
    store.apply(additions(first["note"]).unionByName(additions(first["diary"])), 0)
    again = [second[n].select("id", F.col("image").alias("new")).join(first[n].select("id", F.col("image").alias("old")), "id", "left").select("id", "old", "new") for n in second]
    store.apply(again[0].unionByName(again[1]), 1)
    return marked_terms(store.read(), FIELDS)


def revised_counts(notes: DataFrame, diary: DataFrame, dropped: Column, untagged: Column) -> DataFrame:
    """Marked term counts after a store is loaded, opened again, and told of notes deleted (``dropped``) or left without tags (``untagged``).

    The batch is given twice; the second time changes nothing.
    """
    spark, now = notes.sparkSession, images(notes, diary)
    store = TermCounts.temporary(spark, buckets_for(notes, diary))
    store.apply(additions(now["note"]).unionByName(additions(now["diary"])), 0)
    revised = notes.where(~dropped).withColumn("tags", F.when(~untagged, F.col("tags")))
    again = TermCounts.open(spark, store.root)
    for _ in range(2):
        again.apply(changes(now["note"], images(revised, diary)["note"]), 1)
    return marked_terms(TermCounts.open(spark, store.root).read(), FIELDS)
