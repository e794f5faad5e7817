"""Snapshot files: a whole store in one JSON document, and generations of a store as Parquet folders with a manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import delete_path, file_names, last_manifest, publish_manifest

NOTE = "id string, content string, summary string, category string, tags array<string>, source string, provenance struct<kind:string,parentNoteId:string,parentDiaryId:string,parentEdgeId:string,importBatchId:string,detail:string,lastEditKind:string>, importance double, confidence double, pinned boolean, status string, createdAt string, updatedAt string, expiresAt string, metadata string"
DIARY = "id string, content string, createdAt string, updatedAt string, tags array<string>, metadata string"
NODE = "id string, type string, label string, data string"
EDGE = "id string, source string, target string, relationship string, data string"
SNAPSHOT = f"schemaVersion string, identity struct<userId:string,displayName:string,createdAt:string,lastActive:string,preferences:string>, memoryNotes array<struct<{{n}}>>, diary array<struct<{{d}}>>, graph struct<nodes:array<struct<{{v}}>>,edges:array<struct<{{e}}>>>"
TABLES = ("notes", "diary", "nodes", "edges")


def _inner(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


def schema() -> str:
    return SNAPSHOT.format(n=_inner(NOTE), d=_inner(DIARY), v=_inner(NODE), e=_inner(EDGE))


def stored_time(c: Column) -> Column:
    """A stored time, as text or as a number of milliseconds, without zone; null where it is neither."""
    millis = F.timestamp_millis(F.when(c.rlike(r"^-?\d{1,15}$"), c).try_cast("bigint"))
    return F.coalesce(millis, c.try_cast("timestamp")).cast("timestamp_ntz")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``identity, notes, diary, nodes, edges`` of a snapshot document; times become timestamps without zone."""
    doc = spark.read.option("multiLine", True).schema(schema()).json(_standing(spark, path))
    parts = {"notes": "memoryNotes", "diary": "diary", "nodes": "graph.nodes", "edges": "graph.edges"}
    out = {"identity": doc.select("schemaVersion", "identity.*")}
    for name, at in parts.items():
        df = doc.select(F.explode(at).alias("x")).select("x.*")
        for old, new in (("createdAt", "created_at"), ("updatedAt", "updated_at"), ("expiresAt", "expires_at")):
            if old in df.columns:
                df = df.withColumn(old, stored_time(F.col(old))).withColumnRenamed(old, new)
        out[name] = df
    return out


def write_snapshot(path: str, identity: dict, notes: DataFrame, diary: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
    """One JSON document. It is built by one task, as the format demands; large stores use generations."""
    spark = notes.sparkSession

    def packed(df: DataFrame) -> DataFrame:
        names = {"created_at": "createdAt", "updated_at": "updatedAt", "expires_at": "expiresAt"}
        cols = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if c in names else F.col(c)).alias(names.get(c, c)) for c in df.columns]
        return df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("l"))

    one = packed(notes).select(F.col("l").alias("memoryNotes"))
    one = one.join(packed(diary).select(F.col("l").alias("diary")))
    graph = packed(nodes).select(F.col("l").alias("nodes")).join(packed(edges).select(F.col("l").alias("edges"))).select(F.struct("nodes", "edges").alias("graph"))
    head = spark.createDataFrame([(json.dumps(identity),)], "identity string").select(F.lit(identity.get("schemaVersion")).alias("schemaVersion"), F.from_json("identity", "userId string, displayName string, createdAt string, lastActive string, preferences string").alias("identity"))
    temp = f"{path}.{uuid.uuid4().hex[:12]}"
    head.join(one).join(graph).coalesce(1).write.json(temp)
    _swap(spark, temp, path)


def _swap(spark: SparkSession, temp: str, to: str) -> None:
    """Put the folder ``temp`` in the place of ``to``. The old one stays aside until the new one is there, where ``_standing`` finds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, final, aside = path(temp), path(to), path(f"{to}.before")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        fs.delete(aside, True)
        fs.rename(final, aside)
    if not fs.rename(new, final):
        raise OSError("STORAGE_ERROR: the snapshot could not be put in place")
    fs.delete(aside, True)


def _standing(spark: SparkSession, path: str) -> str:
    """``path``, or what a writer that was lost between its two renames left beside it."""
    p, aside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.before"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path}.before" if not fs.exists(p) and fs.exists(aside) else path


def table_digest(df: DataFrame) -> dict[str, str]:
    """Number of rows and a sum of row hashes, which no order of rows changes."""
    n, total = df.select(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
    return {"rows": str(n), "digest": str(total)}


@dataclass
class GenerationStore:
    """Immutable generations below ``root``. A numbered manifest names the current one with the digests of its tables; it is placed
    whole, last, and never over another, so at every moment there is one current generation."""

    spark: SparkSession
    root: str

    def head(self) -> str | None:
        """The current generation, or None for a store not made yet."""
        last = last_manifest(self.spark, self.root)
        return last and last[1]["generation"]

    def publish(self, tables: dict[str, DataFrame], expect: str | None = None) -> str:
        """Write a new generation, read it back for its digests, then publish its manifest. ``expect`` guards against a writer in between."""
        number, value = last_manifest(self.spark, self.root) or (0, {"generation": None})
        if expect is not None and value["generation"] != expect:
            raise ValueError("CONFLICT: another generation was published")
        name = f"gen-{uuid.uuid4().hex[:12]}"
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{t}")
        digests = {t: table_digest(self.spark.read.parquet(f"{self.root}/{name}/{t}")) for t in tables}
        publish_manifest(self.spark, self.root, number + 1, {"generation": name, "tables": digests})
        return name

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        name = generation or self.head()
        if name is None:
            raise ValueError("NOT_FOUND: the store has no generation")
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")

    def verify(self) -> dict[str, dict[str, str]]:
        """Read every table of the current generation against its digest; a difference is corruption."""
        last = last_manifest(self.spark, self.root)
        if last is None:
            raise ValueError("NOT_FOUND: the store has no generation")
        for t, want in last[1]["tables"].items():
            if table_digest(self.read(t, last[1]["generation"])) != want:
                raise ValueError(f"PERSISTENCE_CORRUPTION: {t} is not what was published")
        return last[1]["tables"]

    def collect_garbage(self) -> list[str]:
        """Delete all generations but the current one; gives their names."""
        keep = self.head()
        old = [n for n in file_names(self.spark, self.root) if n.startswith("gen-") and n != keep]
        for name in old:
            delete_path(self.spark, f"{self.root}/{name}")
        return old
