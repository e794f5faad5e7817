"""Connectors: where a store's snapshot comes from and goes to, and bounded reading of interchange records."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.canonical import depth_and_size
from recollect.operators.portable import MAX_BYTES, STRUCT
from recollect.operators.validate import invalid_edges, invalid_notes
from recollect.sources.snapshot import GenerationStore, read_snapshot, write_snapshot

Tables = dict[str, DataFrame]


class StoragePort(Protocol):
    """Anything that loads and saves the tables of a store."""

    def load(self) -> Tables: ...

    def save(self, tables: Tables) -> None: ...


class JsonPort:
    """One JSON document."""

    def __init__(self, spark: SparkSession, path: str, identity: dict):
        self.spark, self.path, self.identity = spark, path, identity

    def load(self) -> Tables:
        return read_snapshot(self.spark, self.path)

    def save(self, tables: Tables) -> None:
        write_snapshot(self.path, self.identity, *(tables[t] for t in ("notes", "diary", "nodes", "edges")))


class ParquetPort:
    """Generations of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str, names: tuple[str, ...] = ("notes", "diary", "nodes", "edges")):
        self.store, self.names = GenerationStore(spark, root), names

    def load(self) -> Tables:
        return {n: self.store.read(n) for n in self.names}

    def save(self, tables: Tables) -> None:
        self.store.publish({n: tables[n] for n in self.names})


def import_snapshot(port: StoragePort, store: ParquetPort) -> None:
    """Publish the tables ``port`` loads as the store's next generation if every row is sound; otherwise nothing changes.

    The error names the first rows at fault.
    """
    t = port.load()
    entries = t["diary"].withColumns({c: F.lit(None).cast(k) for c, k in (("source", "string"), ("status", "string"), ("importance", "double"), ("confidence", "double"))})
    known = t["nodes"].select("id").distinct()
    faults = [("note", invalid_notes(t["notes"])), ("diary", invalid_notes(entries)), ("edge", invalid_edges(t["edges"], known))]
    every = None
    for kind, f in faults:
        f = f.select(F.lit(kind).alias("kind"), "id", F.array_join("fields", ",").alias("fields"))
        every = f if every is None else every.unionByName(f)
    first = every.orderBy("kind", "id").limit(8).collect()
    if first:
        raise ValueError("INVALID_INPUT: " + "; ".join(f"{r.kind} {r.id}: {r.fields}" for r in first))
    store.save(t)


def read_chunks(spark: SparkSession, chunks: Iterable[bytes | str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """As ``read_portable`` of what arrives in ``chunks``; refused as soon as they pass ``max_bytes``, which the driver holds at most."""
    have, size = [], 0
    for c in chunks:
        have.append(c.encode() if isinstance(c, str) else bytes(c))
        size += len(have[-1])
        if size > max_bytes:
            raise ValueError("INPUT_LIMIT_EXCEEDED: the input passes its byte limit")
    return _records(spark.createDataFrame([(b"".join(have).decode(),)], "value string"))


@F.pandas_udf(T.IntegerType())
def _depth(s: pd.Series) -> pd.Series:
    def one(text: str) -> int:
        try:
            return depth_and_size(json.loads(text))[0]
        except ValueError:
            return 0

    return s.map(one)


def _records(text: DataFrame) -> DataFrame:
    """The records of a text that is a JSON array, each with its ``record_index`` and ``depth``."""
    each = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "raw"))
    return each.select(F.from_json("raw", STRUCT).alias("r"), F.col("at").cast("bigint").alias("record_index"), _depth("raw").alias("depth")).select("r.*", "record_index", "depth")


def read_portable(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Interchange records of a JSON array, or of JSON lines, with their ``record_index``.

    A file over ``max_bytes`` is refused before it is parsed; None reads any size. An array is one task's work, as its format demands; lines are
    read by many. Indexes rise in the order of the input; ``depth`` is how deep a record's JSON nests.
    """
    if max_bytes is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getContentSummary(p).getLength() > max_bytes:
            raise ValueError("INPUT_LIMIT_EXCEEDED: the input passes its byte limit")
    text = spark.read.text(path, wholetext=True)
    if not text.where(F.ltrim("value").startswith("[")).isEmpty():
        return _records(text)
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("record_index"))
    return lines.select(F.from_json("value", STRUCT).alias("r"), "record_index", _depth("value").alias("depth")).select("r.*", "record_index", "depth")
