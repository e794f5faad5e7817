"""Change feeds applied as a log-structured merge (problem 4).

Transactions are appended as runs of one table, which is bucketed by object key and sorted by key and sequence (``tx_id``, position in the
transaction). A row is one slim operation, or the commit of a mutation id, kept as an object of kind ``mutation``. A read is a k-way
merge: the task of a bucket takes that bucket's file of each run, which is an ascending run of rows, merges them by the in-task sort
(TimSort, which merges the ascending runs it finds) and keeps the greatest sequence of each key in one pass; no operation is shuffled before
that. A last operation that removes is a tombstone. A key's bucket changes with its block of ``tx_id``, so a key with a third of all operations is
many buckets' work, and the blocks' last rows are combined by key.

``fan_in`` runs of one level are compacted into one run of the next level, bucket by bucket. What can never show again is dropped there: repeated frames
and transactions without effect (a mutation id's owner only ever moves to a lower ``tx_id``). Superseded operations stay while a late
transaction with a lower ``tx_id`` could take the mutation id of what superseded them. ``compact`` takes watermarks, the highest ``tx_id`` of
each store below which nothing arrives any more; up to there only what exists is kept, tombstones go too.

Defined results: transactions with a null store, tx_id or ops are no transactions and left out; a null ``mutation_id``
belongs to its transaction alone; ops of an unknown type or without a top-level string ``id`` have no effect; a remove of an
absent object does nothing (of an absent node, it takes no edges either); an empty feed gives an empty state.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.operators.skew import HOT_ROWS, hot_groups, hot_of, spread_join
from recollect.session import delete_path, freeing_shuffles, last_manifest, materialize, publish_manifest, scratch_path

# Operation types of the log.
OP_TYPE = r"^ether\.(note|diary|graph-node|graph-edge)\.(put|remove)$"
KEY = ["store_id", "obj_kind", "obj_id"]
SEQ = ["tx_id", "op_ord"]
BLOCK = 1 << 16
CLUSTER = [*KEY, "block"]
MUTATION = "mutation"
ROW = "store_id string, obj_kind string, obj_id string, block decimal(38,0), tx_id decimal(38,0), op_ord int, is_put boolean, source string, target string"
TRANSACTIONS_PER_BUCKET = 30_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
# Rows of transactions without effect that a broadcast takes, about 6 MB; more are joined by shuffle.
SMALL = 1 << 15


def log_rows(transactions: DataFrame) -> DataFrame:
    """The rows of a run: every operation, and for each mutation id its transaction, from one pass over ``transactions``."""
    op, is_commit = F.col("op"), F.col("op.type").isNull()
    own = F.filter(F.transform("ops", lambda o: F.struct(F.coalesce(o["type"], F.lit("")).alias("type"), o["payload"].alias("payload"))), lambda o: o["type"].rlike(OP_TYPE))
    commit = F.array(F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("payload")))
    body = F.from_json(op["payload"], "id string, source string, target string")
    kind = F.when(is_commit, MUTATION).otherwise(F.regexp_extract(op["type"], OP_TYPE, 1))
    return (
        transactions.where("store_id is not null and tx_id is not null and ops is not null")
        .select("store_id", "tx_id", "mutation_id", F.posexplode(F.concat(commit, own)).alias("op_ord", "op"))
        .select("store_id", kind.alias("obj_kind"), F.regexp_extract(op["type"], OP_TYPE, 2).alias("verb"), "tx_id", "op_ord", "mutation_id", body.alias("body"))
        .select("*", F.when(F.col("obj_kind") == MUTATION, F.col("mutation_id")).otherwise(F.col("body.id")).alias("obj_id"))
        .where("obj_id is not null")
        .select(
            *KEY,
            F.floor(F.col("tx_id") / BLOCK).cast("decimal(38,0)").alias("block"),
            *SEQ,
            F.coalesce(F.col("verb") == "put", F.lit(False)).alias("is_put"),
            *[F.when((F.col("verb") == "put") & (F.col("obj_kind") == "graph-edge"), F.col(f"body.{c}")).alias(c) for c in ("source", "target")],
        )
    )


def without_effect(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``store_id, tx_id`` of the transactions in ``rows`` whose mutation id a lower ``tx_id`` owns. Written once, few as they are."""
    commits, key = rows.where(F.col("obj_kind") == MUTATION).select("store_id", "obj_id", "tx_id"), ["store_id", "obj_id"]
    owners = commits.groupBy(*key).agg(F.min("tx_id").alias("owner_tx"), F.max("tx_id").alias("last_tx"), F.count(F.lit(1)).alias("n_rows")).where("owner_tx < last_tx")
    lost = spread_join(commits, owners.drop("n_rows"), key, "tx_id", hot_of(owners, key, hot_rows), rows_per_salt=hot_rows).where("tx_id > owner_tx")
    return materialize(lost.select("store_id", "tx_id").distinct(), "without-effect")


def effective(rows: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` of transactions with effect, and whether they are still in their buckets."""
    lost = without_effect(rows, hot_rows)
    in_place = lost.count() <= SMALL
    return rows.join(F.broadcast(lost) if in_place else lost, ["store_id", "tx_id"], "left_anti").select(*rows.columns), in_place


def explode_ops(transactions: DataFrame) -> DataFrame:
    """One slim row per operation: key, sequence, whether it puts, an edge's ends and the mutation id."""
    op = F.col("op")
    body = F.from_json(op["payload"], "id string, source string, target string")
    return (
        transactions.where("store_id is not null and tx_id is not null and ops is not null")
        .select("store_id", "tx_id", "mutation_id", F.posexplode("ops").alias("op_ord", "op"))
        .select(
            "store_id",
            F.regexp_extract(op["type"], OP_TYPE, 1).alias("obj_kind"),
            F.regexp_extract(op["type"], OP_TYPE, 2).alias("verb"),
            "tx_id",
            "op_ord",
            "mutation_id",
            body.alias("body"),
        )
        .where("obj_kind != '' and body.id is not null")
        .select(
            "store_id",
            "obj_kind",
            F.col("body.id").alias("obj_id"),
            "tx_id",
            "op_ord",
            (F.col("verb") == "put").alias("is_put"),
            *[F.when((F.col("verb") == "put") & (F.col("obj_kind") == "graph-edge"), F.col(f"body.{c}")).alias(c) for c in ("source", "target")],
            "mutation_id",
        )
    )


def commits_of(transactions: DataFrame) -> DataFrame:
    """(store, mutation, transaction) of every transaction, those without operations included."""
    return transactions.where("store_id is not null and tx_id is not null and ops is not null and mutation_id is not null").select("store_id", "mutation_id", "tx_id")


def without_replays(ops: DataFrame, commits: DataFrame) -> DataFrame:
    """Only the operations of transactions that own their mutation id: those of the lowest ``tx_id`` in their store.

    Only mutation ids seen under several transactions take part in the join; a frame received twice is none of them.
    """
    owners = commits.groupBy("store_id", "mutation_id").agg(F.min("tx_id").alias("owner_tx"), F.max("tx_id").alias("last_tx")).where("owner_tx < last_tx")
    o, c = ops.alias("o"), owners.alias("c")
    same = (F.col("o.store_id") == F.col("c.store_id")) & (F.col("o.mutation_id") == F.col("c.mutation_id"))
    return o.join(c, same & (F.col("o.tx_id") > F.col("c.owner_tx")), "left_anti")


def merge_runs(ops: DataFrame, cut: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The state after all operations: one row per object that exists, with its last put: ``store_id, obj_kind, obj_id, tx_id, op_ord, source, target``.

    The last operation of a key is its greatest sequence. Rows of a log's buckets (with ``block``) are merged in their bucket first; any others
    combine map-side, so a key with a third of all operations is no burden. An edge lives if no effective remove of
    either end comes after its last put. ``cut`` writes the last puts once and spreads the edges of hot nodes; for large logs.
    """
    this = F.max(F.struct(*SEQ, "is_put", "source", "target"))
    last = ops.groupBy(*CLUSTER).agg(this.alias("last")).groupBy(*KEY).agg(F.max("last").alias("last")) if "block" in ops.columns else ops.groupBy(*KEY).agg(this.alias("last"))
    objects = last.where("last.is_put").select(*KEY, "last.*").drop("is_put")
    if cut:
        objects = materialize(objects, "last-puts")
    gone, key = effective_removes(ops), ["store_id", "node_id"]
    if cut:
        gone = materialize(gone, "removed-nodes")
    every = edges = objects.where("obj_kind = 'graph-edge'")
    for end in ("source", "target"):
        at = edges.withColumn("node_id", F.col(end))
        met = spread_join(at, gone, key, "obj_id", hot_groups(every.withColumn("node_id", F.col(end)), key, hot_rows), "left", hot_rows) if cut else at.join(gone, key, "left")
        edges = met.where(F.coalesce(F.col("removed_seq") <= F.struct(*SEQ), F.lit(True))).select(*objects.columns)
    return objects.where("obj_kind != 'graph-edge'").unionByName(edges)


def effective_removes(ops: DataFrame) -> DataFrame:
    """``store_id, node_id, removed_seq``: the last remove of each node that found the node there."""
    return node_removes(ops).groupBy("store_id", "node_id").agg(F.max(F.struct(*SEQ)).alias("removed_seq"))


def node_removes(ops: DataFrame) -> DataFrame:
    """``store_id, node_id``, sequence: every remove of a node that found the node there.

    A node's history is cut into blocks of transaction numbers; the first operation of a block looks back to the last one
    of the block before.
    """
    nodes = ops.where("obj_kind = 'graph-node'").select(*KEY, F.col("block") if "block" in ops.columns else F.floor(F.col("tx_id") / BLOCK).alias("block"), *SEQ, "is_put").dropDuplicates([*CLUSTER, *SEQ])
    inside = F.lag("is_put").over(W.partitionBy(*CLUSTER).orderBy(*SEQ))
    ends = nodes.groupBy(*CLUSTER).agg(F.max(F.struct(*SEQ, "is_put")).alias("end"))
    carry = ends.select(*CLUSTER, F.lag("end.is_put").over(W.partitionBy(*KEY).orderBy("block")).alias("carry"))
    seen = nodes.withColumn("inside", inside).where("not is_put").join(carry, CLUSTER).where(F.coalesce("inside", "carry", F.lit(False)))
    return seen.select("store_id", F.col("obj_id").alias("node_id"), *SEQ)


def absent_removes(ops: DataFrame) -> DataFrame:
    """``store_id, obj_kind, obj_id, tx_id`` of every remove that found nothing to remove, edges included.

    An object is absent if its operation before is no put; an edge also if an effective remove of either end lies between
    that put and its remove. Keys and nodes are cut into blocks as in ``node_removes``. ``ops`` is read several times.
    """
    blocked = ops.withColumn("block", F.floor(F.col("tx_id") / BLOCK))
    this, block = F.struct(*SEQ, "is_put", "source", "target"), CLUSTER
    inside = F.lag(this).over(W.partitionBy(*block).orderBy(*SEQ))
    ends = blocked.groupBy(*block).agg(F.max(this).alias("end"))
    carry = ends.select(*block, F.lag("end").over(W.partitionBy(*KEY).orderBy("block")).alias("carry"))
    removes = blocked.withColumn("inside", inside).where("not is_put").join(carry, block).withColumn("was", F.coalesce("inside", "carry"))
    found = F.coalesce("was.is_put", F.lit(False))
    lost = removes.where(~found).select(*KEY, *SEQ)

    # The edges found put are asked at each end for the last effective remove before their own.
    ends_of = F.explode(F.array_distinct(F.array("was.source", "was.target"))).alias("node_id")
    asked = removes.where(found & (F.col("obj_kind") == "graph-edge")).select("store_id", "obj_kind", "obj_id", *SEQ, F.struct(*[f"was.{c}" for c in SEQ]).alias("put_seq"), ends_of).where("node_id is not null")
    events = asked.unionByName(node_removes(ops), allowMissingColumns=True).withColumn("block", F.floor(F.col("tx_id") / BLOCK))
    gone, node = F.when(F.col("obj_id").isNull(), F.struct(*SEQ)), ["store_id", "node_id"]
    here = F.max(gone).over(W.partitionBy(*node, "block").orderBy(*SEQ).rowsBetween(W.unboundedPreceding, W.currentRow))
    tops = events.groupBy(*node, "block").agg(F.max(gone).alias("top"))
    before = tops.select(*node, "block", F.max("top").over(W.partitionBy(*node).orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    last = events.withColumn("here", here).where("obj_id is not null").join(before, [*node, "block"])
    cascaded = last.where(F.coalesce("here", "before") > F.col("put_seq")).select(*KEY, *SEQ).distinct()
    return lost.unionByName(cascaded).select(*KEY, "tx_id")


@dataclass
class ChangeLog:
    """Runs in a shared folder. ``levels[n]`` lists the runs of level n; ``fan_in`` of them become one of level n + 1.

    The list of runs is published as a manifest below ``root`` with each change, from which ``open`` goes on in a later session. A run
    is a partition of the table; what a failed write left is in no manifest and never read.
    """

    spark: SparkSession
    root: str
    fan_in: int = 3
    buckets: int = 16
    levels: list[list[str]] = field(default_factory=list)
    last_batch: int = -1
    _published: int = 0

    @classmethod
    def temporary(cls, spark: SparkSession, fan_in: int = 3, buckets: int = 16) -> ChangeLog:
        return cls(spark, scratch_path(spark, "changelog"), fan_in, buckets)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> ChangeLog:
        """The log published below ``root``; none yet gives an empty log."""
        last = last_manifest(spark, root)
        if last is None:
            return cls(spark, root)
        number, m = last
        return cls(spark, root, m["fan_in"], m["buckets"], m["levels"], m["last_batch"], number)

    def append(self, transactions: DataFrame, batch: int | None = None) -> None:
        """Add a batch, in whatever order, as a sorted run of level 0, then compact the levels that are full.

        A batch whose number is not above the last one published changes nothing: it is a batch given again.
        """
        if batch is not None and batch <= self.last_batch:
            return
        self._add(0, self._write(log_rows(transactions).repartition(self.buckets, *CLUSTER)))
        self.last_batch = self.last_batch if batch is None else batch
        self._publish()
        self._compact_full()

    def compact(self, settled: DataFrame | None = None) -> None:
        """Merge all runs into one. ``settled`` gives per ``store_id`` the ``settled_tx`` up to which no transaction arrives any more."""
        if settled is not None or len(self.runs()) > 1:
            self._merge(self.runs(), max(len(self.levels) - 1, 1), settled)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def read(self) -> DataFrame:
        """The current state, merged from all runs: ``store_id, obj_kind, obj_id, tx_id``."""
        if not self.runs():
            return self.spark.createDataFrame([], "store_id string, obj_kind string, obj_id string, tx_id decimal(38,0)")
        rows, _ = effective(self.rows(self.runs()))
        return merge_runs(rows.where(F.col("obj_kind") != MUTATION), cut=True).select(*KEY, "tx_id")

    def rows(self, runs: list[str]) -> DataFrame:
        """All rows of ``runs``, in buckets."""
        name = self._table()
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).where(F.col("run").isin(runs)).drop("run")

    def _table(self) -> str:
        name = f"changelog_{hashlib.sha256(f'{self.root} {self.buckets}'.encode()).hexdigest()[:16]}"
        order = ", ".join([*CLUSTER, *SEQ])
        self.spark.sql(f"create table if not exists {name} ({ROW}, run string) using parquet partitioned by (run) clustered by ({', '.join(CLUSTER)}) sorted by ({order}) into {self.buckets} buckets location '{self.root}/rows'")
        return name

    def _write(self, rows: DataFrame) -> str:
        """Write ``rows`` as a run; the writer sorts each bucket. Rows are in their buckets already, so a bucket is one file."""
        run = f"run-{uuid.uuid4().hex}"
        with freeing_shuffles(self.spark):
            rows.withColumn("run", F.lit(run)).write.insertInto(self._table())
        return run

    def _add(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _publish(self) -> None:
        publish_manifest(self.spark, self.root, self._published + 1, {"fan_in": self.fan_in, "buckets": self.buckets, "levels": self.levels, "last_batch": self.last_batch})
        self._published += 1

    def _compact_full(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                self._merge(list(self.levels[level]), level + 1)
            level += 1

    def _merge(self, runs: list[str], level: int, settled: DataFrame | None = None) -> None:
        """Write the merged run first, publish it, then delete its parts: a failure between leaves the old or the new runs valid.

        Equal rows of one key and sequence are frames received again; one of each stays.
        """
        rows, in_place = effective(self.rows(runs))
        order = W.partitionBy(*CLUSTER).orderBy(*SEQ)
        again = F.lag("tx_id").over(order).eqNullSafe(F.col("tx_id")) & F.lag("op_ord").over(order).eqNullSafe(F.col("op_ord"))
        once = rows.withColumn("again", again).where("not again").drop("again")
        if settled is not None:
            once, in_place = self._settled(once, settled), False
        merged = self._write(once if in_place else once.repartition(self.buckets, *CLUSTER))
        self.levels = [[r for r in have if r not in runs] for have in self.levels]
        self._add(level, merged)
        self._publish()
        for r in runs:
            delete_path(self.spark, f"{self.root}/rows/run={r}")

    def _settled(self, rows: DataFrame, settled: DataFrame) -> DataFrame:
        """Up to the watermarks only the last puts of what exists there, beside the owners of all mutation ids; beyond them all rows."""
        marked = rows.join(settled.select("store_id", "settled_tx"), "store_id", "left").withColumn("old", F.coalesce(F.col("tx_id") <= F.col("settled_tx"), F.lit(False)) & (F.col("obj_kind") != MUTATION))
        marked = materialize(marked.drop("settled_tx"), "settled")
        kept = merge_runs(marked.where("old").drop("old"), cut=True).withColumns({"is_put": F.lit(True), "block": F.floor(F.col("tx_id") / BLOCK).cast("decimal(38,0)")})
        return marked.where("not old").drop("old").select(*rows.columns).unionByName(kept.select(*rows.columns))


def current_state(feed: DataFrame, order: str = "received_at", runs: int = 4, fan_in: int = 3) -> DataFrame:
    """The state of a whole feed, appended in ``runs`` arrivals and merged on read.

    Arrivals are ranges of ``order`` itself, so each reads its own part of the files; rows without one come first.
    """
    rows, marks = feed.select(F.count(F.lit(1)), F.percentile_approx(order, [i / runs for i in range(1, runs)], 1000)).first()
    log = ChangeLog.temporary(feed.sparkSession, fan_in, min(max(-(-rows // TRANSACTIONS_PER_BUCKET), LEAST_BUCKETS), MOST_BUCKETS))
    bounds, at, kind = [None, *sorted(set(marks or [])), None], F.col(order), feed.schema[order].dataType
    for low, high in zip(bounds, bounds[1:]):
        part: Column = F.lit(True)
        if low is not None:
            part &= at >= F.lit(low).cast(kind)
        if high is not None:
            part &= (at < F.lit(high).cast(kind)) if low is not None else (at < F.lit(high).cast(kind)) | at.isNull()
        log.append(feed.where(part))
    return log.read()
