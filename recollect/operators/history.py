"""Checks and maintenance of the transaction log: chains, identities, receipts, object references, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Transport and envelope limits in bytes.
INLINE_OP, INLINE_TOTAL, ENVELOPE, MUTATION_BOUND = 64 << 10, 512 << 10, 30 << 20, 1 << 20
BLOCK = 1 << 16
FRAME = ["store_id", "epoch_id", "tx_id", "base", "mutation_id", "intent_digest", "ops"]


def frames(transactions: DataFrame) -> DataFrame:
    """Each transaction once, however often its frame was received, with a digest of its content."""
    return transactions.select(*FRAME).withColumn("frame_digest", frame_digest()).dropDuplicates(["store_id", "tx_id", "frame_digest"])


def frame_digest() -> Column:
    """SHA-256 of identity, base and operations."""
    ops = F.transform("ops", lambda o: F.concat_ws("\x1f", o["type"], o["version"], o["payload"]))
    return F.sha2(F.concat_ws("\x1e", "store_id", "epoch_id", F.col("tx_id").cast("string"), "base.epoch", F.col("base.tx").cast("string"), "base.digest", "mutation_id", "intent_digest", F.array_join(ops, "\x1e")), 256)


def repeated_frames(transactions: DataFrame) -> DataFrame:
    """``store_id, tx_id, n_copies`` of frames received more than once."""
    return transactions.groupBy("store_id", "tx_id", frame_digest().alias("frame_digest")).agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1").select("store_id", "tx_id", "n_copies")


def chain_breaks(transactions: DataFrame) -> DataFrame:
    """Per store transactions that do not follow the one before: ``reason`` is gap, base or epoch.

    Stores are cut into blocks of transaction numbers, so a store with a third of all rows is many tasks' work; the first
    row of a block takes its predecessor from the block before.
    """
    t = transactions.select("store_id", "epoch_id", "tx_id", "base.tx", "base.epoch").distinct().withColumn("block", F.floor(F.col("tx_id") / BLOCK))
    here = F.struct("tx_id", "epoch_id")
    ends = t.groupBy("store_id", "block").agg(F.max(here).alias("end"))
    carry = ends.select("store_id", "block", F.lag("end").over(W.partitionBy("store_id").orderBy("block")).alias("carry"))
    t = t.withColumn("inside", F.lag(here).over(W.partitionBy("store_id", "block").orderBy("tx_id"))).join(carry, ["store_id", "block"])
    t = t.withColumn("prev", F.coalesce("inside", "carry")).where("prev is not null").withColumn("prev_tx", F.col("prev.tx_id"))
    reason = F.when(F.col("tx_id") != F.col("prev_tx") + 1, "gap").when(~F.col("tx").eqNullSafe(F.col("prev_tx")), "base").when(~F.col("epoch").eqNullSafe(F.col("prev.epoch_id")), "epoch")
    return t.withColumn("reason", reason).where("reason is not null").select("store_id", "tx_id", "prev_tx", "reason")


def store_tips(transactions: DataFrame) -> DataFrame:
    """``store_id, first_tx, last_tx, next_tx, n_transactions, n_missing`` per store."""
    t = transactions.select("store_id", "tx_id").distinct()
    last = F.max("tx_id")
    return t.groupBy("store_id").agg(F.min("tx_id").alias("first_tx"), last.alias("last_tx"), F.count(F.lit(1)).alias("n_transactions")).select(
        "store_id", F.col("first_tx").cast("string").alias("first_tx"), F.col("last_tx").cast("string").alias("last_tx"), (F.col("last_tx") + 1).cast("decimal(38,0)").cast("string").alias("next_tx"), "n_transactions", (F.col("last_tx") - F.col("first_tx") + 1 - F.col("n_transactions")).cast("bigint").alias("n_missing")
    )


def contested_mutations(transactions: DataFrame) -> DataFrame:
    """Mutation ids used by several transactions of a store; ``conflict`` says whether their intents differ."""
    t = transactions.where("mutation_id is not null").select("store_id", "mutation_id", "tx_id", "intent_digest").distinct()
    return (
        t.groupBy("store_id", "mutation_id")
        .agg(F.countDistinct("tx_id").alias("n_transactions"), F.min("tx_id").cast("string").alias("owner_tx"), (F.min("intent_digest") != F.max("intent_digest")).alias("conflict"))
        .where("n_transactions > 1")
    )


def receipts(transactions: DataFrame) -> DataFrame:
    """The ledger entry of each mutation: its owning transaction, intent and the operations' kinds in order."""
    own = W.partitionBy("store_id", "mutation_id").orderBy("tx_id")
    t = transactions.where("mutation_id is not null").select("store_id", "mutation_id", "tx_id", "intent_digest", F.transform("ops", lambda o: o["type"]).alias("op_types"))
    return t.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")


def lookup(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """``outcome`` of each asked (store_id, mutation_id, intent_digest): absent, known, or conflict where the intent differs."""
    have = ledger.select("store_id", "mutation_id", F.col("intent_digest").alias("__known"), F.col("tx_id").alias("owner_tx"))
    outcome = F.when(F.col("__known").isNull(), "absent").when(F.col("__known") == F.col("intent_digest"), "known").otherwise("conflict")
    return asked.join(have, ["store_id", "mutation_id"], "left").select("store_id", "mutation_id", outcome.alias("outcome"), "owner_tx")


def merge_ledgers(previous: DataFrame, segment: DataFrame) -> DataFrame:
    """The union of two ledgers by identity, the first transaction of each, and ``corrupt`` for identities that come up twice."""
    every = previous.unionByName(segment)
    first = F.min_by(F.struct(*[c for c in every.columns if c not in ("store_id", "mutation_id")]), "tx_id").alias("first")
    return every.groupBy("store_id", "mutation_id").agg(first, (F.count(F.lit(1)) > 1).alias("corrupt")).select("store_id", "mutation_id", "first.*", "corrupt")


def op_transport(transactions: DataFrame, inline_op: int = INLINE_OP, inline_total: int = INLINE_TOTAL) -> DataFrame:
    """Per transaction its payload bytes and whether they travel inline or by reference."""
    size = F.aggregate(F.transform("ops", lambda o: F.octet_length(o["payload"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    most = F.array_max(F.transform("ops", lambda o: F.octet_length(o["payload"])))
    t = transactions.select("store_id", "tx_id", "ops").dropDuplicates(["store_id", "tx_id"])
    return t.select("store_id", F.col("tx_id").cast("string").alias("tx_id"), size.alias("payload_bytes"), F.when((most > inline_op) | (size > inline_total), "reference").otherwise("inline").alias("transport"))


def payload_objects(transactions: DataFrame) -> DataFrame:
    """Content-addressed payloads: ``digest, payload, n_uses``, each distinct payload once."""
    ops = transactions.select("store_id", "tx_id", "ops").dropDuplicates(["store_id", "tx_id"]).select(F.explode("ops.payload").alias("payload"))
    return ops.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n_uses"))


def resolved_ops(ops: DataFrame, objects: DataFrame) -> DataFrame:
    """Operations with their payload: inline, or that of the object their ``digest`` names; ``missing`` where there is none."""
    have = objects.select("digest", F.col("payload").alias("__object"))
    return ops.join(have, "digest", "left").withColumn("payload", F.coalesce("payload", "__object")).withColumn("missing", F.col("payload").isNull()).drop("__object")


def reclaimable(inventory: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects that nothing marks, and marks without object, which are corruption."""
    m = marks.select("digest").distinct()
    return inventory.select("digest").join(m, "digest", "left_anti"), m.join(inventory.select("digest"), "digest", "left_anti")


def rotation_due(transactions: DataFrame, envelope: int = ENVELOPE) -> DataFrame:
    """Per store the bytes of its active log, and whether it must rotate before another mutation of the largest size."""
    sized = op_transport(transactions).groupBy("store_id").agg(F.sum("payload_bytes").alias("active_bytes"))
    return sized.withColumn("rotate", F.col("active_bytes") + min(MUTATION_BOUND, envelope) > envelope)


def effects(before: DataFrame, after: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Operations that turn ``before`` into ``after`` (id, body): removes first, then puts, each by id."""
    b, a = before.select("id", F.col(body).alias("__old")), after.select("id", F.col(body).alias("__new"))
    changed = b.join(a, "id", "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    verb = F.when(F.col("__new").isNull(), "remove").otherwise("put")
    return changed.select(F.lit(kind).alias("kind"), verb.alias("verb"), "id", F.col("__new").alias(body), F.when(verb == "remove", 0).otherwise(1).alias("part"))
