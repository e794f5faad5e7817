"""A durable store on the transaction log: idempotent commits, recovery, rotation and garbage collection.

Layout below ``root``: generations (checkpoints with digests) with their ledger of receipts; ``wal``, one JSON file per transaction since the
current generation, each with the digest of the one before; and ``objects``, payloads too large to travel inline, named by
their digest. State is always checkpoint plus log, merged by the same operator as any change feed. A transaction is placed under its
number whole or not at all, and never over another, so of two writers one succeeds and the other is told to recover. The active log is
bounded by the envelope; the writer keeps its identities and sizes, so a commit does not read it again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.canonical import EncodingError, data_json
from recollect.operators.change_log import commits_of, explode_ops, merge_runs, without_replays
from recollect.operators.condense import as_candidate_notes, condensed
from recollect.operators.history import ENVELOPE, INLINE_OP, INLINE_TOTAL, MUTATION_BOUND, merge_ledgers, receipts, reclaimable, resolved_ops
from recollect.session import delete_path, file_names, place
from recollect.sources.snapshot import GenerationStore
from recollect.streaming.log_stream import FRAME_SCHEMA

# The first transaction number lies above what a double can count, defaults of new records.
FIRST_TX = 9007199254740993
STATE = "store_id string, obj_kind string, obj_id string, body string"
FRAME = "store_id string, epoch_id string, tx_id decimal(38,0), base struct<epoch:string,tx:decimal(38,0),digest:string>, mutation_id string, intent_digest string, ops array<struct<type:string,version:string,payload:string>>, received_at string"
# An operation of this version holds the digest of an object in place of its payload.
BY_REFERENCE = "reference"
NOTE_DEFAULTS = {"tags": [], "source": "user", "importance": 0.5, "confidence": 0.75, "pinned": False, "status": "active", "metadata": {}}


class StoreError(ValueError):
    """A refused operation; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def intent_digest(command: dict[str, Any]) -> str:
    """SHA-256 of the command with sorted keys; only plain JSON is a command."""
    try:
        return hashlib.sha256(json.dumps(command, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
    except (TypeError, ValueError) as e:
        raise StoreError("INVALID_INPUT", "a command is plain JSON") from (e if not isinstance(e, EncodingError) else None)


@dataclass
class DurableStore:
    """Use ``create`` or ``open``. ``state(kind)`` gives ``id, body`` with the body as JSON."""

    spark: SparkSession
    root: str
    store_id: str
    envelope: int = ENVELOPE
    tip: int = FIRST_TX - 1
    epoch: str = ""
    closed: bool = False
    _last: str = ""
    _bytes: int = 0
    _known: dict[str, dict[str, Any]] = field(default_factory=dict)
    _generations: GenerationStore = field(init=False)

    def __post_init__(self) -> None:
        self._generations = GenerationStore(self.spark, f"{self.root}/generations")

    # --- life cycle

    @classmethod
    def create(cls, spark: SparkSession, root: str, store_id: str, **kw: Any) -> DurableStore:
        s = cls(spark, root, store_id, epoch=f"epoch-{uuid.uuid4().hex[:12]}", **kw)
        if s.inspect() != "missing":
            raise StoreError("CONFLICT", "there is a store already")
        s._publish(spark.createDataFrame([], STATE), s._no_receipts())
        return s

    @classmethod
    def open(cls, spark: SparkSession, root: str, store_id: str, **kw: Any) -> DurableStore:
        """Recover: the current generation and the transactions after it, which must follow each other without a gap."""
        s = cls(spark, root, store_id, **kw)
        if s.inspect() == "missing":
            raise StoreError("NOT_FOUND", "there is no store")
        s.recover()
        return s

    def inspect(self) -> str:
        """``active``, ``legacy-json`` where there is only a snapshot document, or ``missing``."""
        if self._generations.head():
            return "active"
        return "legacy-json" if "snapshot.json" in file_names(self.spark, self.root) else "missing"

    def recover(self, verify: bool = False) -> list[str]:
        """Take up the current generation and the log after it. Gives the torn frames put aside: only the last one may be torn.

        Each frame must name this store and epoch, follow the one before and hold its digest. ``verify`` reads the
        generation against its digests too. Files of writers that were lost are deleted.
        """
        if verify:
            self._generations.verify()
        head = self._generations.read("head").first()
        self.epoch, self.tip, self._last, self._bytes, self._known = head.epoch, int(head.tx_id), "", 0, {}
        for name in file_names(self.spark, f"{self.root}/wal"):
            if name.startswith("_"):
                delete_path(self.spark, f"{self.root}/wal/{name}")
        numbers, torn = self._wal_numbers(), []
        texts = self.spark.read.text([self._wal(n) for n in numbers], wholetext=True).select("value").collect() if numbers else []  # at most the envelope
        frames = {}
        for r in texts:
            try:
                f = json.loads(r.value)
                frames[f["tx_id"]] = (f, hashlib.sha256(r.value.encode()).hexdigest())
            except (ValueError, KeyError, TypeError):
                continue
        for tx in numbers:
            if tx <= self.tip:
                continue
            if tx not in frames:
                if tx != numbers[-1]:
                    raise StoreError("PERSISTENCE_CORRUPTION", f"transaction {tx} is no frame")
                torn.append(self._put_aside(tx))
                break
            f, digest = frames[tx]
            follows = f["store_id"] == self.store_id and f["epoch_id"] == self.epoch and tx == self.tip + 1 and f["base"]["tx"] == self.tip and (not self._last or f["base"]["digest"] == self._last)
            if not follows:
                raise StoreError("PERSISTENCE_CORRUPTION", f"transaction {tx} does not follow {self.tip}")
            self._note(f, digest)
        return torn

    def _put_aside(self, tx: int) -> str:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        to = f"{self.root}/torn-{tx}-{uuid.uuid4().hex[:8]}"
        path(to).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(path(self._wal(tx)), path(to))
        return to

    def _note(self, frame: dict[str, Any], digest: str) -> None:
        """Keep what later commits ask about a frame of the active log."""
        self.tip, self._last = frame["tx_id"], digest
        self._bytes += frame["bytes"]
        self._known[frame["mutation_id"]] = {"mutation_id": frame["mutation_id"], "tx_id": str(frame["tx_id"]), "intent_digest": frame["intent_digest"], "operations": [o["type"] for o in frame["ops"]]}

    def close(self) -> None:
        """No commit is taken any more."""
        self.closed = True

    # --- reading

    def transactions(self) -> DataFrame:
        """The log since the current generation, payloads resolved."""
        numbers = self._wal_numbers()
        if not numbers:
            return self.spark.createDataFrame([], FRAME_SCHEMA)
        frames = self.spark.read.schema(FRAME).json([self._wal(n) for n in numbers]).withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
        stored = self._objects()
        if not stored:
            return frames
        own = [c for c in frames.columns if c != "ops"]
        by_reference = F.col("op.version") == BY_REFERENCE
        each = frames.select(*own, F.posexplode("ops").alias("at", "op")).select("*", F.when(by_reference, F.col("op.payload")).alias("digest"), F.when(~by_reference, F.col("op.payload")).alias("payload"))
        have = self.spark.read.text([f"{self.root}/objects/{d}" for d in stored], wholetext=True).select(F.sha2("value", 256).alias("digest"), F.col("value").alias("payload"))
        full = resolved_ops(each, have)
        op = F.struct(F.col("op.type").alias("type"), F.when(F.col("digest").isNotNull(), "1").otherwise(F.col("op.version")).alias("version"), F.when(F.col("missing"), F.raise_error(F.lit("PERSISTENCE_CORRUPTION: an object is missing"))).otherwise(F.col("payload")).alias("payload"))
        whole = full.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("at", op.alias("op")))).alias("l"))
        return frames.drop("ops").join(whole.select("tx_id", F.col("l.op").alias("ops")), "tx_id").select(*frames.columns)

    def _objects(self) -> list[str]:
        return [n for n in file_names(self.spark, f"{self.root}/objects") if len(n) == 64]

    def objects(self) -> DataFrame:
        """``store_id, obj_kind, obj_id, body`` of everything that exists."""
        base = self._generations.read("objects")
        log = self.transactions()
        edge = F.col("obj_kind") == "graph-edge"
        ends = [F.when(edge, F.get_json_object("body", f"$.{c}")).alias(c) for c in ("source", "target")]
        zero = F.lit(0).cast("decimal(38,0)")
        old = base.select("store_id", "obj_kind", "obj_id", zero.alias("tx_id"), F.lit(0).alias("op_ord"), F.lit(True).alias("is_put"), *ends, F.lit(None).cast("string").alias("mutation_id"))
        ops = without_replays(explode_ops(log), commits_of(log))
        live = merge_runs(old.unionByName(ops)).select("store_id", "obj_kind", "obj_id", "tx_id")
        bodies = log.select("store_id", "tx_id", F.explode("ops").alias("op")).select("store_id", F.regexp_extract("op.type", r"^ether\.(.+)\.put$", 1).alias("obj_kind"), F.get_json_object("op.payload", "$.id").alias("obj_id"), "tx_id", F.col("op.payload").alias("body"))
        every = base.withColumn("tx_id", zero).unionByName(bodies.where("obj_kind != ''"))
        return live.join(every, ["store_id", "obj_kind", "obj_id", "tx_id"]).dropDuplicates(["store_id", "obj_kind", "obj_id"]).select("store_id", "obj_kind", "obj_id", "body")

    def state(self, kind: str) -> DataFrame:
        return self.objects().where(F.col("obj_kind") == kind).select(F.col("obj_id").alias("id"), "body")

    def get(self, kind: str, object_id: str) -> dict[str, Any]:
        row = self.state(kind).where(F.col("id") == object_id).first()
        if row is None:
            raise StoreError("NOT_FOUND", f"no {kind} has this id")
        return json.loads(row.body)

    def receipt(self, mutation_id: str) -> dict[str, Any] | None:
        """The receipt of a mutation, from the active log or the ledger."""
        if mutation_id in self._known:
            return dict(self._known[mutation_id])
        found = self._generations.read("ledger").where(F.col("mutation_id") == mutation_id).first()
        return found and {"mutation_id": mutation_id, "tx_id": str(found.tx_id), "intent_digest": found.intent_digest, "operations": list(found.op_types)}

    # --- writing

    def commit(self, mutation_id: str, command: dict[str, Any]) -> dict[str, Any]:
        """Commit a command once. The same id with the same intent gives the first receipt again; with another it is refused."""
        if self.closed:
            raise StoreError("CLOSED", "the store is closed")
        if not isinstance(mutation_id, str) or not mutation_id.strip():
            raise StoreError("INVALID_INPUT", "a mutation needs a stable id")
        intent = intent_digest(command)
        known = self.receipt(mutation_id)
        if known:
            legacy = intent_digest({"kind": "note.update", "id": command.get("id"), "patch": {"status": "active"}}) if command.get("kind") == "note.promote" else intent
            if known["intent_digest"] not in (intent, legacy):
                raise StoreError("PERSISTENCE_CORRUPTION", "the mutation id was used for another intent")
            return known | {"status": "already-committed"}
        ops = self._effects(command)
        size = sum(len(p.encode()) for _, _, p in ops)
        if self._bytes + size > self.envelope:
            raise StoreError("RECOVERY_REQUIRED", "the active log is full; rotate first")
        tx = self.tip + 1
        sent = [self._sent(o, size > INLINE_TOTAL) for o in ops]
        at = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="milliseconds")
        frame = {"store_id": self.store_id, "epoch_id": self.epoch, "tx_id": tx, "base": {"epoch": self.epoch, "tx": self.tip, "digest": self._last or None}, "mutation_id": mutation_id, "intent_digest": intent, "ops": sent, "bytes": size, "received_at": at}
        text = json.dumps(frame, ensure_ascii=False, separators=(",", ":"))
        if not place(self.spark, text, self._wal(tx)):
            raise StoreError("STALE_TRANSACTION_BASE", "another writer committed first; recover")
        self._note(frame, hashlib.sha256(text.encode()).hexdigest())
        return {"mutation_id": mutation_id, "tx_id": str(tx), "intent_digest": intent, "operations": [o[0] for o in ops], "status": "committed"}

    def _sent(self, op: tuple[str, str, str], all_by_reference: bool) -> dict[str, str]:
        """An operation as it travels. A large payload is installed first as an object under its digest, where an equal one may be."""
        kind, version, payload = op
        if len(payload.encode()) <= INLINE_OP and not all_by_reference:
            return {"type": kind, "version": version, "payload": payload}
        digest = hashlib.sha256(payload.encode()).hexdigest()
        place(self.spark, payload, f"{self.root}/objects/{digest}")
        return {"type": kind, "version": BY_REFERENCE, "payload": digest}

    def _effects(self, c: dict[str, Any]) -> list[tuple[str, str, str]]:
        """The operations of a command, prepared on the current state."""
        put = lambda kind, body: (f"ether.{kind}.put", "1", data_json(body).decode())
        remove = lambda kind, i: (f"ether.{kind}.remove", "1", json.dumps({"id": i}))
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        kind, _, verb = c.get("kind", "").partition(".")
        node = {"note": "memory", "diary": "diary"}.get(kind)
        if kind == "graph-edge" and verb == "put":
            for end in ("source", "target"):
                self.get("graph-node", c[end])
            pair = self.state("graph-edge").where((F.get_json_object("body", "$.source") == c["source"]) & (F.get_json_object("body", "$.target") == c["target"]) | (F.col("id") == c["id"]))
            if not pair.isEmpty():
                raise StoreError("CONFLICT", "the edge exists")
            return [put("graph-edge", {k: c[k] for k in ("id", "source", "target", "relationship")} | {"data": c.get("data", {})})]
        if kind == "note" and verb == "condense":
            made = as_candidate_notes(condensed(self.spark.createDataFrame([(c.get("id") or "", c["text"])], "id string, content string"))).first()
            if made is None:
                raise StoreError("INVALID_INPUT", "content is needed")
            c, verb = {"kind": "note.put", "input": made.asDict(recursive=True) | {"metadata": {}, "provenance": {"kind": made.provenance_kind}}}, "put"
            for extra in ("provenance_kind", "parent_id"):
                c["input"].pop(extra)
        if node and verb == "put":
            body = c["input"]
            if not str(body.get("content", "")).strip():
                raise StoreError("INVALID_INPUT", "content is needed")
            i = body.get("id") or f"{'mem' if kind == 'note' else 'diary'}_{uuid.uuid4().hex[:16]}"
            full = (NOTE_DEFAULTS if kind == "note" else {"tags": [], "metadata": {}}) | body | {"id": i, "content": body["content"].strip(), "createdAt": now, "updatedAt": now}
            ops = [put(kind, full), put("graph-node", {"id": f"{node}:{i}", "type": node, "data": {}})]
            parent = (body.get("provenance") or {}).get("parentDiaryId")
            if parent and not self.state("graph-node").where(F.col("id") == f"diary:{parent}").isEmpty():
                ops.append(put("graph-edge", {"id": f"edge_{uuid.uuid4().hex[:16]}", "source": f"memory:{i}", "target": f"diary:{parent}", "relationship": "derived_from", "data": {}}))
            return ops
        if node and verb in ("update", "promote"):
            old = self.get(kind, c["id"])
            patch = c.get("patch", {})
            if verb == "promote":
                if old.get("status") != "candidate":
                    raise StoreError("CONFLICT", "only a candidate is promoted")
                patch = {"status": "active"}
            if kind == "note" and old.get("pinned") and "content" in patch and patch["content"] != old["content"]:
                raise StoreError("CONFLICT", "the content of a pinned note stays")
            return [put(kind, old | patch | {"id": c["id"], "updatedAt": now})]
        if node and verb == "remove":
            self.get(kind, c["id"])
            return [remove(kind, c["id"]), remove("graph-node", f"{node}:{c['id']}")]
        raise StoreError("INVALID_INPUT", "no such command")

    # --- maintenance

    def rotate(self) -> str:
        """Write state and receipts as a new generation, read it back, publish it, then drop the log it covers. An identity both in the
        ledger and in the log is corruption."""
        covered = self._wal_numbers()
        ledger = merge_ledgers(self._generations.read("ledger"), receipts(self.transactions()))
        if not ledger.where("corrupt").isEmpty():
            raise StoreError("PERSISTENCE_CORRUPTION", "a mutation id comes up twice in retired history")
        name = self._publish(self.objects(), ledger.drop("corrupt").repartitionByRange("mutation_id").sortWithinPartitions("mutation_id"))
        for tx in covered:
            delete_path(self.spark, self._wal(tx))
        self._last, self._bytes, self._known = "", 0, {}
        return name

    def sweep(self) -> dict[str, int]:
        """Delete the objects no transaction of the active log names. One named but not there is corruption."""
        numbers, stored = self._wal_numbers(), self._objects()
        inventory = self.spark.createDataFrame([(d,) for d in stored], "digest string")
        marks = self.spark.createDataFrame([], "digest string")
        if numbers:
            named = self.spark.read.schema(FRAME).json([self._wal(n) for n in numbers]).select(F.explode("ops").alias("op")).where(F.col("op.version") == BY_REFERENCE)
            marks = named.select(F.col("op.payload").alias("digest"))
        free, lost = reclaimable(inventory, marks)
        if not lost.isEmpty():
            raise StoreError("PERSISTENCE_CORRUPTION", "an object is missing")
        gone = [r.digest for r in free.collect()]  # names of files the driver listed
        for d in gone:
            delete_path(self.spark, f"{self.root}/objects/{d}")
        return {"scanned": len(stored), "marked": len(stored) - len(gone), "reclaimed": len(gone)}

    def collect_garbage(self) -> list[str]:
        """Delete superseded generations and unnamed objects; gives the names of the generations."""
        self.sweep()
        return self._generations.collect_garbage()

    def maintain(self) -> dict[str, Any]:
        """Rotate where the log could not take another mutation of the largest size, and only then collect garbage."""
        active, bound = self._bytes, min(MUTATION_BOUND, self.envelope)
        plan = {"active_bytes": active, "envelope_bytes": self.envelope, "headroom_bytes": self.envelope - active, "rotate": active + bound > self.envelope}
        if not plan["rotate"]:
            return plan | {"performed": []}
        self.rotate()
        return plan | {"performed": ["rotation", "garbage"], "collected": len(self.collect_garbage())}

    # --- parts

    def _publish(self, objects: DataFrame, ledger: DataFrame) -> str:
        head = self.spark.createDataFrame([(self.epoch, str(self.tip))], "epoch string, tx_id string")
        return self._generations.publish({"objects": objects, "ledger": ledger, "head": head}, expect=self._generations.head())

    def _no_receipts(self) -> DataFrame:
        return receipts(self.spark.createDataFrame([], FRAME_SCHEMA))

    def _wal(self, tx: int) -> str:
        return f"{self.root}/wal/tx-{tx}.json"

    def _wal_numbers(self) -> list[int]:
        return sorted(int(n[3:-5]) for n in file_names(self.spark, f"{self.root}/wal") if n.startswith("tx-") and n.endswith(".json"))
