import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from recollect.operators import change_log
from recollect.operators.change_log import ChangeLog, current_state
from recollect.streaming.log_stream import FRAME_SCHEMA, StreamingReplay, chain_watch, read_frames

KINDS = ("note", "diary", "graph-node", "graph-edge")


def op(kind, verb, **body):
    return (f"ether.{kind}.{verb}", "1", json.dumps(body))


def frame(store, tx, mutation, ops, at=0):
    return (store, "e", Decimal(tx), ("e", Decimal(tx - 1), "d"), mutation, "i", ops, datetime(2024, 1, 1) + timedelta(seconds=at))


def replay(frames):
    """The state by one ordered pass."""
    out = set()
    for store in {f[0] for f in frames if f[0] is not None}:
        seen, state = set(), {}
        for f in sorted({x[2]: x for x in frames if x[0] == store and x[6] is not None}.values(), key=lambda f: f[2]):
            if f[4] is not None and f[4] in seen:
                continue
            seen.add(f[4])
            for kind, _, body in f[6]:
                parts = kind.split(".")
                if len(parts) != 3 or parts[1] not in KINDS or parts[2] not in ("put", "remove"):
                    continue
                b = json.loads(body)
                key = (parts[1], b.get("id"))
                if key[1] is None:
                    continue
                if parts[2] == "put":
                    state[key] = (f[2], b)
                elif key in state:
                    del state[key]
                    if parts[1] == "graph-node":
                        for e in [e for e, (_, x) in state.items() if e[0] == "graph-edge" and b["id"] in (x.get("source"), x.get("target"))]:
                            del state[e]
        out |= {(store, k, i, str(t)) for (k, i), (t, _) in state.items()}
    return out


def state(df):
    return {(r.store_id, r.obj_kind, r.obj_id, str(r.tx_id)) for r in df.collect()}


def random_feed(seed, n=160):
    r, frames = random.Random(seed), []
    for tx in range(1, n + 1):
        store, ops = r.choice("aaab"), []
        for _ in range(r.randint(0, 3)):
            kind, verb, i = r.choice(KINDS), r.choice(("put", "put", "remove")), f"x{r.randint(0, 5)}"
            body = {"id": i}
            if kind == "graph-edge" and verb == "put":
                body |= {"source": f"x{r.randint(0, 5)}", "target": f"x{r.randint(0, 5)}"}
            ops.append(op(kind, verb, **body))
        frames.append(frame(store, tx, f"m{r.randint(0, n)}", ops, r.randint(0, 999)))
    frames += [f[:7] + (f[7] + timedelta(hours=1),) for f in r.sample(frames, n // 8)]
    r.shuffle(frames)
    return frames


def test_random_feeds_in_any_order(spark):
    for seed in range(3):
        frames = random_feed(seed)
        assert state(current_state(spark.createDataFrame(frames, FRAME_SCHEMA), runs=4, fan_in=2)) == replay(frames)


def absent(frames):
    """Removes that find nothing, by one ordered pass."""
    out = []
    for store in {f[0] for f in frames}:
        seen, state = set(), {}
        for f in sorted({x[2]: x for x in frames if x[0] == store}.values(), key=lambda f: f[2]):
            if f[4] in seen:
                continue
            seen.add(f[4])
            for kind, _, body in f[6]:
                _, kind, verb = kind.split(".")
                b = json.loads(body)
                if verb == "put":
                    state[kind, b["id"]] = b
                elif state.pop((kind, b["id"]), None) is None:
                    out.append((store, kind, b["id"], str(f[2])))
                elif kind == "graph-node":
                    for e in [e for e, x in state.items() if e[0] == "graph-edge" and b["id"] in (x["source"], x["target"])]:
                        del state[e]
    return sorted(out)


def test_absent_removes_report_every_kind(spark, monkeypatch):
    def found(frames):
        w = spark.createDataFrame(frames, FRAME_SCHEMA)
        ops = change_log.without_replays(change_log.explode_ops(w.dropDuplicates(["store_id", "tx_id"])), change_log.commits_of(w))
        return sorted((r.store_id, r.obj_kind, r.obj_id, str(r.tx_id)) for r in change_log.absent_removes(ops).collect())

    node, edge = op("graph-node", "put", id="n"), op("graph-edge", "put", id="e", source="n", target="k")
    no_node, no_edge = op("graph-node", "remove", id="n"), op("graph-edge", "remove", id="e")
    steps = [[no_edge], [node, edge], [no_node], [node], [no_edge], [edge], [no_edge], [no_edge], [edge, no_node, node, no_edge]]
    frames = [frame("s", i, f"m{i}", ops) for i, ops in enumerate(steps, 1)]
    assert found(frames) == [("s", "graph-edge", "e", str(t)) for t in (1, 5, 8, 9)] == absent(frames)
    for block in (change_log.BLOCK, 7):
        monkeypatch.setattr(change_log, "BLOCK", block)
        for seed in range(2):
            frames = random_feed(seed, 320)
            want = absent(frames)
            assert found(frames) == want and any(k == "graph-edge" for _, k, _, _ in want)


def test_compaction_keeps_what_a_late_transaction_may_uncover(spark):
    log = ChangeLog.temporary(spark, fan_in=2)
    log.append(spark.createDataFrame([frame("s", 5, "m", [op("note", "put", id="a")]), frame("s", 4, "k", [op("note", "put", id="a")])], FRAME_SCHEMA))
    log.append(spark.createDataFrame([frame("s", 6, "z", [op("note", "put", id="b")])], FRAME_SCHEMA))
    assert len(log.runs()) == 1
    assert state(log.read()) == {("s", "note", "a", "5"), ("s", "note", "b", "6")}
    log.append(spark.createDataFrame([frame("s", 2, "m", [])], FRAME_SCHEMA))  # owns m: transaction 5 never took effect
    assert state(log.read()) == {("s", "note", "a", "4"), ("s", "note", "b", "6")}
    log.compact()
    assert len(log.runs()) == 1 and state(log.read()) == {("s", "note", "a", "4"), ("s", "note", "b", "6")}


def test_a_log_goes_on_in_a_later_session(spark):
    frames = random_feed(5)
    log = ChangeLog.temporary(spark, fan_in=2)
    for i in range(5):
        log = ChangeLog.open(spark, log.root) if i else log
        log.append(spark.createDataFrame(frames[i::5], FRAME_SCHEMA))
        again = ChangeLog.open(spark, log.root)
        assert again.levels == log.levels and again.fan_in == 2
    assert state(again.read()) == replay(frames)
    again._write(again.rows(again.runs()))  # not published: a driver lost here
    assert ChangeLog.open(spark, log.root).levels == log.levels
    last = ChangeLog.open(spark, log.root)
    last.compact()
    assert len(ChangeLog.open(spark, log.root).runs()) == 1 and state(ChangeLog.open(spark, log.root).read()) == replay(frames)
    with pytest.raises(ValueError, match="CONFLICT"):
        log.append(spark.createDataFrame(frames[:1], FRAME_SCHEMA))
    assert state(ChangeLog.open(spark, log.root).read()) == replay(frames)
    assert ChangeLog.open(spark, log.root + "-none").read().count() == 0


def test_defined_results_for_odd_rows(spark):
    frames = [
        frame(None, 1, "m", [op("note", "put", id="a")]),
        frame("s", 2, None, [op("note", "put", id="b"), op("identity", "put", id="x"), ("ether.note.put", "1", '{"nested": {"id": "c"}}'), ("ether.note.put", "1", "no json")]),
        frame("s", 3, None, [op("note", "put", id="b" * 70000)]),
        ("s", "e", Decimal(4), None, "m4", "i", None, None),
    ]
    df = spark.createDataFrame(frames, FRAME_SCHEMA)
    assert state(current_state(df)) == {("s", "note", "b", "2"), ("s", "note", "b" * 70000, "3")}
    assert state(current_state(df.limit(0))) == set()
    assert ChangeLog.temporary(spark).read().count() == 0


def test_streaming_replay_equals_batch(spark, tmp_path):
    frames = random_feed(7)
    for i in range(3):
        spark.createDataFrame(frames[i::3], FRAME_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = StreamingReplay(ChangeLog.temporary(spark))
    run.start(read_frames(spark, str(tmp_path / "in"), 1), str(tmp_path / "cp")).awaitTermination(120)
    assert state(run.log.read()) == replay(frames)
    runs = run.log.runs()
    again = StreamingReplay(ChangeLog.open(spark, run.log.root))  # a restart
    again(spark.createDataFrame(frames, FRAME_SCHEMA), 2)  # a batch given again changes nothing
    assert again.log.runs() == runs and state(again.log.read()) == replay(frames)
    spark.createDataFrame([frame("z", 1, "m", [op("note", "put", id="late")])], FRAME_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again.start(read_frames(spark, str(tmp_path / "in"), 1), str(tmp_path / "cp")).awaitTermination(120)
    assert state(again.log.read()) == replay(frames) | {("z", "note", "late", "1")}


def test_compaction_drops_what_cannot_show(spark):
    frames = random_feed(11, 240)
    log = ChangeLog.temporary(spark, fan_in=9, buckets=3)
    for i in range(3):
        log.append(spark.createDataFrame(frames[i::3], FRAME_SCHEMA))
    sizes = [log.rows(log.runs()).count()]
    log.compact()
    sizes.append(log.rows(log.runs()).count())
    late = [frame("a", 1000, "n1", [op("graph-node", "remove", id="x1"), op("graph-edge", "put", id="x9", source="x1", target="x2")]), frame("a", 1001, "n2", [op("graph-node", "remove", id="x1")]), frame("b", 1002, "m3", [op("note", "put", id="new")])]
    settled = spark.createDataFrame([("a", Decimal(10**6)), ("b", Decimal(100))], "store_id string, settled_tx decimal(38,0)")
    log.compact(settled)
    sizes.append(log.rows(log.runs()).count())
    assert sizes[0] > sizes[1] > sizes[2] and state(log.read()) == replay(frames)
    log.append(spark.createDataFrame(late, FRAME_SCHEMA))
    assert state(log.read()) == replay(frames + late)


def test_a_hot_key_is_many_buckets_work(spark, monkeypatch):
    """A third of all operations on one object: no bucket holds them all, and the merge before the combination by key shuffles nothing."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(change_log, "BLOCK", 16)
    frames = [frame("s", t, f"m{t}", [op("note", "put", id="hot" if t % 3 == 0 else f"x{t}")]) for t in range(1, 601)]
    log = ChangeLog.temporary(spark, buckets=4)
    log.append(spark.createDataFrame(frames, FRAME_SCHEMA))
    log.append(spark.createDataFrame(frames[:90], FRAME_SCHEMA))
    rows = log.rows(log.runs())
    held = [r.n for r in rows.where("obj_id = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(held) == 4 and max(held) < 150
    plan = rows.groupBy(*change_log.CLUSTER).agg(F.max("tx_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Batched: true" in plan
    assert state(log.read()) == replay(frames)
    bad = frames + [frame("s", 700 + t, "m1", [op("note", "put", id="again")]) for t in range(300)]
    lost = change_log.without_effect(change_log.log_rows(spark.createDataFrame(bad, FRAME_SCHEMA)), hot_rows=20)
    assert lost.count() == 300 and state(current_state(spark.createDataFrame(bad, FRAME_SCHEMA))) == replay(bad)


def test_chain_watch(spark, tmp_path):
    frames = [frame("s", t, f"m{t}", []) for t in (1, 2, 4, 4)]
    spark.createDataFrame(frames, FRAME_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = chain_watch(read_frames(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("watch").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.tx_id, r.status) for r in spark.table("watch").collect()) == [("1", "next"), ("2", "next"), ("4", "again"), ("4", "gap")]
