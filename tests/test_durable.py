import json
import time

import pytest

from recollect.operators import adapters, portable
from recollect.sources.ports import JsonPort, ParquetPort, import_snapshot, read_chunks, read_portable
from recollect.store import FIRST_TX, DurableStore, StoreError


def test_commits_recovery_and_maintenance(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = DurableStore.create(spark, root, "s")
    with pytest.raises(StoreError):
        DurableStore.create(spark, root, "s")
    first = s.commit("m1", {"kind": "diary.put", "input": {"id": "d", "content": " day "}})
    assert (first["tx_id"], first["status"]) == (str(FIRST_TX), "committed")
    s.commit("m2", {"kind": "note.put", "input": {"id": "n", "content": "note", "status": "candidate", "pinned": True, "provenance": {"parentDiaryId": "d"}}})
    assert s.commit("m1", {"kind": "diary.put", "input": {"id": "d", "content": " day "}}) == first | {"status": "already-committed"}
    for mutation, command, code in (
        ("m1", {"kind": "diary.put", "input": {"id": "d", "content": "other"}}, "PERSISTENCE_CORRUPTION"),
        ("m3", {"kind": "note.update", "id": "n", "patch": {"content": "x"}}, "CONFLICT"),
        ("m3", {"kind": "note.remove", "id": "nowhere"}, "NOT_FOUND"),
        ("m3", {"kind": "graph-edge.put", "id": "e", "source": "memory:n", "target": "diary:d", "relationship": "about"}, "CONFLICT"),
        ("m3", {"kind": "note.put", "input": {"content": "  "}}, "INVALID_INPUT"),
        (" ", {"kind": "note.remove", "id": "n"}, "INVALID_INPUT"),
    ):
        with pytest.raises(StoreError) as x:
            s.commit(mutation, command)
        assert x.value.code == code
    s.commit("m4", {"kind": "note.promote", "id": "n"})
    assert s.get("note", "n")["status"] == "active" and s.get("diary", "d")["content"] == "day"
    assert s.state("graph-edge").count() == 1
    again = DurableStore.open(spark, root, "s")
    assert again.tip == s.tip == FIRST_TX + 2 and sorted(map(tuple, again.objects().collect())) == sorted(map(tuple, s.objects().collect()))
    with pytest.raises(StoreError) as x:
        again.tip -= 1
        again.commit("m5", {"kind": "note.update", "id": "n", "patch": {"tags": ["t"]}})
    assert x.value.code == "STALE_TRANSACTION_BASE"
    again.recover()
    assert s.maintain()["performed"] == []
    before = sorted(map(tuple, s.objects().collect()))
    s.rotate()
    assert sorted(map(tuple, s.objects().collect())) == before and s.transactions().count() == 0
    assert s.receipt("m1")["tx_id"] == first["tx_id"] and len(s.collect_garbage()) == 1
    s.commit("m6", {"kind": "diary.remove", "id": "d"})
    assert DurableStore.open(spark, root, "s").state("graph-edge").count() == 0
    s.envelope = 10
    assert s.maintain()["performed"] == ["rotation", "garbage"]
    with pytest.raises(StoreError) as x:
        s.commit("m7", {"kind": "note.remove", "id": "n"})
    assert x.value.code == "RECOVERY_REQUIRED"


def test_two_writers_torn_frames_and_broken_chains(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "snapshot.json").write_text("{}")
    assert DurableStore(spark, root, "s").inspect() == "legacy-json"
    (tmp_path / "store" / "snapshot.json").unlink()
    one = DurableStore.create(spark, root, "s")
    two = DurableStore.open(spark, root, "s")
    one.commit("m1", {"kind": "diary.put", "input": {"id": "a", "content": "first"}})
    with pytest.raises(StoreError) as x:
        two.commit("m2", {"kind": "diary.put", "input": {"id": "b", "content": "second"}})
    assert x.value.code == "STALE_TRANSACTION_BASE" and two.state("diary").count() == 1
    assert two.recover(verify=True) == [] and two.commit("m2", {"kind": "diary.put", "input": {"id": "b", "content": "second"}})["tx_id"] == str(FIRST_TX + 1)
    wal = tmp_path / "store" / "wal"
    (wal / "_tx-lost").write_text("left by a lost writer")
    (wal / f"tx-{FIRST_TX + 2}.json").write_text('{"store_id": "s", "tx_')
    assert len(one.recover()) == 1 and one.tip == FIRST_TX + 1 and sorted(p.name for p in wal.iterdir() if p.name[0] != ".") == [f"tx-{FIRST_TX + i}.json" for i in range(2)]
    for wrong in ('"store_id":"t"', '"tx":1'):
        frame = (wal / f"tx-{FIRST_TX + 1}.json").read_text().replace(f'"tx_id":{FIRST_TX + 1}', f'"tx_id":{FIRST_TX + 2}')
        frame = frame.replace('"store_id":"s"', wrong) if "store" in wrong else frame
        (wal / f"tx-{FIRST_TX + 2}.json").write_text(frame)
        with pytest.raises(StoreError) as x:
            one.recover()
        assert x.value.code == "PERSISTENCE_CORRUPTION"
    one.close()
    with pytest.raises(StoreError) as x:
        one.commit("m9", {"kind": "diary.remove", "id": "a"})
    assert x.value.code == "CLOSED"


def test_large_payloads_are_objects(spark, tmp_path):
    s = DurableStore.create(spark, f"file://{tmp_path}/store", "s")
    big = "y" * 100_000
    s.commit("m1", {"kind": "diary.put", "input": {"id": "a", "content": big}})
    s.commit("m2", {"kind": "diary.put", "input": {"id": "b", "content": "small"}})
    objects = tmp_path / "store" / "objects"
    assert len([p for p in objects.iterdir() if len(p.name) == 64]) == 1
    assert s.get("diary", "a")["content"] == big and s.sweep() == {"scanned": 1, "marked": 1, "reclaimed": 0}
    again = DurableStore.open(spark, s.root, "s")
    assert again._bytes == s._bytes and again.get("diary", "b")["content"] == "small"
    made = again.commit("m3", {"kind": "note.condense", "text": "We shipped the release today. " * 20})
    note = json.loads(again.state("note").first().body)
    assert made["operations"][0] == "ether.note.put" and (note["status"], note["source"], note["category"]) == ("candidate", "ai", "project") and len(note["content"]) == 200
    again.rotate()
    assert again.sweep() == {"scanned": 1, "marked": 0, "reclaimed": 1} and again.get("diary", "a")["content"] == big
    data = next((tmp_path / "store" / "generations" / again._generations.head() / "objects").glob("*.parquet"))
    assert set(again._generations.verify()) == {"objects", "ledger", "head"}
    spark.createDataFrame([("s", "diary", "a", "{}")], "store_id string, obj_kind string, obj_id string, body string").coalesce(1).write.mode("append").parquet(str(data.parent))
    with pytest.raises(ValueError, match="PERSISTENCE_CORRUPTION"):
        again._generations.verify()


def test_summaries():
    text, refs = "x" * 50, [("note", "a"), ("diary", "b")]
    find = {"note": "first text", "diary": "second"}
    assert adapters.summarize(10, text).text == "x" * 10
    assert adapters.summarize(10, text, fall_back=False).route == "unavailable"
    assert adapters.summarize(10, text, disclose=True, host=lambda p: "short").origin == "host"
    assert adapters.summarize(10, text, disclose=True, host=lambda p: "y" * 11).reason == "host_output_invalid"
    assert adapters.summarize(10, text, disclose=True, host=lambda p: 1 / 0).reason == "host_failed"
    assert adapters.summarize(10, text, disclose=True, host=lambda p: time.sleep(0.5), timeout=0.1).reason == "timeout"
    local = adapters.summarize(13, references=refs, resolve=lambda k, i: find[k])
    assert (local.text, local.sources) == ("first text\nse", ("note:a", "diary:b"))
    assert adapters.summarize(20, references=refs, resolve=lambda k, i: find[k], disclose=True, host=lambda p: p["evidence"][1]["excerpt"]).route == "hybrid"
    for bad in ({"text": None}, {"text": "a", "references": refs}, {"references": [("page", "a")]}, {"references": refs + refs}, {"references": [("node", "a")]}):
        with pytest.raises(ValueError):
            adapters.summarize(5, **bad)


def test_reading_interchange_records(spark, tmp_path):
    rows = [{"schema": "v", "id": str(i), "kind": "note", "text": "t", "tags": ["a"]} for i in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("array.json", "lines.json"):
        got = read_portable(spark, str(tmp_path / name)).orderBy("record_index").collect()
        assert [(r.id, r.record_index, r.tags) for r in got] == [(str(i), i, ["a"]) for i in range(3)]
    with pytest.raises(ValueError):
        read_portable(spark, str(tmp_path / "array.json"), 10)
    rows[1]["extra"] = [[[[[[[[["deep"]]]]]]]]]
    data = json.dumps(rows).encode()
    chunks = read_chunks(spark, [data[i : i + 7] for i in range(0, len(data), 7)])
    issues = {(r.record_index, r.code, r.field_path) for r in portable.record_issues(chunks).collect()}
    assert (1, "INPUT_LIMIT_EXCEEDED", "$") in issues and {(i, c) for i, c, _ in issues if i == 1} == {(1, "INPUT_LIMIT_EXCEEDED")} and (0, "UNSUPPORTED_SCHEMA", "schema") in issues
    with pytest.raises(ValueError):
        read_chunks(spark, ["[", "x" * 20], 10)


def test_a_snapshot_is_imported_whole_or_not(spark, tmp_path):
    def snapshot(name, notes):
        doc = {"schemaVersion": "v", "identity": {"userId": "u"}, "memoryNotes": notes, "diary": [{"id": "d", "content": "x", "createdAt": "2024-01-01T00:00:00.000Z", "updatedAt": "2024-01-01T00:00:00.000Z", "tags": []}], "graph": {"nodes": [{"id": "memory:a", "type": "memory"}, {"id": "diary:d", "type": "diary"}], "edges": [{"id": "e", "source": "memory:a", "target": "diary:d", "relationship": "about"}]}}
        (tmp_path / name).write_text(json.dumps(doc))
        return JsonPort(spark, str(tmp_path / name), {})

    note = {"id": "a", "content": "c", "createdAt": 1704067200000, "updatedAt": "2024-01-02T00:00:00.000Z", "tags": ["t"]}
    store = ParquetPort(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="note b: status"):
        import_snapshot(snapshot("bad.json", [note, note | {"id": "b", "status": "gone"}]), store)
    assert store.store.head() is None
    import_snapshot(snapshot("good.json", [note]), store)
    got = store.load()["notes"].first()
    assert (got.id, str(got.created_at), str(got.updated_at)) == ("a", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    snap = JsonPort(spark, str(tmp_path / "out"), {"schemaVersion": "v"})
    for _ in range(2):
        snap.save(store.load())
    assert snap.load()["notes"].count() == 1 and not list(tmp_path.glob("out.*"))
    (tmp_path / "out").rename(tmp_path / "out.before")  # a writer lost between its renames
    assert snap.load()["edges"].first().id == "e"
