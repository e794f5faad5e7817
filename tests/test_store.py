import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions.canonical import EncodingError, canonical_json, data_json, depth_and_size
from recollect.functions.text import code_unit_key, code_unit_length, contains_phrase, cut_units, query_tokens, strip_white, tokens, units
from recollect.operators import context, dream, graph, note_index as index_module, portable, retrieval
from recollect.operators.condense import condensed, summary
from recollect.operators.note_index import NoteIndex
from recollect.operators.retrieval import Query, note_index, query_notes
from recollect.plans.queries import all_queries
from recollect.sources.snapshot import GenerationStore, read_snapshot, write_snapshot

NOTE = "id string, content string, summary string, category string, tags array<string>, importance double, confidence double, pinned boolean, status string, created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz, metadata string"
EDGE = "id string, source string, target string, relationship string"


def day(n):
    return datetime(2020, 1, n)


def note(i, content, status="active", importance=0.5, confidence=0.75, at=1, tags=(), expires=None, summary=None, category=None, metadata="{}", pinned=False):
    return (i, content, summary, category, list(tags), importance, confidence, pinned, status, day(at), day(at), expires, metadata)


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(
        [
            note("alpha", "TypeScript project memory", importance=0.8, confidence=0.9, at=3, tags=["project", "typescript"], summary="TypeScript project", category="project", metadata='{"claimKey": "language"}'),
            note("beta", "Architecture memory", confidence=0.8, at=4, tags=["architecture"], summary="Architecture", category="project"),
            note("candidate", "TypeScript candidate", "candidate", 0.4, 0.6, 5, ["typescript"]),
            note("archived", "TypeScript archived", "archived", 0.3, 0.5, 6, ["typescript"]),
            note("expired", "TypeScript expired", importance=0.2, confidence=0.4, at=7, expires=day(7), tags=["typescript"]),
        ],
        NOTE,
    )


def edges(spark, rows):
    return spark.createDataFrame([(i, f"memory:{a}", f"memory:{b}", r) for i, a, b, r in rows], EDGE)


def test_tokens(spark):
    texts = ["  Café’s—résumé,\t42 你好!  ", "é, É", "don't stop", None, "", "''", "x" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t"))).collect()]
    assert got == [["café’s", "résumé", "42", "你好"], ["é", "é"], ["don't", "stop"], [], [], [], ["x" * 100_000]]
    assert query_tokens(texts[0]) == got[0] and query_tokens(texts[1]) == got[1]


def test_text_order_and_length_in_code_units(spark):
    df = spark.createDataFrame([("�",), ("\U00010400",), ("a",)], "t string")
    assert [r.t for r in df.orderBy(code_unit_key(F.col("t"))).collect()] == ["a", "\U00010400", "�"]
    assert [r[0] for r in df.orderBy("t").select(code_unit_length(F.col("t"))).collect()] == [1, 1, 2]
    assert spark.createDataFrame([("﻿ 　x y\xa0\x1c",)], "t string").select(strip_white(F.col("t"))).first()[0] == "x y"
    assert spark.range(1).select(contains_phrase(F.array(F.lit("ab"), F.lit("c")), ["b", "c"])).first()[0] is False


def test_retrieval_golden_scores(spark, store):
    index = retrieval.note_index(store)
    got = retrieval.query_notes(index, retrieval.Query("TypeScript", datetime(2020, 2, 1))).select("id", "match_class", "score").collect()
    assert [tuple(r) for r in got] == [("alpha", "exact_phrase", 0.9825)]
    wide = retrieval.Filters(include_candidate=True, include_archived=True, include_expired=True)
    got = retrieval.query_notes(index, retrieval.Query("TypeScript", datetime(2020, 2, 1), wide)).orderBy("rank").select("id", "score").collect()
    assert [tuple(r) for r in got] == [("alpha", 0.9825), ("candidate", 0.9550000000000001), ("archived", 0.9475), ("expired", 0.9400000000000001)]
    recalled = graph.query_with_recall(index, edges(spark, [("edge-alpha-beta", "alpha", "beta", "supports")]), retrieval.Query("TypeScript", datetime(2020, 2, 1)), graph.Recall(1, 1))
    assert [(r.id, r.match_class, r.score, r.path) for r in recalled.orderBy("rank").collect()] == [("alpha", "exact_phrase", 0.9825, None), ("beta", "graph_only", 0.53625, ["edge-alpha-beta"])]


def test_rejected_notes_are_found_and_expiry_is_exclusive(spark):
    index = retrieval.note_index(spark.createDataFrame([note("r", "word", "rejected"), note("e", "word", expires=day(2)), note("l", "word", expires=day(3))], NOTE))
    got = retrieval.query_notes(index, retrieval.Query("word", day(2))).collect()
    assert {r.id for r in got} == {"r", "l"}
    assert retrieval.query_notes(index, retrieval.Query("  !", day(2))).count() == 0
    ids = retrieval.query_notes(index, retrieval.Query("word", day(2), explicit_ids=("l", "nowhere"))).orderBy("rank").collect()
    assert [(r.id, r.match_class) for r in ids] == [("l", "explicit_id"), ("r", "exact_phrase")]


def walk(rows, root, depth, cap):
    """Recall by walking: nodes in order of discovery with their least path."""
    paths, seen, frontier = {}, {root}, [root]
    for _ in range(depth):
        if len(seen) > cap or not frontier:
            break
        new = []
        for here in sorted(frontier):
            for i, a, b in sorted((i, a, b) for i, a, b, _ in rows if here in (a, b) and a != b):
                other = b if a == here else a
                path = [*paths.get(here, []), i]
                if other == root:
                    continue
                if other in paths:
                    if len(paths[other]) == len(path) and path < paths[other]:
                        paths[other] = path
                    continue
                seen.add(other)
                new.append(other)
                paths[other] = path
                if len(seen) > cap:
                    break
            if len(seen) > cap:
                break
        frontier = new
    return paths


def test_recall_equals_a_walk(spark):
    for seed in range(12):
        r = random.Random(seed)
        names, rows, used = "abcdefg", [], set()
        for i in range(r.randint(3, 16)):
            a, b = r.choice(names), r.choice(names)
            if (a, b) not in used:
                used.add((a, b))
                rows.append((f"e{r.randint(0, 99):02d}{i:02d}", a, b, "supports"))
        depth, cap = r.randint(1, 2), r.randint(1, 6)
        got = graph.recall_nodes(edges(spark, rows), spark.createDataFrame([("memory:a",)], "seed string"), graph.Recall(depth, cap)).collect()
        assert {x.node[7:]: x.path for x in got} == walk(rows, "a", depth, cap), (seed, depth, cap)


def test_context_budgets_and_claims(spark):
    notes = spark.createDataFrame([note(f"n{i}", "word " * 30, at=i + 1, metadata='{"claimKey": "k"}') for i in range(4)], NOTE)
    diary = spark.createDataFrame([(f"d{i}", "word again", [], day(i + 1), day(i + 1), None) for i in range(3)], "id string, content string, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, metadata string")
    e = edges(spark, [("e1", "n3", "n0", "about"), ("e2", "n0", "n2", "about"), ("e3", "n1", "n3", "about")])
    nodes = spark.createDataFrame([(f"memory:n{i}",) for i in range(4)], "id string")
    c = context.Context(retrieval.note_index(notes), retrieval.diary_index(diary), nodes, e, retrieval.Query("word", day(20), explicit_ids=("n0",)), context.Budget(3, 2, 3, 2, 320), diary_ids=("d1",))
    items = {r.id: r for r in c.chosen.collect()}
    assert [r.id for r in c.chosen.orderBy("ord").collect()] == ["n0", "n3", "n2", "d1", "d2"]
    assert items["n2"].shown == ("word " * 30)[: 320 - 300 - 3] + "..." and items["d1"].shown == ""
    report = c.report().first().asDict()
    assert report == {"mode": "hybrid", "filters_applied": "", "matched_notes": 3, "matched_diary": 3, "notes_omitted": 1, "diary_omitted": 1, "nodes_omitted": 1, "edges_omitted": 1, "chars_omitted": 150 + 2 * 10 - 20, "hit_budget": True}
    assert [r.ref for r in c.citations().orderBy("ord").collect()] == ["note:n0", "note:n3", "note:n2", "diary:d1", "diary:d2", "node:memory:n0", "node:memory:n2", "node:memory:n3", "edge:e1", "edge:e2"]
    assert [tuple(r) for r in c.claim_flags().collect()] == [("k", ["n0", "n3", "n2"])]


def test_condensation(spark):
    text = "We shipped the library. We  shipped the LIBRARY!\r\nShort.\nThe user prefers dark themes? 你好 world facts."
    r = condensed(spark.createDataFrame([("1", text), ("2", " 　"), ("3", None), ("4", "x" * 300)], "id string, content string")).orderBy("id").collect()
    assert [x.id for x in r] == ["1", "4"]
    assert r[0].key_facts == ["We shipped the library.", "The user prefers dark themes?", "你好 world facts."]
    assert (r[0].category, r[0].tags) == ("project", ["dark", "facts", "library", "prefers", "shipped", "short", "the", "themes"])
    assert r[0].confidence == 0.0 + 0.4 + 0.1 + 0.06 + 0.1 + 0.05 and r[1].summary == "x" * 197 + "..." and r[1].key_facts == []


def test_dream_golden_digests(spark):
    notes = spark.createDataFrame([note(i, "alpha beta", tags=["shared"]) for i in "AB"], NOTE).withColumn("created_at", F.lit(datetime(1970, 1, 1, 0, 0, 0, 10000)).cast("timestamp_ntz"))
    plan = dream.preview(notes, edges(spark, []), dream.Request.normal({"kind": "tags", "tags": ["missing"]}, 100))
    assert plan.fields["dependencyDigest"] == "3b7d9df6e31ade3ca3ff96fd8154cf52fb481bd68d6ceeec4db590e08ba4f857"
    assert plan.plan_id == "8e1cdcc6cdac876342e0b265fe4f26c7ba00a9bcbbcbb716d19ece32afe0f295"
    relation = [{"id": "edge", "source": "A", "target": "é", "relationship": "supports"}]
    made = [dream.proposal(*x, relation, "1" * 64)["proposalId"] for x in (("A", "Alpha fact is stable. Beta fact is useful.", ["Alpha fact is stable.", "Beta fact is useful."]), ("é", "Gamma fact is clear.", ["Gamma fact is clear."]))]
    assert made == ["cfd9456ca0056b5ba695d7bc788a7972dc22a397c8a2bb60dfcc4fe887e880cc", "b098868d876ae692b785670415c614dcbd1664abb502133cda799a1fc6b85f40"]


def test_dream_rules(spark):
    notes = spark.createDataFrame([note("A", "  Alpha fact is stable.  "), note("B", "x", "archived"), note("C", "  Alpha fact is stable.   ")], NOTE)
    e = edges(spark, [("e1", "A", "C", "supports"), ("e2", "A", "A", "about"), ("e3", "A", "B", "about")])
    now = 1_600_000_000_000
    plan = dream.preview(notes, e, dream.Request.normal({"kind": "all_active"}, now))
    assert plan.fields["selectedSourceIds"] == ["A", "C"] and [r["id"] for r in plan.relationships] == ["e1", "e2"]
    result = dream.run(notes, e, plan)
    assert [p["sourceIds"] for p in result["proposals"]] == [["A"]]
    with pytest.raises(dream.DreamError) as x:
        dream.run(notes.where("id != 'C'"), e, plan)
    assert x.value.code == "CONFLICT"
    for ids, code in ((["A", "nowhere"], "NOT_FOUND"), (["B"], "INVALID_INPUT")):
        with pytest.raises(dream.DreamError) as x:
            dream.preview(notes, e, dream.Request.normal({"kind": "ids", "ids": ids}, now))
        assert x.value.code == code
    for bad in ({"kind": "tags", "tags": []}, {"kind": "date-window", "from": 2, "to": 1}, {"kind": "query", "query": "!"}, {"kind": "all_active", "ids": ["A"]}):
        with pytest.raises(dream.DreamError):
            dream.Request.normal(bad, now)


def test_dream_byte_budgets(spark):
    notes = spark.createDataFrame([note("A", "héllo world", tags=["t", "uv", "t"]), note("é", "hello", tags=["t"]), note("CC", "gone", "archived", tags=["long tag"])], NOTE)
    ids, now = 1 + 2 + 2, 1_600_000_000_000
    needs = [({"kind": "all_active"}, ids), ({"kind": "date-window", "from": 0, "to": now}, ids), ({"kind": "tags", "tags": ["t"]}, ids + 3 + 1), ({"kind": "query", "query": "world"}, ids + 12 + 5), ({"kind": "ids", "ids": ["é", "A"]}, 3)]
    for selector, need in needs:
        def ask(**budgets):
            return dream.preview(notes, edges(spark, []), dream.Request.normal(selector, now, budgets))

        whole = max(len(canonical_json(n)) for n in ask().notes)
        assert ask(maxSelectionBytes=need, maxNoteDependencyBytes=whole).notes == ask().notes
        for low in ({"maxSelectionBytes": need - 1}, {"maxNoteDependencyBytes": whole - 1}):
            with pytest.raises(dream.DreamError):
                ask(**low)


def test_dream_cycle_reaches_its_ceilings(spark, data):
    r = all_queries()["dream_cycle"](spark, data.replace("sf0.001", "sf0.01")).first()
    plan, result = json.loads(r.plan), json.loads(r.result)
    assert (plan["knownCount"], plan["selectedCount"], plan["truncationReasons"]) == (256, 128, ["source-limit"])
    assert result["knownProposalCount"] > result["proposalCount"] == 32 and result["truncationReasons"] == ["proposal-limit"]


def test_canonical_json():
    assert canonical_json({"\U00010400": 1, "�": [True, None, 2.0], "a": "é\x1f"}) == '{"a":"é\\u001f","\U00010400":1,"�":[true,null,2]}'.encode()
    for bad in (-0.0, 0.5, 2**53, "\ud800", {"__proto__": 1}, float("nan"), object()):
        with pytest.raises(EncodingError):
            canonical_json(bad)
    assert depth_and_size({"ab": ["c", {"d": "ef"}]}) == (3, 6)
    wide = {"b": [1.0, -0.0, 0.1, 1e21, 1.5e-7, 123456789012345680000, -2.50, 1e-6], "a": {"\ud800": "x\u2028\n\udfff", "é": None}}
    assert data_json(wide).decode() == '{"a":{"é":null,"\\ud800":"x\u2028\\n\\udfff"},"b":[1,0,0.1,1e+21,1.5e-7,123456789012345680000,-2.5,0.000001]}'
    loop = []
    loop.append(loop)
    deep = None
    for _ in range(50_000):
        deep = [deep]
    assert len(data_json(deep)) == 100_004 and data_json([[1], [1]]) == b"[[1],[1]]"
    for bad in (float("nan"), {1: 2}, {"a": {1}}, loop, 10**400, "x" * 100):
        with pytest.raises(EncodingError):
            data_json(bad, 90)


def test_cuts_by_code_units(spark):
    texts = ["plain", "ab\U0001f600cd", "\U0001f600" * 120, "é" * 210]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", units(F.col("t")).alias("n"), cut_units(F.col("t"), 3).alias("cut"), summary(F.col("t")).alias("s"))
    got = {r.t: (r.n, r.cut, r.s) for r in df.collect()}
    assert [got[t][:2] for t in texts] == [(5, "pla"), (6, "ab"), (240, "\U0001f600"), (210, "ééé")]
    assert got[texts[2]][2] == "\U0001f600" * 98 + "..." and got[texts[3]][2] == "é" * 197 + "..."


def test_written_index_gives_the_same_rows(spark, store, tmp_path):
    root = f"file://{tmp_path}/index"
    with pytest.raises(ValueError):
        NoteIndex.open(spark, root)
    for _ in range(2):
        built = NoteIndex.build(store.unionByName(store.limit(2)), root)
    index = NoteIndex.open(spark, root)
    assert (index.version, index.n_notes) == (built.version, 5) and len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 1
    for text in ("alpha", "the project", "", "nosuchword"):
        for few in (0, 10**6):
            index_module.FEW = few
            for ids in ((), ("beta", "nowhere")):
                q = Query(text, day(1), explicit_ids=ids)
                assert sorted((r.id, r.score, r.rank) for r in index.query(q).collect()) == sorted((r.id, r.score, r.rank) for r in query_notes(note_index(store), q).collect())
    index_module.FEW = 16


def test_import_codes(spark):
    good = ("ether.portable_record.v1", "a", "note", "text", ("note:a", "note", "a"), ["t"], None, "user", "active", 0.5, "2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z")

    def with_(**kw):
        names = ["schema", "id", "kind", "text", "citation", "tags", "category", "source", "status", "confidence", "createdAt", "updatedAt"]
        return tuple(kw.get(n, v) for n, v in zip(names, good))

    rows = [good, with_(schema="v9"), with_(id=" ", schema=None), with_(id="b", text=" ", createdAt="2024-02-30T00:00:00.000Z", citation=None), with_(id="c", kind="page", citation=("page:c", "page", "c"), confidence=2.0), with_(id="d ", status="x", source="y", confidence=-1.0, tags=None, updatedAt="2023-01-01T00:00:00.000Z", citation=("note:d ", "note", "d "))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], portable.STRUCT + ", record_index int")
    issues = portable.record_issues(df, spark.createDataFrame([("c",)], "id string"), spark.createDataFrame([("c",)], "id string"))
    got = sorted((r.record_index, r.field_path, r.code) for r in issues.collect())
    assert got == [
        (1, "id", "DUPLICATE_PAYLOAD_ID"), (1, "schema", "UNSUPPORTED_SCHEMA"),
        (2, "id", "INVALID_ID"), (2, "schema", "MALFORMED_RECORD"),
        (3, "citation", "INVALID_CITATION"), (3, "createdAt", "INVALID_TIMESTAMP"), (3, "text", "MALFORMED_RECORD"),
        (4, "id", "EXISTING_ID_CONFLICT"), (4, "kind", "INVALID_KIND"),
        (5, "confidence", "MALFORMED_RECORD"), (5, "id", "INVALID_ID"), (5, "source", "INVALID_SOURCE"), (5, "status", "INVALID_STATUS"), (5, "tags", "MALFORMED_RECORD"), (5, "updatedAt", "INVALID_CHRONOLOGY"),
    ]
    assert portable.receipt(df, issues).first().imported == 0 and portable.imported(df, issues)[0].count() == 0
    clean = df.where("record_index = 0")
    assert portable.receipt(clean, portable.record_issues(clean)).first().imported == 1
    assert portable.imported(clean, portable.record_issues(clean))[0].first().importance == 0.5


def test_generations_and_snapshot(spark, tmp_path, store):
    g = GenerationStore(spark, f"file://{tmp_path}/store")
    assert g.head() is None
    first = g.publish({"notes": store})
    second = g.publish({"notes": store.where("id = 'alpha'")}, expect=first)
    assert g.head() == second and g.read("notes").count() == 1 and g.read("notes", first).count() == 5
    with pytest.raises(ValueError):
        g.publish({"notes": store}, expect=first)
    assert g.collect_garbage() == [first] and g.read("notes").count() == 1
    e = edges(spark, [("e1", "alpha", "beta", "supports")]).withColumn("data", F.lit("{}"))
    nodes = spark.createDataFrame([("memory:alpha", "memory", None, "{}")], "id string, type string, label string, data string")
    diary = spark.createDataFrame([("d", "x", day(1), day(1), ["t"], "{}")], "id string, content string, created_at timestamp_ntz, updated_at timestamp_ntz, tags array<string>, metadata string")
    write_snapshot(str(tmp_path / "snap"), {"schemaVersion": "v", "userId": "u"}, store, diary, nodes, e)
    back = read_snapshot(spark, str(tmp_path / "snap"))
    assert back["identity"].first().userId == "u" and back["notes"].count() == 5 and back["edges"].first().target == "memory:beta"
    assert sorted(map(tuple, back["notes"].select("id", "created_at", "expires_at").collect())) == sorted(map(tuple, store.select("id", "created_at", "expires_at").collect()))
