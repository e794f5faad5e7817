from datetime import datetime

from pyspark.sql import functions as F

from recollect.operators.references import dangling_references, match_runs, parent_runs, with_key

NOTE = "id string, ingested_at timestamp_ntz, created_at timestamp_ntz, provenance struct<parentNoteId:string,parentDiaryId:string,parentEdgeId:string>, kind string, key bigint"
ROW = "id string, ingested_at timestamp_ntz"


def at(day):
    return datetime(2024, 3, day)


def check(spark, notes, diary=(), edges=(), removals=(), **kw):
    df = dangling_references(
        spark.createDataFrame([(*n, "extra", 1) for n in notes], NOTE), spark.createDataFrame(list(diary), ROW), spark.createDataFrame(list(edges), ROW), spark.createDataFrame(list(removals), "kind string, id string"), **kw
    )
    return sorted(tuple(r) for r in df.collect())


def test_reasons_and_spellings(spark):
    notes = [
        ("mem_0000000000000001", at(2), at(1), (" memory:mem_0000000000000002\t", "diary:d1", "edge_1")),
        ("mem_0000000000000001", at(2), at(1), (" memory:mem_0000000000000002\t", "diary:d1", "edge_1")),
        ("mem_0000000000000002", at(3), at(3), ("", None, "memory:edge_1")),
        ("odd", at(5), None, ("mem_0000000000000001", "d2", "  ")),
        ("none", None, at(4), (None, None, None)),
    ]
    got = check(spark, notes, [("d1", at(1))], [("edge_1", at(1)), ("edge_1", at(1))], [("diary", "d2"), ("diary", "d2"), ("note", "d1")])
    assert got == [
        ("mem_0000000000000001", "parentNoteId", "late", "2024-03"),
        ("mem_0000000000000002", "parentEdgeId", "missing", "2024-03"),
        ("odd", "parentDiaryId", "removed", None),
    ]


def test_one_parent_named_by_all_and_empty_tables(spark):
    notes = [(f"n{i}", at(2), at(2), ("gone", None, None)) for i in range(500)]
    for hot_rows in (50, 100_000):
        assert check(spark, notes, hot_rows=hot_rows) == sorted((f"n{i}", "parentNoteId", "missing", "2024-03") for i in range(500))
    assert check(spark, []) == []


def test_runs_compress_and_keep_block_ends(spark):
    ids = [f"r{i:06x}" for i in [*range(4090, 4100), *range(9000, 9003)]] + ["r0ff9", "x", "", "é"]
    parents = spark.createDataFrame([("k", i, at(1)) for i in ids], "kind string, id string, ingested_at timestamp_ntz")
    runs = parent_runs(parents)
    long = runs.where("stem = 'r' and tail = 6").select("key", "run_end").orderBy("key").collect()
    assert [(r.key, r.run_end) for r in long] == [(4090, 4095), (4096, 4099), (9000, 9002)]
    asked = with_key(spark.createDataFrame([("k", i) for i in [*ids, "r001004", "r0ff8", "y", "R000ffa"]], "kind string, ref string"), "ref")
    found = {r.ref: r.found for r in match_runs(asked, runs).collect()}
    assert all(found[i] for i in ids) and not any(found[i] for i in ("r001004", "r0ff8", "y", "R000ffa"))


def test_very_long_ids(spark):
    big = "a" * 50000
    got = check(spark, [("n", at(1), at(1), (big + "1", big + "2", None))], [(big + "2", at(1))])
    assert got == [("n", "parentNoteId", "missing", "2024-03")]
    assert with_key(spark.createDataFrame([(big,)], "id string")).select(F.length("stem") + F.col("tail")).first()[0] == 50000
