"""Hot groups: exact, bounded, and spread over tasks."""

from pyspark.sql import functions as F

from recollect.operators.skew import hot_groups, pairs_in_groups, spread_join

ROWS = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)]


def test_hot_groups_are_the_largest_with_exact_counts(spark):
    df = spark.createDataFrame(ROWS, "id int, k string")
    assert [(r.k, r.n_rows) for r in hot_groups(df, ["k"], 100).collect()] == [("hot", 200)]
    assert hot_groups(df, ["k"], 5, most=3).count() == 3 and hot_groups(df.limit(0), ["k"], 1).count() == 0


def test_a_hot_key_is_spread_and_joins_as_before(spark):
    df = spark.createDataFrame(ROWS, "id int, k string")
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("nowhere", 4)], "k string, v int")
    hot = hot_groups(df, ["k"], 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spread_join(df, few, ["k"], "id", hot, rows_per_salt=10)
        sizes = [r.n for r in got.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sorted((r.k, r.id, r.v) for r in got.collect()) == sorted((r.k, r.id, r.v) for r in df.join(few, "k").collect())
        assert len(sizes) == 4 and max(sizes) < 120
        left = spread_join(df, few, ["k"], "id", hot, "left_anti", 10)
        assert sorted(r.id for r in left.collect()) == sorted(i for i, k in ROWS if k not in ("hot", "k1"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_of_hot_and_other_groups(spark):
    df = spark.createDataFrame([(i, k, i % 2) for i, k in ROWS[:200]], "id int, k string, v int")
    ids = {}
    for i, k in ROWS[:200]:
        ids.setdefault(k, []).append(i)
    want = {(a, b) for g in ids.values() for a in g for b in g if a < b}
    for hot_rows in (10, 1000):
        got = [tuple(r) for r in pairs_in_groups(df, ["k"], "id", rows_per_block=7, hot_rows=hot_rows).collect()]
        assert len(got) == len(want) and set(got) == want
        odd = [tuple(r) for r in pairs_in_groups(df, ["k"], "id", "v", 7, hot_rows).collect()]
        assert len(odd) == len(set(odd)) and set(odd) == {(a, b) for a, b in want if (a - b) % 2}
