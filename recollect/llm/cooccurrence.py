"""Items that appear together (problem 3).

Basket collapsing: each record becomes the sorted array of its distinct terms, equal arrays are grouped into one weighted basket,
pairs are enumerated once per distinct basket, and weights are summed by pair with map-side combine.

Defined results: null and blank items and null arrays hold nothing, their records still count in ``n``; an item repeated in a record
counts once; a redelivered row is one record; records with fewer than two terms give no pairs; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import term_of
from recollect.session import materialize

MIN_RECORDS = 8
MIN_LIFT = 3


def baskets(df: DataFrame, collection: str, items: str = "tags") -> DataFrame:
    """``collection, items, weight``: distinct sorted item arrays with the number of records that hold exactly these."""
    terms = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), term_of), lambda t: t.isNotNull())))
    once = df.where("id is not null").select("id", terms.alias("items")).dropDuplicates(["id"])
    return once.groupBy("items").agg(F.count(F.lit(1)).alias("weight")).select(F.lit(collection).alias("collection"), "items", "weight")


def item_pairs(weighted: DataFrame, min_records: int = 1) -> DataFrame:
    """Per pair in a collection: ``n_ab, n_a, n_b, n, lift, conviction`` (a before b, conviction null where b always follows a).

    ``min_records`` drops pairs below that support once their exact counts are known.
    """
    n = weighted.groupBy("collection").agg(F.sum("weight").alias("n"))
    single = weighted.select("collection", F.explode("items").alias("item"), "weight").groupBy("collection", "item").agg(F.sum("weight").alias("n_item"))
    follow = F.transform("items", lambda x, i: F.struct(x.alias("tag_a"), F.slice(F.col("items"), i + 2, F.size("items")).alias("rest")))
    pairs = (
        weighted.where(F.size("items") > 1)
        .select("collection", "weight", F.explode(follow).alias("f"))
        .select("collection", "weight", F.col("f.tag_a").alias("tag_a"), F.explode("f.rest").alias("tag_b"))
        .groupBy("collection", "tag_a", "tag_b")
        .agg(F.sum("weight").alias("n_ab"))
        .where(F.col("n_ab") >= min_records)
    )
    a = single.select("collection", F.col("item").alias("tag_a"), F.col("n_item").alias("n_a"))
    b = single.select("collection", F.col("item").alias("tag_b"), F.col("n_item").alias("n_b"))
    d = {k: F.col(k).cast("double") for k in ("n", "n_a", "n_b", "n_ab")}
    return (
        pairs.join(a, ["collection", "tag_a"])
        .join(b, ["collection", "tag_b"])
        .join(n, "collection")
        .select("collection", "tag_a", "tag_b", "n_ab", "n_a", "n_b", "n")
        .withColumn("lift", d["n_ab"] * d["n"] / (d["n_a"] * d["n_b"]))
        .withColumn("conviction", F.when(F.col("n_ab") < F.col("n_a"), d["n_a"] * (d["n"] - d["n_b"]) / (d["n"] * (d["n_a"] - d["n_ab"]))))
    )


def all_baskets(notes: DataFrame, diary: DataFrame) -> DataFrame:
    """The weighted baskets of both tables, written once as pairs, items and totals all read them."""
    return materialize(baskets(notes, "note").unionByName(baskets(diary, "diary")), "baskets")


def strong_pairs(pairs: DataFrame, min_records: int = MIN_RECORDS, min_lift: int = MIN_LIFT) -> DataFrame:
    """Pairs in ``min_records`` records or more whose lift is at least ``min_lift``, decided in whole numbers."""
    big = {k: F.col(k).cast("decimal(19,0)") for k in ("n", "n_a", "n_b", "n_ab")}
    return pairs.where((F.col("n_ab") >= min_records) & (big["n_ab"] * big["n"] >= big["n_a"] * big["n_b"] * F.lit(min_lift))).select("collection", "tag_a", "tag_b")
