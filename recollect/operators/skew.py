"""Shared handling of hot groups.

The hot groups of a table are its largest, counted exactly, at most ``MOST_HOT`` of them. They are the only rows ever broadcast here, so
the size of that broadcast is bounded whatever the table's size; a group that is not among them holds less than one part in
``MOST_HOT`` of all rows, or less than the floor asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOT = 8192
HOT_ROWS = 100_000


def hot_groups(df: DataFrame, keys: list[str], floor: int = HOT_ROWS, count: str = "n_rows", most: int = MOST_HOT) -> DataFrame:
    """The largest groups of at least ``floor`` rows with their exact counts, at most ``most`` of them, as a local table to broadcast.

    Rows are counted map-side first, so the count is no burden to a hot group either.
    """
    return hot_of(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), keys, floor, count, most)


def hot_of(counts: DataFrame, keys: list[str], floor: int = HOT_ROWS, count: str = "n_rows", most: int = MOST_HOT) -> DataFrame:
    """As ``hot_groups``, of groups counted already."""
    top = counts.select(*keys, count).where(F.col(count) >= floor).orderBy(F.col(count).desc(), *keys).limit(most)
    return F.broadcast(counts.sparkSession.createDataFrame(top.collect(), top.schema))


def salt_of(row_id: Column, n_rows: Column, rows_per_salt: int) -> Column:
    """Salt of a row: 0 for groups without ``n_rows`` (not hot), else one of ceil(n_rows / rows_per_salt) values."""
    return F.coalesce(F.pmod(F.xxhash64(row_id), _salts(n_rows, rows_per_salt)), F.lit(0).cast("bigint"))


def _salts(n_rows: Column, rows_per_salt: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n_rows / F.lit(rows_per_salt)).cast("bigint"))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], row_id: str, hot: DataFrame, how: str = "inner", rows_per_salt: int = HOT_ROWS) -> DataFrame:
    """``many`` joined with ``few`` on ``keys`` where a key may hold a large part of ``many``.

    Rows of ``many`` in ``hot`` groups get a salt by ``row_id``, and rows of ``few`` with these keys a copy per salt: no task takes a hot group whole.
    ``how`` is inner, left or left_anti, as seen from ``many``.
    """
    salted = many.join(hot, keys, "left").withColumn("salt", salt_of(F.col(row_id), F.col("n_rows"), rows_per_salt)).drop("n_rows")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(_salts(F.col("n_rows"), rows_per_salt), F.lit(1).cast("bigint")) - 1))
    return salted.join(few.join(hot, keys, "left").withColumn("salt", copies).drop("n_rows"), [*keys, "salt"], how).drop("salt")


def pairs_in_groups(df: DataFrame, keys: list[str], row_id: str, differ: str | None = None, rows_per_block: int = 2000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every unordered pair ``(id_a, id_b)``, ``id_a < id_b``, of rows of one group, for results defined as pairs.

    ``df`` must hold each ``row_id`` once; it is read several times. With ``differ`` only pairs with unequal values there. A group larger than
    ``rows_per_block`` is split into blocks: its rows carry one block and meet a copy of the group per block; the other groups
    take part in the same join with a single block. Rows of the largest groups learn their group's size from the broadcast hot groups,
    the others from a join, so no task holds a whole hot group at any step.
    """
    extra = [differ] if differ else []
    hot = hot_groups(df, keys, hot_rows)
    known = df.select(*keys, row_id, *extra).join(hot, keys, "left")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    sized = known.where("n_rows is not null").unionByName(known.where("n_rows is null").drop("n_rows").join(sizes, keys))
    blocks = F.ceil(F.col("n_rows") / F.lit(rows_per_block)).cast("int")
    left = sized.select(*keys, F.col(row_id).alias("id_a"), *[F.col(x).alias("differ_a") for x in extra], F.pmod(F.hash(row_id), blocks).alias("block"))
    right = sized.select(*keys, F.col(row_id).alias("id_b"), *[F.col(x).alias("differ_b") for x in extra], F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    on = F.col("id_a") < F.col("id_b")
    if differ:
        on &= F.col("differ_a") != F.col("differ_b")
    return left.join(right, [*keys, "block"]).where(on).select("id_a", "id_b")
