"""Mixing sources to target weights (problem 9).

Every document gets a hash-random key per source. Equal ranges of the key are the range partitions of a source: keys are uniform, so
they hold equal shares of it whatever its size. Token counts are summed by range, prefix sums over these few rows give each range its
offset, and a running sum in key order within the range completes the distributed prefix sum. Each source is cut at its exact budget:
whole epochs first, then the documents whose prefix sum fits the rest.

The size of a mix is the largest at which every source that has documents can meet its target within ``max_repeats``, or
``total_tokens``; sources that cannot give their part then give all they may. Weights are relative to those of the sources that
have tokens.

Defined results: documents with a null source, or a source without target, are not drawn; texts without tokens are never drawn; a
source without documents is reported with reached share 0; null or negative weights and repeats count as 0; a target row given
twice is one (the first by weight); no documents or no targets give no draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.tokenizer import token_counts
from recollect.session import materialize

DOCS_PER_RANGE = 50_000


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents that can be drawn, written once: tokens are counted a single time."""
    return materialize(token_counts(docs.where("source is not null and text is not null and doc_id is not null"), ["doc_id", "source"]).where("n_tokens > 0"), "sized-docs")


def mix_budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per mix and source: ``share`` (of the sources that have tokens), ``source_tokens``, ``budget``, ``epochs`` and ``rest`` tokens.

    All frames here have one row per source or per mix and source.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.when(F.isnan("target_share"), 0.0).otherwise(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max(F.struct(weight.alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("r"))).alias("t"))
    mix = W.partitionBy("mix_name")
    t = wanted.join(have, "source", "left").select("mix_name", "source", F.col("t.w").alias("target_weight"), F.col("t.r").alias("max_repeats"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    usable = F.when((F.col("source_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_weight")).otherwise(0.0)
    t = t.withColumn("target_share", F.col("target_weight") / F.nullif(F.sum("target_weight").over(mix), F.lit(0.0))).withColumn("share", F.coalesce(usable / F.nullif(F.sum(usable).over(mix), F.lit(0.0)), F.lit(0.0)))
    cap = F.col("source_tokens") * F.col("max_repeats")
    size = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(F.when(F.col("share") > 0, cap / F.col("share"))).over(mix)
    t = t.withColumn("size", F.coalesce(size, F.lit(0.0)))
    t = t.withColumn("budget", F.least(cap, F.floor(F.col("share") * F.col("size") + F.lit(1e-6))).cast("bigint"))
    whole = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0)
    return t.withColumn("epochs", whole.cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))


def prefix_sums(sized: DataFrame, docs_per_range: int = DOCS_PER_RANGE, seed: int = 17) -> DataFrame:
    """``doc_id, source, n_tokens, upto``: tokens of the source up to and with the document, in hash-random order."""
    n = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(1, (n // docs_per_range).bit_length())
    keyed = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.shiftright("key", 64 - bits))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    before = F.coalesce(F.sum("range_tokens").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "range", before.alias("offset"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return keyed.withColumn("inside", inside).join(offsets, ["source", "range"]).select("doc_id", "source", "n_tokens", (F.col("inside") + F.col("offset")).alias("upto"))


def draw_mixes(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, docs_per_range: int = DOCS_PER_RANGE, sized: DataFrame | None = None) -> DataFrame:
    """``mix_name, doc_id, source, n_tokens, repeats``: how often each document is drawn into each mix."""
    sized = sized_documents(docs) if sized is None else sized
    budgets = mix_budgets(sized, targets, total_tokens).select("mix_name", "source", "epochs", "rest")
    repeats = F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int")
    return prefix_sums(sized, docs_per_range).join(budgets, "source").select("mix_name", "doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Per mix and source what was asked for and what was reached, in tokens and as shares of the mix."""
    sized = sized_documents(docs) if sized is None else sized
    drawn = draw_mixes(docs, targets, total_tokens, sized=sized).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.sum("repeats").alias("n_draws"))
    t = mix_budgets(sized, targets, total_tokens).join(drawn, ["mix_name", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return t.select(
        "mix_name",
        "source",
        "target_share",
        "max_repeats",
        "source_tokens",
        "budget",
        tokens.alias("tokens"),
        F.coalesce("n_draws", F.lit(0)).alias("n_draws"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(tokens / F.nullif(F.sum(tokens).over(W.partitionBy("mix_name")), F.lit(0)), F.lit(0.0)).alias("reached_share"),
    )
