"""Best representative of each duplicate group (problem 5).

Fields that depend on each other form a bundle, which is taken whole from one record. For each bundle a trust key ranks the records
that may give it. Bundles are assigned by branch and bound, one by one, from the most trusted candidate down; a branch is cut when what
it can still reach does not beat the best found, and an assignment is feasible if each dependency's pair of values occurs together in a
record of the group.

Without dependencies every usable record is a candidate and the search alone picks among them. The bundles are then independent, so a
group is searched in parts: first the records of a key within each Arrow batch, whose losers are cut before the shuffle, then what is
left of all parts. A group with a third of all rows is left with one candidate a bundle from each batch.

With dependencies the first bound, the best record of every bundle by itself, is one algebraic aggregate per group. Where it satisfies the
dependencies it is the optimum; only groups in which it does not are searched. Candidates are the best record per distinct value of a
bundle that takes part in a dependency, so a group's search holds its distinct values, not its rows.

Defined results: records with a null key or id are in no group; a redelivered row is one record; a group needs two ids or more; a null
trust ranks last; equal trust falls to the smaller id; a bundle without usable record has the empty id; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import strip_white
from recollect.session import materialize

LAST = (1 << 63) - 1
# The states of a note, most trusted first.
STATUSES = ("active", "candidate", "archived", "rejected")


@dataclass(frozen=True)
class Bundle:
    """Fields taken together from one record: ``value`` identifies them, ``usable`` says whether a record may give them."""

    name: str
    value: Column
    usable: Column


def _score(trust: Column) -> Column:
    """Trust as a number to add up: later is more, an unknown time is 0."""
    return F.when(trust == LAST, F.lit(0)).otherwise(-trust)


def later_first(ts: str) -> Column:
    """Rank for the latest time first, null last."""
    return F.coalesce(-F.unix_millis(F.col(ts).cast("timestamp")), F.lit(LAST))


def best_by_bundle(records: DataFrame, key: str, order: list[Column], bundles: list[Bundle], trust: Column) -> DataFrame:
    """One row per key with two ids or more: ``survivor_id`` (first by ``order``, then id) and ``<bundle>_id`` of the best usable record."""
    picked = [F.coalesce(F.min(F.when(b.usable, F.struct(trust.alias("t"), F.col("id")))).getField("id"), F.lit("")).alias(f"{b.name}_id") for b in bundles]
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("id"))).getField("id").alias("survivor_id")
    return records.where(F.col(key).isNotNull() & F.col("id").isNotNull()).groupBy(key).agg(first, *picked, F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("lo", "hi")


def branch_and_bound(candidates: dict[str, list[tuple[int, str, str]]], witnessed: dict[tuple[str, str], set[tuple[str, str]]]) -> dict[str, str]:
    """The assignment of an id to each bundle with the greatest total trust under the dependencies.

    ``candidates``: per bundle (trust, id, value). ``witnessed``: per dependency (bundle, bundle) its pairs of values that occur. Ties
    fall to the smaller ids in bundle order. Bundles without candidates get the empty id and bind nothing.
    """
    ranked = {b: sorted(c, key=lambda x: (-x[0], x[1])) for b, c in candidates.items()}
    names = [b for b in ranked if ranked[b]]
    ahead = [sum(ranked[b][0][0] for b in names[i:]) for i in range(len(names) + 1)]
    best: tuple[int, tuple[str, ...]] | None = None

    def fits(chosen: list[tuple[int, str, str]], i: int, c: tuple[int, str, str]) -> bool:
        for j, other in enumerate(chosen):
            for pair, swap in (((names[j], names[i]), False), ((names[i], names[j]), True)):
                if pair in witnessed and ((c[2], other[2]) if swap else (other[2], c[2])) not in witnessed[pair]:
                    return False
        return True

    stack: list[tuple[list[tuple[int, str, str]], Iterator[tuple[int, str, str]]]] = [([], iter(ranked[names[0]]))] if names else []
    while stack:
        chosen, rest = stack[-1]
        c = next(rest, None)
        i, have = len(chosen), sum(x[0] for x in chosen)
        if c is None or (best is not None and (-have - c[0] - ahead[i + 1], (*(x[1] for x in chosen), c[1])) > (-best[0], best[1][: i + 1])):  # candidates only get worse
            stack.pop()
            continue
        if not fits(chosen, i, c):
            continue
        if i + 1 == len(names):
            found = (have + c[0], tuple(x[1] for x in [*chosen, c]))
            if best is None or (-found[0], found[1]) < (-best[0], best[1]):
                best = found
        else:
            stack.append(([*chosen, c], iter(ranked[names[i + 1]])))
    return {b: "" for b in ranked} | (dict(zip(names, best[1])) if best else {})


def consistent_bundles(records: DataFrame, key: str, order: list[Column], bundles: list[Bundle], trust: Column, dependencies: list[tuple[str, str]]) -> DataFrame:
    """Rows as of ``best_by_bundle``, with the bundles chosen together under ``dependencies`` (pairs of bundle names).

    The trust of a choice is the sum of its records' trust (later is more, null is 0); no feasible choice gives empty ids.
    """
    if not dependencies:
        return searched(records, key, order, bundles, trust)
    records = materialize(records, "claims")
    best = best_by_bundle(records, key, order, bundles, trust)
    by = {b.name: b for b in bundles}
    bound = list(dict.fromkeys(x for d in dependencies for x in d))
    score = _score(trust)
    grouped = records.where(F.col(key).isNotNull() & F.col("id").isNotNull())
    value = {b: F.when(by[b].usable, by[b].value.cast("string")) for b in bound}
    usable = grouped.select(key, "id", score.alias("score"), *[value[b].alias(f"v_{b}") for b in bound])
    pairs = None
    for a, b in dependencies:
        p = usable.select(key, F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v_{a}").alias("va"), F.col(f"v_{b}").alias("vb")).where("va is not null and vb is not null").distinct()
        pairs = p if pairs is None else pairs.unionByName(p)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bundle"), F.col(f"v_{b}").alias("value")) for b in bound]))
    candidates = (
        usable.select(key, "id", "score", each.alias("x"))
        .where("x.value is not null")
        .groupBy(key, F.col("x.bundle").alias("bundle"), F.col("x.value").alias("value"))
        .agg(F.min(F.struct((-F.col("score")).alias("worse"), F.col("id"))).alias("m"))
        .select(key, "bundle", "value", (-F.col("m.worse")).alias("score"), F.col("m.id").alias("cid"))
    )
    top = best.select(key, F.explode(F.array(*[F.struct(F.lit(b).alias("bundle"), F.col(f"{b}_id").alias("cid")) for b in bound])).alias("t")).select(key, "t.bundle", "t.cid")
    chosen = top.join(candidates, [key, "bundle", "cid"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bundle", "value"))).alias("chosen"))
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.element_at("chosen", F.lit(a)).alias("va"), F.element_at("chosen", F.lit(b)).alias("vb")) for a, b in dependencies]))
    broken = chosen.select(key, asked.alias("x")).select(key, "x.*").where("va is not null and vb is not null").join(pairs, [key, "a", "b", "va", "vb"], "left_anti")
    keys = broken.select(key).distinct()
    rows = candidates.join(keys, key, "left_semi").select(key, "bundle", "value", "score", "cid", F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("vb")).unionByName(
        pairs.join(keys, key, "left_semi").select(key, F.col("a").alias("bundle"), F.col("va").alias("value"), F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("string").alias("cid"), "b", "vb")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_pair = pdf["b"].notna()
        cands: dict[str, list[tuple[int, str, str]]] = {b: [] for b in bound}
        for r in pdf[~is_pair].itertuples(index=False):
            cands[r.bundle].append((int(r.score), r.cid, r.value))
        seen_pairs: dict[tuple[str, str], set[tuple[str, str]]] = {d: set() for d in dependencies}
        for r in pdf[is_pair].itertuples(index=False):
            seen_pairs[(r.bundle, r.b)].add((r.value, r.vb))
        got = branch_and_bound(cands, seen_pairs)
        return pd.DataFrame([[pdf[key].iloc[0], *[got[b] for b in bound]]], columns=[key, *[f"{b}_found" for b in bound]])

    found = rows.groupBy(key).applyInPandas(search, f"{key} string, " + ", ".join(f"{b}_found string" for b in bound))
    joined = best.join(found, key, "left")
    fixed = {f"{b}_id": F.coalesce(f"{b}_found", f"{b}_id") for b in bound}
    return joined.select(key, "survivor_id", *[fixed.get(f"{b.name}_id", F.col(f"{b.name}_id")).alias(f"{b.name}_id") for b in bundles])


def searched(records: DataFrame, key: str, order: list[Column], bundles: list[Bundle], trust: Column) -> DataFrame:
    """The rows of ``best_by_bundle`` by branch and bound over all usable records, for bundles that depend on nothing.

    ``cut`` searches the records of a key in each batch and leaves the winner of each bundle as its only candidate there; ``choose``
    searches what all batches left of a key. Survivors and the count of ids are aggregates over all records.
    """
    names = [b.name for b in bundles]
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("id"))
    rows = records.where(F.col(key).isNotNull() & F.col("id").isNotNull()).select(key, "id", trust.alias("trust"), first.alias("first"), *[b.usable.alias(b.name) for b in bundles])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, ranks = (batch.column(i).to_pylist() for i in range(3))
            usable = [batch.column(4 + j).to_pylist() for j in range(len(names))]
            groups: dict[str, list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for at in groups.values():
                if len(at) > 1:
                    mine = {n: [i for i in at if u[i]] for n, u in zip(names, usable)}
                    got = branch_and_bound({n: [(-ranks[i], ids[i], "") for i in c] for n, c in mine.items()}, {})
                    for n, u in zip(names, usable):
                        for i in mine[n]:
                            u[i] = False
                        if mine[n]:
                            u[min((i for i in mine[n] if ids[i] == got[n]), key=ranks.__getitem__)] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(u, pa.bool_()) for u in usable]], schema=batch.schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [batch.column(2 + j).to_pylist() for j in range(len(names))]
            got = [branch_and_bound({n: [(-c["trust"], c["id"], "") for c in cs] for n, cs in zip(names, group)}, {}) for group in zip(*left)]
            found = [pa.array([g[n] for g in got], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=[key, "survivor_id", *[f"{n}_id" for n in names]])

    left = [F.collect_list(F.when(F.col(n), F.struct("trust", "id"))).alias(n) for n in names]
    groups = rows.mapInArrow(cut, rows.schema).groupBy(key).agg(F.min("first").getField("id").alias("survivor_id"), *left, F.min("id").alias("lo"), F.max("id").alias("hi"))
    return groups.where("lo < hi").drop("lo", "hi").mapInArrow(choose, ", ".join(f"{c} string" for c in (key, "survivor_id", *[f"{n}_id" for n in names])))


def claims(notes: DataFrame) -> DataFrame:
    """Notes with their decoded ``claim_key``: a non-empty JSON string at the top level of ``metadata``, else null."""
    v = F.try_variant_get(F.try_parse_json("metadata"), "$.claimKey", "variant")
    key = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json("metadata"), "$.claimKey", "string"))
    return notes.select("id", "confidence", "status", "pinned", "updated_at", key.alias("claim_key")).where("claim_key != ''")


def claim_rules() -> tuple[list[Column], list[Bundle], Column]:
    """Order of survivors, bundles and trust of the claim groups."""
    conf, status = F.col("confidence"), F.lower(strip_white(F.col("status")))
    good = F.coalesce((conf >= 0) & (conf <= 1) & ~F.isnan(conf), F.lit(False))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), status), F.lit(0)), F.lit(len(STATUSES) + 1))
    trust = later_first("updated_at")
    order = [F.when(F.col("pinned"), 0).otherwise(1), rank, F.when(good, -conf).otherwise(F.lit(2.0)), trust]
    bundles = [Bundle("confidence", conf, good), Bundle("status", status, F.coalesce(status.isin(*STATUSES), F.lit(False))), Bundle("pinned", F.col("pinned"), F.col("pinned").isNotNull())]
    return order, bundles, trust


def claim_survivors(notes: DataFrame, dependencies: list[tuple[str, str]] | None = None) -> DataFrame:
    """``claim_key, survivor_id, confidence_id, status_id, pinned_id`` of each claim stated by two notes or more."""
    order, bundles, trust = claim_rules()
    return consistent_bundles(claims(notes), "claim_key", order, bundles, trust, dependencies or [])
