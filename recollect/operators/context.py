"""Bounded context assembly: notes, diary, graph slice, citations, trace and truncation report.

Every list is cut by ``orderBy().limit()`` before its rows are numbered, so only a budget's worth of rows meets one task. Each stage,
a budget's rows at most or the neighbourhood of these, is written once in the shared folder: the large tables are read once however
many parts of the context are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import code_unit_key, excerpt
from recollect.operators.graph import Recall, neighbourhood, query_with_recall
from recollect.operators.retrieval import Query, query_notes, search_diary
from recollect.session import materialize


@dataclass(frozen=True)
class Budget:
    max_notes: int = 12
    max_diary: int = 4
    max_nodes: int = 24
    max_edges: int = 32
    max_chars: int | None = 12_000


@dataclass
class Context:
    """The parts of one context. ``index``/``diary_index`` are indexed notes and diary, ``nodes``/``edges`` the graph."""

    index: DataFrame
    diary_index: DataFrame
    nodes: DataFrame
    edges: DataFrame
    query: Query
    budget: Budget = field(default_factory=Budget)
    diary_ids: tuple[str, ...] = ()
    depth: int = 1
    direction: str = "both"
    relations: tuple[str, ...] = ()
    recall: Recall | None = None

    @cached_property
    def found(self) -> DataFrame:
        """All candidates of both kinds, ``kind, id, place, match_class, score``, from one job."""
        return materialize(self._notes().withColumn("kind", F.lit("note")).unionByName(self._diary().withColumn("kind", F.lit("diary")), allowMissingColumns=True), "candidates")

    @property
    def candidates(self) -> DataFrame:
        """``id, place, match_class, score``: explicit ids in the order asked for, with score 0, then matches by rank."""
        return self.found.where("kind = 'note'").drop("kind")

    @property
    def diary_candidates(self) -> DataFrame:
        """``id, place``: explicit entries, unfiltered, then diary search."""
        return self.found.where("kind = 'diary'").select("id", "place")

    def _notes(self) -> DataFrame:
        asked = self.query.explicit_ids
        q = Query(self.query.text, self.query.as_of, self.query.filters, max(self.budget.max_notes * 4, 50))
        found = query_with_recall(self.index, self.edges, q, self.recall) if self.recall else query_notes(self.index, q)
        ranked = found.select("id", (F.col("rank") + len(asked)).alias("place"), "match_class", "score")
        if not asked:
            return ranked
        own = self.index.where(F.col("id").isin(*asked) & self.query.filters.passes(self.query.as_of))
        own = own.select("id", F.array_position(F.array(*map(F.lit, asked)), F.col("id")).cast("int").alias("place"), F.lit("explicit_id").alias("match_class"), F.lit(0.0).alias("score")).dropDuplicates(["id"])
        return own.unionByName(ranked.join(own.select("id"), "id", "left_anti"))

    def _diary(self) -> DataFrame:
        asked = self.diary_ids
        found = search_diary(self.diary_index, self.query.text, max(self.budget.max_diary * 4, 20)).select("id", (F.col("rank") + len(asked)).alias("place"))
        if not asked:
            return found
        own = self.diary_index.where(F.col("id").isin(*asked)).select("id", F.array_position(F.array(*map(F.lit, asked)), F.col("id")).cast("int").alias("place")).dropDuplicates(["id"])
        return own.unionByName(found.join(own.select("id"), "id", "left_anti"))

    @cached_property
    def chosen(self) -> DataFrame:
        """Chosen notes and diary entries in order: ``kind, id, ord, match_class, score, content, excerpt``.

        Characters are spent in this order; the item that crosses the budget is cut and later ones get nothing.
        """
        notes = _first(self.candidates, self.budget.max_notes).join(self.index.select("id", "content", "metadata"), "id").withColumn("kind", F.lit("note"))
        diary = _first(self.diary_candidates, self.budget.max_diary).join(self.diary_index.select("id", "content"), "id").withColumn("kind", F.lit("diary"))
        both = notes.unionByName(diary, allowMissingColumns=True).dropDuplicates(["kind", "id"])
        order = W.orderBy(F.col("kind").desc(), "ord")
        if self.budget.max_chars is None:
            room = F.length("content")
        else:
            before = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            room = F.greatest(F.lit(0), F.lit(self.budget.max_chars) - before).cast("int")
        shown = both.withColumn("room", room).withColumn("shown", excerpt(F.col("content"), F.col("room"))).withColumn("ord", F.row_number().over(order))
        return materialize(shown, "chosen")

    @cached_property
    def reached(self) -> tuple[DataFrame, DataFrame]:
        """All nodes and edges of the neighbourhoods, ``id`` and their first place ``at``, from one job."""
        seeds = self.chosen.select(F.concat(F.when(F.col("kind") == "note", "memory:").otherwise("diary:"), "id").alias("seed"), F.col("ord").alias("seed_ord"))
        known = self.nodes.select(F.col("id").alias("node"))
        seeds = seeds.join(known.withColumnRenamed("node", "seed"), "seed", "left_semi")
        near, used = neighbourhood(self.edges, seeds, self.depth, self.direction, self.relations)
        roots = seeds.select(F.col("seed").alias("id"), "seed_ord", F.lit(0).alias("part"))
        others = near.join(seeds, "seed").select(F.col("node").alias("id"), "seed_ord", F.lit(1).alias("part"))
        nodes = roots.unionByName(others).groupBy("id").agg(F.min(F.struct("seed_ord", "part")).alias("at"))
        edges = used.join(seeds, "seed").groupBy(F.col("edge_id").alias("id")).agg(F.min("seed_ord").alias("at"))
        both = materialize(nodes.select(F.lit("node").alias("kind"), "id", "at").unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.struct(F.col("at").alias("seed_ord"), F.lit(0).alias("part")).alias("at"))), "reached")
        return tuple(both.where(F.col("kind") == k).drop("kind") for k in ("node", "edge"))

    @cached_property
    def graph_nodes(self) -> DataFrame:
        """``id, ord`` of the nodes kept."""
        order = [F.col("at.seed_ord"), F.col("at.part"), code_unit_key(F.col("id"))]
        kept = self.reached[0].orderBy(*order).limit(self.budget.max_nodes).select("id", F.row_number().over(W.orderBy(*order)).alias("ord"))
        return materialize(kept, "graph-nodes")

    @cached_property
    def graph_edges(self) -> DataFrame:
        """``id, source, target, relationship, ord`` of the edges kept: both ends among the kept nodes."""
        kept = self.graph_nodes.select("id")
        full = self.reached[1].join(self.edges, "id")
        for end in ("source", "target"):
            full = full.join(kept.select(F.col("id").alias(end)), end, "left_semi")
        order = [F.col("at.seed_ord"), code_unit_key(F.col("id"))]
        kept = full.orderBy(*order).limit(self.budget.max_edges).select("id", "source", "target", "relationship", F.row_number().over(W.orderBy(*order)).alias("ord"))
        return materialize(kept, "graph-edges")

    def citations(self) -> DataFrame:
        """``ref, kind, id, ord``: notes, diary, nodes, edges."""
        parts = (self.chosen.where("kind = 'note'").select("kind", "id", "ord"), self.chosen.where("kind = 'diary'").select("kind", "id", "ord"), self.graph_nodes.select(F.lit("node").alias("kind"), "id", "ord"), self.graph_edges.select(F.lit("edge").alias("kind"), "id", "ord"))
        out = None
        for i, p in enumerate(parts):
            p = p.withColumn("part", F.lit(i))
            out = p if out is None else out.unionByName(p)
        return out.select(F.concat_ws(":", "kind", "id").alias("ref"), "kind", "id", F.row_number().over(W.orderBy("part", "ord")).alias("ord"))

    def claim_flags(self) -> DataFrame:
        """``claim_key, note_ids``: claims stated by more than one chosen note, notes in order."""
        key = F.get_json_object("metadata", "$.claimKey")
        named = self.chosen.where("kind = 'note'").withColumn("claim_key", key).where("claim_key is not null")
        return named.groupBy("claim_key").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("l")).where(F.size("l") > 1).select("claim_key", F.col("l.id").alias("note_ids"))

    def report(self) -> DataFrame:
        """One row: mode, filters asked for, matched and omitted counts, characters omitted, whether a budget was hit."""
        count = F.count(F.lit(1))
        notes = self.candidates.agg(count.alias("n_notes"), F.count_if(F.col("match_class") != "explicit_id").alias("matched_notes"))
        diary = self.diary_candidates.agg(count.alias("matched_diary"))
        chosen = self.chosen.agg(F.count_if(F.col("kind") == "note").alias("kept_notes"), F.count_if(F.col("kind") == "diary").alias("kept_diary"), F.coalesce(F.sum(F.length("content") - F.length("shown")), F.lit(0)).alias("chars_omitted"))
        sizes = [self.reached[0].agg(count.alias("all_nodes")), self.graph_nodes.agg(count.alias("kept_nodes")), self.reached[1].agg(count.alias("all_edges")), self.graph_edges.agg(count.alias("kept_edges"))]
        one = notes
        for part in (diary, chosen, *sizes):  # each has exactly one row
            one = one.join(part)
        asked = bool(self.query.explicit_ids)
        mode = "hybrid" if asked and self.query.text else "ids" if asked else "query" if self.query.text else "empty"
        omitted = {f"{k}_omitted": F.col(a) - F.col(b) for k, a, b in (("notes", "n_notes", "kept_notes"), ("diary", "matched_diary", "kept_diary"), ("nodes", "all_nodes", "kept_nodes"), ("edges", "all_edges", "kept_edges"))}
        hit = F.col("chars_omitted") > 0
        for c in omitted.values():
            hit |= c > 0
        return one.select(F.lit(mode).alias("mode"), F.lit(",".join(self.query.filters.named())).alias("filters_applied"), "matched_notes", "matched_diary", *[c.alias(k) for k, c in omitted.items()], "chars_omitted", hit.alias("hit_budget"))


def _first(candidates: DataFrame, limit: int) -> DataFrame:
    return candidates.orderBy("place").limit(limit).withColumn("ord", F.row_number().over(W.orderBy("place"))).drop("place")
