"""Neighbourhoods and recall over the directed relation graph. Every step is a join on the node."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import code_unit_key
from recollect.operators.retrieval import Query, class_rank, classified, direct_matches, final_score, note_index, top_matches
from recollect.session import materialize

DAMPING = (0.5, 0.25)


@dataclass(frozen=True)
class Recall:
    """Graph recall from the best direct matches: at most ``max_results`` nodes a seed, ``depth`` 1 or 2."""

    depth: int = 1
    max_results: int = 8
    direction: str = "both"
    relations: tuple[str, ...] = ()


def adjacency(edges: DataFrame, direction: str = "both", relations: tuple[str, ...] = (), loops: bool = True) -> DataFrame:
    """``node, other, edge_id, relationship, way``: each edge as seen from its ends."""
    e = edges.where(F.col("relationship").isin(*relations)) if relations else edges
    if not loops:
        e = e.where("source != target")
    out = e.select(F.col("source").alias("node"), F.col("target").alias("other"), F.col("id").alias("edge_id"), "relationship", F.lit("out").alias("way"))
    back = e.select(F.col("target").alias("node"), F.col("source").alias("other"), F.col("id").alias("edge_id"), "relationship", F.lit("in").alias("way"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both", relations: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes ``seed, node, level`` and edges ``seed, edge_id`` within ``depth`` (0 to 2) hops of each ``seed``; no cap.

    Edges are those seen from a node before the last level, so one between two last-level nodes is not among them.
    """
    adj = adjacency(edges, direction, relations)
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("level"))
    seen = None
    for level in range(1, max(0, min(depth, 2)) + 1):
        step = reached.where(F.col("level") == level - 1).join(adj, "node")
        used = step.select("seed", "edge_id")
        seen = used if seen is None else seen.unionAll(used)
        new = step.select("seed", F.col("other").alias("node")).distinct().join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        reached = reached.unionAll(new.withColumn("level", F.lit(level)))
    nodes = reached.where("level > 0")
    return nodes, (seen if seen is not None else seeds.select("seed", F.lit("").alias("edge_id")).limit(0)).distinct()


def recall_nodes(edges: DataFrame, seeds: DataFrame, recall: Recall) -> DataFrame:
    """``seed, node, path, found``: nodes within reach of each seed in order of discovery, capped, with their least path of edge ids.

    Level 1 is found in order of edge ids. Level 2 is found by (parent, edge); its paths take the least ``[edge to parent, edge]``
    among the steps walked before the cap was hit. Self-loops are no steps.
    """
    adj = adjacency(edges, recall.direction, recall.relations, loops=False)
    own, cap = W.partitionBy("seed"), F.lit(recall.max_results)
    key = code_unit_key(F.col("edge_id"))
    first = seeds.select("seed", F.col("seed").alias("node")).join(adj, "node").groupBy("seed", F.col("other").alias("node")).agg(F.min(F.struct(key.alias("k"), "edge_id")).alias("e"))
    # Rank and limit stand alone, so only the first rows of a seed are shuffled to its task, however many edges it has.
    one = first.withColumn("found", F.row_number().over(own.orderBy("e.k", code_unit_key(F.col("node"))))).where(F.col("found") <= cap)
    one = one.select("seed", "node", F.col("e.edge_id").alias("e1"), "found", F.count(F.lit(1)).over(own).alias("n_one"))
    level1 = one.select("seed", "node", F.array("e1").alias("path"), "found")
    if min(recall.depth, 2) < 2:
        return level1
    steps = one.where(F.col("n_one") < cap).join(adj, "node").where(F.col("other") != F.col("seed"))
    steps = steps.join(one.select("seed", F.col("node").alias("other")), ["seed", "other"], "left_anti")
    walked = steps.withColumn("step", F.struct(code_unit_key(F.col("node")).alias("p"), key.alias("k")))
    order = walked.groupBy("seed", "other").agg(F.min("step").alias("first_step"), F.max("n_one").alias("n_one"))
    kept = order.withColumn("place", F.row_number().over(own.orderBy("first_step"))).where(F.col("place") <= cap).where(F.col("place") <= cap - F.col("n_one"))
    kept = kept.withColumn("cut", F.when(F.count(F.lit(1)).over(own) == cap - F.col("n_one"), F.max("first_step").over(own))).select("seed", "other", "place", "n_one", "cut")
    least = F.min(F.struct(code_unit_key(F.col("e1")).alias("k1"), key.alias("k2"), "e1", "edge_id")).alias("p")
    paths = walked.drop("n_one").join(kept, ["seed", "other"]).where("cut is null or step <= cut").groupBy("seed", "other").agg(least, F.max(F.col("n_one") + F.col("place")).alias("found"))
    return level1.unionByName(paths.select("seed", F.col("other").alias("node"), F.array("p.e1", "p.edge_id").alias("path"), "found"))


def query_with_recall(index: DataFrame, edges: DataFrame, query: Query, recall: Recall, notes: DataFrame | None = None) -> DataFrame:
    """Direct matches and notes recalled through the graph from the best of them, ranked together.

    A recalled note scores its seed's score, halved per hop; the best seed wins. Direct matches are never replaced: a recalled note that
    matches by itself is none. The direct matches are ranked in one pass and kept, ``limit`` rows; only as many can be in the
    result. With ``notes``, not indexed, only the few recalled ones are tokenized.
    """
    direct = materialize(top_matches(direct_matches(index, query), query.limit), "direct")
    best = direct.select(F.concat(F.lit("memory:"), "id").alias("seed"), F.col("score").alias("seed_score"), F.col("id").alias("seed_id"))
    reached = recall_nodes(edges, best.select("seed"), recall).where(F.col("node").startswith("memory:")).select("seed", F.substring("node", 8, 2**31 - 1).alias("id"), "path")
    reached = materialize(reached.join(best, "seed"), "reached")
    few = reached.select("id").distinct()
    found = note_index(notes.join(few, "id", "left_semi")) if notes is not None else index.join(few, "id", "left_semi")
    found = found.where(query.filters.passes(query.as_of)).dropDuplicates(["id"])
    alone = classified(found, query.text).select("id")
    if query.explicit_ids:
        alone = alone.unionByName(found.where(F.col("id").isin(*query.explicit_ids)).select("id"))
    lexical = F.col("seed_score") * F.when(F.size("path") == 1, DAMPING[0]).otherwise(DAMPING[1])
    none = F.array().cast("array<string>")
    extra = {"match_class": F.lit("graph_only"), "lexical": lexical, "matched_by": F.array(F.lit("graph")), "matched_tokens": none, "tag_hits": none, "metadata_hits": none}
    scored = found.join(alone, "id", "left_anti").join(reached, "id").withColumns(extra).withColumn("score", final_score(F.col("lexical")))
    order = W.partitionBy("id").orderBy(F.col("score").desc(), code_unit_key(F.col("seed_id")))
    once = scored.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "seed", "seed_score")
    both = direct.drop("rank").withColumns({"path": F.lit(None).cast("array<string>"), "seed_id": F.lit(None).cast("string")}).unionByName(once, allowMissingColumns=True)
    return top_matches(both, query.limit)


def path_steps(recalled: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, node, steps``: the edges of each path with their direction of travel and both ends."""
    e = edges.select(F.col("id").alias("edge_id"), "source", "target", "relationship")
    walked = recalled.select("seed", "node", F.posexplode("path").alias("hop", "edge_id")).join(e, "edge_id")
    per = walked.groupBy("seed", "node").agg(F.array_sort(F.collect_list(F.struct("hop", "edge_id", "relationship", "source", "target"))).alias("raw"))
    start = F.struct(F.array().cast("array<struct<edge_id:string,relationship:string,way:string,from:string,to:string>>").alias("done"), F.col("seed").alias("here"))

    def step(acc, x):
        onward = x["source"] == acc["here"]
        to = F.when(onward, x["target"]).otherwise(x["source"])
        entry = F.struct(x["edge_id"].alias("edge_id"), x["relationship"].alias("relationship"), F.when(onward, "out").otherwise("in").alias("way"), acc["here"].alias("from"), to.alias("to"))
        return F.struct(F.concat(acc["done"], F.array(entry)).alias("done"), to.alias("here"))

    return per.select("seed", "node", F.aggregate("raw", start, step, lambda acc: acc["done"]).alias("steps"))


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch a ``node``, each once per node it touches."""
    return adjacency(edges).join(nodes.select("node"), "node").select("node", "edge_id", "relationship", "other").distinct()


def edge_evidence(edges: DataFrame, nodes: DataFrame, limit: int = 8) -> DataFrame:
    """``node, known, shown``: the number of edges at each node and the first ``limit`` of them by id.

    Rank and limit stand alone, so of a node with a third of all edges only the first rows are shuffled to its task.
    """
    at = incident_edges(edges, nodes).select("node", "edge_id").distinct()
    known = at.groupBy("node").agg(F.count(F.lit(1)).alias("known"))
    first = at.withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy(code_unit_key(F.col("edge_id"))))).where(F.col("nth") <= limit)
    shown = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "edge_id"))).alias("s"))
    return known.join(shown, "node").select("node", "known", F.col("s.edge_id").alias("shown"))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``, self-loops included."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("id", "source", "target", "relationship")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: edges at each node, a self-loop once."""
    return edges.select("id", F.explode(F.array_distinct(F.array("source", "target"))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


__all__ = ["Recall", "class_rank", "edge_evidence", "neighbourhood", "query_with_recall", "recall_nodes"]
