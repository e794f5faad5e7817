"""Analysis cycle: a selector becomes a bounded plan bound by digests, the plan becomes proposals.

Selection and relations are DataFrame work over the whole tables; a plan holds at most 128 sources and 1,024 relations and is
encoded on the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.canonical import EncodingError, canonical_json
from recollect.functions.text import code_unit_key, query_tokens, tokens
from recollect.operators.condense import condensed

# Names and ceilings that enter the digests.
ALGORITHM = "ether.dream.v1"
DOMAINS = {"dependencies": "ether.dream.dependencies.v1", "plan": "ether.dream.plan.v1", "proposal": "ether.dream.proposal.v1"}
BUDGETS = {
    "maxPopulation": 4096,
    "maxSources": 128,
    "maxTags": 64,
    "maxContentBytes": 65536,
    "maxNoteDependencyBytes": 131072,
    "maxSelectionBytes": 4194304,
    "maxDependencyBytes": 1048576,
    "maxRelationships": 1024,
    "maxPlanBytes": 65536,
}
MAX_NAMES = 256
MAX_PROPOSALS, MAX_EDGES, MAX_PROPOSAL_BYTES, MAX_ARRAY_BYTES = 32, 8, 16384, 261120


class DreamError(ValueError):
    """A request or its dependencies break a rule; ``code`` says which kind."""

    def __init__(self, message: str, code: str = "INVALID_INPUT"):
        super().__init__(message)
        self.code = code


def _ordered(values: list[str]) -> list[str]:
    return sorted(set(values), key=lambda s: s.encode("utf-16-be"))


@dataclass(frozen=True)
class Request:
    """A normal request: selector (kind and its one field), time in epoch milliseconds, budgets."""

    selector: dict[str, Any]
    as_of: int
    budgets: dict[str, int]

    @classmethod
    def normal(cls, selector: dict[str, Any], as_of: int, budgets: dict[str, int] | None = None) -> Request:
        """Budgets may only shrink, lists are distinct and sorted, a query is its tokens, a window must not be reversed."""
        limits = dict(BUDGETS)
        for k, v in (budgets or {}).items():
            if k not in BUDGETS or not isinstance(v, int) or not 1 <= v <= BUDGETS[k]:
                raise DreamError(f"budget {k} may only lower its ceiling")
            limits[k] = v
        kind, fields = selector.get("kind"), {k: v for k, v in selector.items() if k != "kind"}
        allowed = {"ids": {"ids"}, "tags": {"tags"}, "query": {"query"}, "date-window": {"from", "to"}, "all_active": set()}
        if kind not in allowed or set(fields) != allowed[kind]:
            raise DreamError("one supported selector with its own fields is needed")
        if kind in ("ids", "tags"):
            values = fields[kind]
            if not values or len(values) > MAX_NAMES or any(not isinstance(v, str) or not v.strip() or len(v) > 256 for v in values):
                raise DreamError(f"a selector needs 1 to {MAX_NAMES} names")
            fields = {kind: _ordered(values)}
        elif kind == "query":
            q = " ".join(query_tokens(fields["query"]))
            if not q or len(q) > 4096:
                raise DreamError("a query needs tokens")
            fields = {"query": q}
        elif kind == "date-window" and fields["from"] > fields["to"]:
            raise DreamError("the window is reversed")
        return cls({"kind": kind, **fields}, as_of, limits)


def eligible(as_of: int) -> Column:
    """Active, created by ``as_of`` and not expired at it."""
    at = F.lit(datetime.fromtimestamp(as_of / 1000, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    return (F.col("status") == "active") & (F.col("created_at") <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") > at))


def selected(notes: DataFrame, request: Request) -> DataFrame:
    """All notes the selector picks, before the source ceiling."""
    s, ok = request.selector, eligible(request.as_of)
    if s["kind"] == "ids":
        return notes.where(ok & F.col("id").isin(*s["ids"]))
    if s["kind"] == "tags":
        return notes.where(ok & (F.size(F.array_except(F.array(*map(F.lit, s["tags"])), F.col("tags"))) == 0))
    if s["kind"] == "query":
        q = s["query"].split(" ")
        return notes.where(ok).withColumn("__t", tokens(F.col("content"))).where(F.size(F.array_except(F.array(*map(F.lit, q)), F.col("__t"))) == 0).drop("__t")
    if s["kind"] == "date-window":
        low, high = (F.lit(datetime.fromtimestamp(s[k] / 1000, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz") for k in ("from", "to"))
        return notes.where(ok & (F.col("created_at") >= low) & (F.col("created_at") < high))
    return notes.where(ok)


def _selection_bytes(notes: DataFrame, request: Request) -> int:
    """The bytes a selector other than ids reads: every id, and of eligible notes the distinct tags or the content."""
    read = {"tags": F.aggregate(F.array_distinct("tags"), F.lit(0), lambda n, t: n + F.octet_length(t)), "query": F.octet_length("content")}
    more = F.when(eligible(request.as_of), read.get(request.selector["kind"], F.lit(0)))
    return notes.agg(F.sum(F.octet_length("id") + F.coalesce(more, F.lit(0)))).first()[0] or 0


def _millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def dependency_rows(notes: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` notes by id as dependencies: tags distinct and sorted, times in epoch milliseconds."""
    first = notes.orderBy(code_unit_key(F.col("id"))).limit(limit)
    return first.select("id", "content", F.array_sort(F.array_distinct("tags")).alias("tags"), "status", _millis("created_at").alias("created_at"), _millis("expires_at").alias("expires_at"))


def induced_relations(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, source, target, relationship`` of edges between selected notes, named by note id; self-loops included."""
    e = edges.where(F.col("source").startswith("memory:") & F.col("target").startswith("memory:"))
    e = e.select("id", *[F.substring(F.col(c), 8, 2**31 - 1).alias(c) for c in ("source", "target")], "relationship")
    for end in ("source", "target"):
        e = e.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return e.select("id", "source", "target", "relationship")


@dataclass
class Plan:
    """A plan with its captured dependencies (at most the budgets' size)."""

    fields: dict[str, Any]
    notes: list[dict[str, Any]]
    relationships: list[dict[str, str]]

    @property
    def plan_id(self) -> str:
        return self.fields["planId"]


def _sha(value: Any, limit: int) -> str:
    try:
        return hashlib.sha256(canonical_json(value, limit)).hexdigest()
    except EncodingError as e:
        raise DreamError("dependencies pass their bounds") from e


def preview(notes: DataFrame, edges: DataFrame, request: Request) -> Plan:
    """Capture the dependencies of a request and bind them. Ceilings other than the source count are errors."""
    b, s = request.budgets, request.selector
    if s["kind"] == "ids":
        have = {r.id: r.ok for r in notes.where(F.col("id").isin(*s["ids"])).select("id", eligible(request.as_of).alias("ok")).collect()}
        read = 0
        for i in s["ids"]:
            if i not in have:
                raise DreamError("a note asked for does not exist", "NOT_FOUND")
            if not have[i]:
                raise DreamError("a note asked for is not eligible")
            read += len(i.encode())
            if read > b["maxSelectionBytes"]:
                raise DreamError("the selector reads more bytes than its ceiling")
    elif notes.limit(b["maxPopulation"] + 1).count() > b["maxPopulation"]:
        raise DreamError("the population passes its ceiling; name ids")
    elif _selection_bytes(notes, request) > b["maxSelectionBytes"]:
        raise DreamError("the selector reads more bytes than its ceiling")
    picked = selected(notes, request)
    known = picked.count()
    deps = dependency_rows(picked, b["maxSources"])
    rows = deps.collect()  # at most maxSources
    captured = []
    for r in rows:
        if len(r.content.encode()) > b["maxContentBytes"]:
            raise DreamError("a source's content passes its ceiling")
        if len(r.tags) > b["maxTags"]:
            raise DreamError("a source has too many tags")
        captured.append({"id": r.id, "content": r.content, "tags": _ordered(r.tags), "status": "active", "createdAt": r.created_at, "expiresAt": r.expires_at})
        _sha(captured[-1], b["maxNoteDependencyBytes"])
    relations = [r.asDict() for r in induced_relations(edges, deps).limit(b["maxRelationships"] + 1).collect()]
    if len(relations) > b["maxRelationships"]:
        raise DreamError("the relations pass their ceiling")
    relations.sort(key=lambda r: tuple(r[k].encode("utf-16-be") for k in ("id", "source", "target", "relationship")))
    return bind(request, captured, relations, known)


def bind(request: Request, captured: list[dict[str, Any]], relations: list[dict[str, str]], known: int) -> Plan:
    """The plan of captured dependencies with both digests."""
    ids = [n["id"] for n in captured]
    coverage = {"selectedSourceIds": ids, "selectedCount": len(ids), "knownCount": known, "selectionTruncated": known > len(ids), "truncationReasons": ["source-limit"] if known > len(ids) else []}
    b = request.budgets
    dependency = _sha({"domain": DOMAINS["dependencies"], "algorithm": ALGORITHM, "selector": request.selector, "asOf": request.as_of, "budgets": b, "coverage": coverage, "notes": captured, "relationships": relations}, b["maxDependencyBytes"])
    fields = {"algorithm": ALGORITHM, "asOf": request.as_of, "selector": request.selector, **coverage, "dependencyDigest": dependency, "budgets": b, "graph": {"relationshipCount": len(relations)}}
    plan_id = _sha({"domain": DOMAINS["plan"], **fields}, b["maxPlanBytes"])
    return Plan({**fields, "planId": plan_id}, captured, relations)


def validate_plan(fields: dict[str, Any]) -> None:
    """Check a plan's structure and that its id is that of its fields."""
    need = {"algorithm", "asOf", "selector", "selectedSourceIds", "selectedCount", "knownCount", "selectionTruncated", "truncationReasons", "dependencyDigest", "budgets", "graph", "planId"}
    if set(fields) != need or fields["algorithm"] != ALGORITHM:
        raise DreamError("no plan of this algorithm")
    ids = fields["selectedSourceIds"]
    if ids != _ordered(ids) or len(ids) != fields["selectedCount"] or fields["knownCount"] < len(ids) or fields["selectionTruncated"] != (fields["knownCount"] > len(ids)):
        raise DreamError("the plan's counts disagree")
    if _sha({"domain": DOMAINS["plan"], **{k: v for k, v in fields.items() if k != "planId"}}, fields["budgets"]["maxPlanBytes"]) != fields["planId"]:
        raise DreamError("the plan's id is not its own")


def analysed(notes: DataFrame) -> DataFrame:
    """``id, content, key_facts``: condensation of each source with the frozen configuration."""
    return condensed(notes).select("id", F.col("summary").alias("content"), "key_facts")


def novel_outputs(notes: DataFrame) -> DataFrame:
    """Analyses worth proposing: content unlike every source body, and the first by id of equal (content, facts)."""
    digest = F.unhex(F.sha2("content", 256)).alias("digest")  # bodies are compared, and sent, by digest
    fresh = analysed(notes).select("*", digest).join(notes.select(digest).distinct(), "digest", "left_anti")
    once = fresh.groupBy("content", "key_facts").agg(F.min(F.struct(code_unit_key(F.col("id")).alias("k"), "id")).alias("m"))
    return once.select(F.col("m.id").alias("id"), "content", "key_facts")


def proposal(source: str, content: str, facts: list[str], relations: list[dict[str, str]], plan_id: str) -> dict[str, Any]:
    """A proposal with as many of its first relations as fit, and its id."""
    incident = [r for r in relations if source in (r["source"], r["target"])]

    def fields(take: int, cut: bool) -> dict[str, Any]:
        reasons = ["relationship-limit"] * (len(incident) > MAX_EDGES) + ["relationship-byte-limit"] * cut
        shown = [{k: r[k] for k in ("id", "source", "target", "relationship")} for r in incident[:take]]
        return {"content": content, "sourceIds": [source], "evidence": {"keyFacts": facts, "relationships": shown, "relationshipKnownCount": len(incident), "relationshipsTruncated": take < len(incident), "truncationReasons": reasons}}

    for take in range(min(len(incident), MAX_EDGES), -1, -1):
        f = fields(take, take < min(len(incident), MAX_EDGES))
        if len(canonical_json({"proposalId": "0" * 64, **f})) <= MAX_PROPOSAL_BYTES:
            return {"proposalId": _sha({"domain": DOMAINS["proposal"], "algorithm": ALGORITHM, "planId": plan_id, **f}, 32768), **f}
    raise DreamError("a proposal passes its bounds")


def admit(proposals: list[dict[str, Any]]) -> dict[str, Any]:
    """The first proposals within the count and byte ceilings, with what was cut and why."""
    kept, size, cut = [], 2, False
    for p in proposals[:MAX_PROPOSALS]:
        n = len(canonical_json(p)) + bool(kept)
        if size + n > MAX_ARRAY_BYTES:
            cut = True
            break
        size += n
        kept.append(p)
    reasons = ["proposal-limit"] * (len(proposals) > MAX_PROPOSALS) + ["result-byte-limit"] * cut
    return {"knownProposalCount": len(proposals), "proposalCount": len(kept), "proposals": kept, "proposalsTruncated": len(kept) < len(proposals), "truncationReasons": reasons}


def run(notes: DataFrame, edges: DataFrame, plan: Plan) -> dict[str, Any]:
    """Check a plan, capture its dependencies again and analyse them; other dependencies now are a conflict."""
    f = plan.fields
    validate_plan(f)
    again = preview(notes, edges, Request(f["selector"], f["asOf"], f["budgets"]))
    if again.fields != f:
        raise DreamError("the sources changed since the plan was made", "CONFLICT")
    spark = notes.sparkSession
    sources = spark.createDataFrame([(n["id"], n["content"]) for n in again.notes], "id string, content string")
    rows = sorted(novel_outputs(sources).collect(), key=lambda r: r.id.encode("utf-16-be"))
    made = [proposal(r.id, r.content, list(r.key_facts), again.relationships, plan.plan_id) for r in rows]
    return {"algorithm": ALGORITHM, "planId": plan.plan_id, "dependencyDigest": f["dependencyDigest"], "asOf": f["asOf"], "sourceCount": len(again.notes), **admit(made)}


def as_json(value: dict[str, Any]) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
