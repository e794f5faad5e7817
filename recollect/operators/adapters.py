"""Adapters of a context for callers, and summaries through an optional host. Values here are bounded by a context's budgets."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.context import Context

# Sizes of a summary request.
MAX_TEXT, MAX_REFERENCES, MAX_ID = 12_000, 32, 256


def context_json(context: Context, pretty: bool = True) -> str:
    """A context as one JSON text."""
    lists = {"items": context.chosen.drop("content", "metadata").orderBy("ord"), "nodes": context.graph_nodes.orderBy("ord"), "edges": context.graph_edges.orderBy("ord"), "citations": context.citations().orderBy("ord"), "conflicts": context.claim_flags()}
    value: dict[str, Any] = {k: [r.asDict(True) for r in df.collect()] for k, df in lists.items()}
    return json.dumps(value | {"report": context.report().first().asDict()}, ensure_ascii=False, indent=2 if pretty else None)


def tool_result(context: Context) -> dict[str, Any]:
    """A context as the result of a tool call; partial where a budget was hit."""
    value = json.loads(context_json(context, pretty=False))
    return {"ok": True, "context": value, "citations": value["citations"], "partial": value["report"]["hit_budget"]}


def handles(context: Context) -> DataFrame:
    """One row: the ids of each kind in order."""
    c = context.citations()
    kinds = ("note", "diary", "node", "edge")
    return c.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "id")))), lambda x: x["id"]).alias(f"{k}_ids") for k in kinds])


@dataclass(frozen=True)
class Summary:
    """``route`` taken, its text and whether it degraded, and the references the host was given."""

    route: str
    text: str | None
    origin: str | None
    degraded: bool = False
    reason: str | None = None
    provided: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()


def _valid(max_chars: int, text: str | None, references: list[tuple[str, str]] | None) -> None:
    if not isinstance(max_chars, int) or not 1 <= max_chars <= MAX_TEXT or (text is None) == (references is None):
        raise ValueError("INVALID_INPUT: invalid summary request")
    if text is not None and len(text) > MAX_TEXT:
        raise ValueError("INVALID_INPUT: the text is too long")
    if references is not None:
        if not 1 <= len(references) <= MAX_REFERENCES or len(set(references)) < len(references) or any(k not in ("note", "diary", "node", "edge") or not 1 <= len(i) <= MAX_ID for k, i in references):
            raise ValueError("INVALID_INPUT: invalid references")
        if any(k in ("node", "edge") for k, _ in references):
            raise ValueError("UNSUPPORTED_SCHEMA: only notes and diary entries are evidence")


def excerpts(contents: list[str], room: int) -> list[str]:
    """Leading parts of the contents that fit ``room`` characters together, one character between each two."""
    out: list[str] = []
    for text in contents:
        left = room - sum(map(len, out)) - len(out)
        if left <= 0:
            break
        out.append(text[:left])
    return out


def summarize(
    max_chars: int,
    text: str | None = None,
    references: list[tuple[str, str]] | None = None,
    resolve: Callable[[str, str], str | None] | None = None,
    host: Callable[[Any], str] | None = None,
    disclose: bool = False,
    fall_back: bool = True,
    timeout: float = 3.0,
) -> Summary:
    """A summary by the host where disclosure is allowed and it answers in bounds, else a local excerpt, else none."""
    _valid(max_chars, text, references)
    names: tuple[str, ...] = ()
    if references is not None:
        if resolve is None:
            return Summary("unavailable", None, None, reason="hybrid_unsupported")
        contents = [resolve(k, i) for k, i in references]
        if any(c is None or not c.strip() for c in contents):
            raise ValueError("NOT_FOUND: unknown evidence")
        given = excerpts([c for c in contents if c], MAX_TEXT)
        names = tuple(f"{k}:{i}" for k, i in references[: len(given)])
        payload: Any = {"evidence": [{"ref": n, "excerpt": e} for n, e in zip(names, given)], "max_chars": max_chars}
        local = excerpts(given, max_chars)
    else:
        payload, local = {"text": text, "max_chars": max_chars}, [(text or "")[:max_chars]]

    def fail(reason: str, provided: tuple[str, ...] = ()) -> Summary:
        if not fall_back:
            return Summary("unavailable", None, None, reason=reason, provided=provided)
        return Summary("local-deterministic", "\n".join(local), "local", True, reason, provided, names[: len(local)])

    if not disclose:
        return fail("disclosure_denied")
    if host is None:
        return fail("capability_absent")
    pool = ThreadPoolExecutor(1)
    try:
        answer = pool.submit(host, payload).result(timeout)
    except Late:
        return fail("timeout", names)
    except Exception:  # the host's own failures are not passed on
        return fail("host_failed", names)
    finally:
        pool.shutdown(wait=False)
    if not isinstance(answer, str) or not 1 <= len(answer) <= max_chars:
        return fail("host_output_invalid", names)
    return Summary("hybrid" if references is not None else "native-assisted", answer, "host", provided=names)
