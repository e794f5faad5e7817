"""Ranked lexical retrieval with evidence, and diary search."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import code_unit_key, contains_phrase, hits, phrase, query_tokens, tokens

# Match classes from best to least with their base scores, and the steps added to them.
CLASSES = ("explicit_id", "exact_phrase", "full_token_match", "partial_token_match", "tag_metadata_match", "graph_only")
BASE = {"exact_phrase": 0.9, "full_token_match": 0.7, "partial_token_match": 0.5, "tag_metadata_match": 0.3}
PER_HIT, BY_IMPORTANCE, BY_CONFIDENCE = 0.02, 0.05, 0.025
MATCHED_BY = {"exact_phrase": ("exact_phrase", "token"), "full_token_match": ("full_token_match", "token"), "partial_token_match": ("partial_token_match", "token")}


@dataclass(frozen=True)
class Filters:
    """Which notes a query may return. All ``tags`` must be there, any of ``categories``."""

    include_candidate: bool = False
    include_archived: bool = False
    include_expired: bool = False
    pinned_only: bool = False
    tags: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()

    def named(self) -> list[str]:
        """The filters asked for, by the names callers know them by."""
        names = {"include_candidate": "includeCandidate", "include_archived": "includeArchived", "include_expired": "includeExpired", "pinned_only": "pinnedOnly", "tags": "tags", "categories": "categories"}
        return [n for k, n in names.items() if getattr(self, k)]

    def passes(self, as_of: datetime) -> Column:
        """The predicate at ``as_of``; a note that expires just then is expired. Rejected notes pass."""
        ok = F.lit(True)
        hidden = [s for s, shown in (("candidate", self.include_candidate), ("archived", self.include_archived)) if not shown]
        if hidden:
            ok &= ~F.col("status").isin(*hidden)
        if not self.include_expired:
            ok &= F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
        if self.pinned_only:
            ok &= F.col("pinned")
        if self.tags:
            ok &= F.size(F.array_except(F.array(*map(F.lit, self.tags)), F.col("tags"))) == 0
        if self.categories:
            ok &= F.coalesce(F.col("category").isin(*self.categories), F.lit(False))
        return ok


@dataclass(frozen=True)
class Query:
    text: str
    as_of: datetime
    filters: Filters = field(default_factory=Filters)
    limit: int = 50
    explicit_ids: tuple[str, ...] = ()


def metadata_text(metadata: Column) -> Column:
    """Keys and values of a JSON object as one text, nested values as JSON."""
    m = F.from_json(metadata, "map<string,string>")
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(" ", e["key"], F.coalesce(e["value"], F.lit("null")))), " ")


def note_index(notes: DataFrame) -> DataFrame:
    """Notes with their token columns; write it once where many queries follow."""
    return notes.withColumns(
        {
            "tokens": tokens(F.concat_ws(" ", F.col("content"), F.coalesce("summary", F.lit("")))),
            "tag_tokens": F.array_distinct(tokens(F.concat_ws(" ", F.array_join("tags", " "), F.coalesce("category", F.lit(""))))),
            "metadata_tokens": F.array_distinct(tokens(metadata_text(F.col("metadata")))),
        }
    )


def diary_index(diary: DataFrame) -> DataFrame:
    """Diary entries with the tokens of content and tags."""
    return diary.withColumn("tokens", tokens(F.concat_ws(" ", F.col("content"), F.array_join("tags", " "))))


def final_score(lexical: Column) -> Column:
    """A score with the parts of importance and confidence added in this order."""
    return lexical + F.col("importance") * F.lit(BY_IMPORTANCE) + F.col("confidence") * F.lit(BY_CONFIDENCE)


def classified(index: DataFrame, text: str) -> DataFrame:
    """Notes of ``index`` that match ``text`` at all, with class, lexical score and evidence."""
    q = query_tokens(text)
    if not q:
        return index.limit(0).withColumns({"match_class": F.lit(""), "lexical": F.lit(0.0), "score": F.lit(0.0), "matched_by": F.array().cast("array<string>")} | {c: F.array().cast("array<string>") for c in ("matched_tokens", "tag_hits", "metadata_hits")})
    found = index.withColumns({"matched_tokens": hits(q, F.col("tokens")), "tag_hits": hits(q, F.col("tag_tokens")), "metadata_hits": hits(q, F.col("metadata_tokens"))})
    n, n_other = F.size("matched_tokens"), F.size("tag_hits") + F.size("metadata_hits")
    kind = F.when(contains_phrase(F.col("tokens"), q), "exact_phrase").when(n == len(q), "full_token_match").when(n > 0, "partial_token_match").when(n_other > 0, "tag_metadata_match")
    steps = F.when(F.col("match_class") == "tag_metadata_match", n_other).otherwise(n)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.col("match_class"))
    by = F.coalesce(
        *[F.when(F.col("match_class") == k, F.array(*map(F.lit, v))) for k, v in MATCHED_BY.items()],
        F.array_compact(F.array(F.when(F.size("tag_hits") > 0, "tag"), F.when(F.size("metadata_hits") > 0, "metadata"))),
    )
    # The filter on the class is the empty array of an explode: a predicate would be pushed below the tokens and compute them twice.
    matching = F.explode(F.filter(F.array(kind), lambda k: k.isNotNull())).alias("match_class")
    return found.select("*", matching).withColumn("lexical", base + steps * F.lit(PER_HIT)).withColumns({"score": final_score(F.col("lexical")), "matched_by": by})


def class_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), c)


def ranking() -> list[Column]:
    """Best first: class, score, later update, id in code-unit order."""
    return [class_rank(F.col("match_class")).asc(), F.col("score").desc(), F.col("updated_at").desc_nulls_last(), code_unit_key(F.col("id")).asc()]


def explicit_matches(index: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The named notes as explicit matches; they rank first with a lexical score of 0."""
    none = F.array().cast("array<string>")
    return (
        index.where(F.col("id").isin(*ids))
        .withColumns({"match_class": F.lit("explicit_id"), "lexical": F.lit(0.0), "matched_by": F.array(F.lit("explicit_id")), "matched_tokens": none, "tag_hits": none, "metadata_hits": none})
        .withColumn("score", final_score(F.col("lexical")))
    )


def direct_matches(index: DataFrame, query: Query) -> DataFrame:
    """All direct candidates of a query, one row per note: explicit ids before lexical matches.

    Rows of ``index`` that repeat a note are dropped here, among the matches, rather than before whole texts are shuffled.
    """
    seen = index.where(query.filters.passes(query.as_of))
    found = classified(seen, query.text)
    if query.explicit_ids:
        found = explicit_matches(seen, query.explicit_ids).unionByName(found.where(~F.col("id").isin(*query.explicit_ids)))
    return found.dropDuplicates(["id"])


def top_matches(matches: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` matches with their ``rank`` from 1; only these reach one task."""
    return matches.orderBy(*ranking()).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*ranking())))


def query_notes(index: DataFrame, query: Query) -> DataFrame:
    return top_matches(direct_matches(index, query), query.limit)


def evidence(matches: DataFrame, text: str) -> DataFrame:
    """``id, evidence``: what matched and what each part contributed to the score."""
    return matches.select(
        "id",
        F.struct(
            "match_class",
            "score",
            "matched_tokens",
            F.col("tag_hits").alias("tags"),
            F.col("metadata_hits").alias("metadata_fields"),
            (F.col("match_class") == "explicit_id").alias("explicit_id"),
            F.when(F.col("match_class") == "exact_phrase", " ".join(query_tokens(text))).alias("exact_phrase"),
            F.col("lexical").alias("by_text"),
            (F.col("importance") * BY_IMPORTANCE).alias("by_importance"),
            (F.col("confidence") * BY_CONFIDENCE).alias("by_confidence"),
        ).alias("evidence"),
    )


def search_diary(index: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Diary entries that hold a token of ``text``, latest first."""
    q = query_tokens(text)
    if not q:
        return index.limit(0).withColumns({"matched_by": F.array().cast("array<string>"), "rank": F.lit(0)})
    exact = contains_phrase(F.col("tokens"), q)
    order = [F.col("updated_at").desc_nulls_last(), code_unit_key(F.col("id"))]
    return (
        index.where(F.arrays_overlap("tokens", F.array(*map(F.lit, q))))
        .withColumn("matched_by", F.when(exact, F.array(F.lit("exact_phrase"), F.lit("token"))).otherwise(F.array(F.lit("token"))))
        .dropDuplicates(["id"])
        .orderBy(*order)
        .limit(limit)
        .withColumn("rank", F.row_number().over(W.orderBy(*order)))
    )


def normal_phrase(text: str) -> str:
    return " ".join(query_tokens(text))


__all__ = ["Filters", "Query", "classified", "diary_index", "direct_matches", "evidence", "note_index", "phrase", "query_notes", "search_diary", "top_matches"]
