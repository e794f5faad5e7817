"""Queries of interchange with every fault a record can have, and of imports that succeed, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import portable
from recollect.plans.registry import Registry
from recollect.sources import views
from recollect.sources.tables import records
from recollect.sources.views import VIEWS_SQL

_registry = Registry()
checked_by, QUERIES, ORACLE_SQL = _registry.checked_by, _registry.queries, _registry.oracle_sql

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_BLANK = r"regexp_replace({0}, '^[\s\x{{a0}}\x{{2009}}]+|[\s\x{{a0}}\x{{2009}}]+$', '', 'g')"


def _faulty(spark: SparkSession, root: str) -> DataFrame:
    """The export of all notes with a fault for each source, state, and some categories and scores; pinned notes are there twice."""
    n = views.notes(spark, root)
    r = portable.to_portable(n, views.diary(spark, root).limit(0)).withColumn("was", F.col("source"))
    pinned = n.where("pinned").select("id")
    r = r.withColumn("nth", F.lit(0)).unionByName(r.join(pinned, "id", "left_semi").withColumn("nth", F.lit(1)))
    by = lambda source, new, c: F.when(F.col("was") == source, new).otherwise(F.col(c))
    return r.withColumn("record_index", F.xxhash64("id", "nth")).withColumns(
        {
            "citation": by("user", F.col("citation").withField("ref", F.lit("elsewhere")), "citation"),
            "schema": by("conversation", F.lit(None), "schema"),
            "kind": by("ai", F.lit("memo"), "kind"),
            "text": F.when(F.col("category") == "event", F.repeat(F.lit("x"), portable.MAX_TEXT + 1)).otherwise(F.col("text")),
            "createdAt": F.when(F.col("status") == "archived", "2024-02-30T00:00:00.000Z").otherwise(F.col("createdAt")),
            "updatedAt": F.when(F.col("status") == "candidate", "2001-01-01T00:00:00.000Z").otherwise(F.col("updatedAt")),
            "tags": F.when(F.size("tags") > 0, F.col("tags")),
            "source": F.when(F.col("category") == "project", "web").otherwise(F.col("source")),
            "confidence": F.when(F.col("confidence") > 0.9, 1.5).otherwise(F.col("confidence")),
        }
    ).withColumns({"status": F.when(F.col("status") == "rejected", "gone").otherwise(F.col("status"))}).withColumn("schema", by("diary", F.lit("v0"), "schema")).withColumn("id", F.when(F.col("was") == "system", F.lit(None)).when(F.col("was") == "imported", F.concat(F.lit(" "), "id")).otherwise(F.col("id")))


@checked_by(f"""with {VIEWS_SQL}, two as (select *, 0 as nth from notes union all select *, 1 from notes where pinned),
x as (select *, case source when 'system' then null when 'imported' then ' ' || id else id end as rid, case when source = 'ai' then 'memo' else 'note' end as kind,
    coalesce(created_at, timestamp '1970-01-01') as c, coalesce(updated_at, timestamp '1970-01-01') as u from two),
y as (select *, rid is not null as named, rid is not null and row_number() over (partition by rid order by nth) > 1 as again from x),
i as (select rid, unnest(list_filter([
    case when source = 'conversation' then 'MALFORMED_RECORD schema' when source = 'diary' then 'UNSUPPORTED_SCHEMA schema' end, case when kind = 'memo' then 'INVALID_KIND kind' end, case when not named then 'INVALID_ID id' end,
    case when again then 'DUPLICATE_PAYLOAD_ID id' when named and source = 'imported' then 'INVALID_ID id' end,
    case when named and kind = 'note' and status = 'active' and source <> 'imported' then 'EXISTING_ID_CONFLICT id' end,
    case when named and category = 'event' then 'INPUT_LIMIT_EXCEEDED text' when named and {_BLANK.format('content')} = '' then 'MALFORMED_RECORD text' end,
    case when named and (created_at is null or status = 'archived') then 'INVALID_TIMESTAMP createdAt' end, case when named and updated_at is null and status <> 'candidate' then 'INVALID_TIMESTAMP updatedAt' end,
    case when named and created_at is not null and status <> 'archived' and (case when status = 'candidate' then timestamp '2001-01-01' else updated_at end) < created_at then 'INVALID_CHRONOLOGY updatedAt' end,
    case when named and source in ('user', 'ai', 'imported') then 'INVALID_CITATION citation' end, case when named and len(tags) = 0 then 'MALFORMED_RECORD tags' end,
    case when named and kind = 'note' and status = 'rejected' then 'INVALID_STATUS status' end, case when named and kind = 'note' and coalesce(category = 'project', false) then 'INVALID_SOURCE source' end,
    case when named and kind = 'note' and confidence > 0.9 then 'MALFORMED_RECORD confidence' end], lambda x: x is not null)) as z from y)
select case when z in ('MALFORMED_RECORD schema', 'UNSUPPORTED_SCHEMA schema', 'INVALID_KIND kind') or rid is null then null else rid end as record_id, split_part(z, ' ', 1) as code, split_part(z, ' ', 2) as field_path from i""")
def import_faults(spark: SparkSession, root: str) -> DataFrame:
    """Every code an import can give, over all notes, into a store that holds the active ones."""
    active = views.notes(spark, root).where("status = 'active'").select("id")
    issues = portable.record_issues(_faulty(spark, root), active)
    by_record = F.col("field_path").isin("schema", "kind")
    return issues.select(F.when(~by_record, F.col("record_id")).alias("record_id"), "code", "field_path")


def _batches(spark: SparkSession, root: str) -> DataFrame:
    """All stored records as imports, one for each month they were made in and source they came from."""
    n = records(spark, root, "memory_notes", "id", "content", "tags", "category", "source", "status", "confidence", "created_at", "updated_at")
    d = records(spark, root, "diary_entries", "id", "content", "tags", "created_at", "updated_at")
    r = portable.to_portable(n, d).withColumn("record_index", F.xxhash64("kind", "id"))
    return r.withColumn("batch", F.concat_ws(" ", F.substring("createdAt", 1, 10), F.coalesce("source", F.lit("diary entry"))))


_BATCHES = f"""with raw as (select distinct 'note' as kind, id, content, tags, category, source, status, confidence, created_at, updated_at from memory_notes
    union all select distinct 'diary', id, content, tags, null, null, null, null, created_at, updated_at from diary_entries),
c as (select *, concat_ws(' ', strftime(created_at, '%Y-%m-%d'), coalesce(source, 'diary entry')) as batch, content is null or {_BLANK.format('content')} = '' or created_at is null or updated_at is null or coalesce(updated_at < created_at, false)
    or tags is null or coalesce(list_contains(list_transform(tags, lambda t: t is null), true), false) or coalesce(status not in ('candidate', 'active', 'archived', 'rejected'), false)
    or coalesce(source not in ('user', 'conversation', 'diary', 'ai', 'imported', 'system'), false) or coalesce(isnan(confidence) or confidence < 0 or confidence > 1, false) as bad from raw),
z as (select *, 6 + 24 + 2 + length(id) + 4 + length(kind) + coalesce(4 + length(content), 0) + 8 + 3 + length(kind) + 1 + length(id) + 4 + length(kind) + 2 + length(id)
    + case when tags is null then 0 else 4 + coalesce(list_sum(list_transform(tags, lambda t: coalesce(length(t), 0))), 0) end::bigint + coalesce(8 + length(category), 0) + coalesce(6 + length(source), 0) + coalesce(6 + length(status), 0)
    + case when confidence is null then 0 else 10 end + case when created_at is null then 0 else 33 end + case when updated_at is null then 0 else 33 end as chars from c),
b as (select batch, count(*) as n_records, sum(chars)::bigint as chars, count(*) filter (where bad) as n_bad, bool_or(bad) or count(*) > 10000 or sum(chars) > 5000000 as blocking from z group by batch)
"""


@checked_by(_BATCHES + "select batch, n_records, n_bad, chars, blocking, case when blocking then 0 else n_records end as imported from b")
def import_batches(spark: SparkSession, root: str) -> DataFrame:
    """The outcome of each import: all of its records or none."""
    r = _batches(spark, root)
    return portable.receipts(r, portable.record_issues(r), "batch").select("batch", "n_records", "n_bad", "chars", "blocking", "imported")


@checked_by(_BATCHES + f"""select 'note' as kind, id, {_BLANK.format('content')} as content, coalesce(source, 'imported') as source, coalesce(status, 'active') as status, coalesce(confidence, 0.75) as confidence from z join b using (batch) where not blocking and kind = 'note'
union all select 'diary', id, {_BLANK.format('content')}, null, null, null from z join b using (batch) where not blocking and kind = 'diary'""")
def imported_records(spark: SparkSession, root: str) -> DataFrame:
    """The notes and entries of all imports that succeed."""
    r = _batches(spark, root)
    good = portable.receipts(r, portable.record_issues(r), "batch").where("not blocking").select("batch")
    notes, diary = portable.accepted(r.join(good, "batch", "left_semi"))
    both = notes.withColumn("kind", F.lit("note")).unionByName(diary.withColumn("kind", F.lit("diary")), allowMissingColumns=True)
    return both.select("kind", "id", "content", "source", "status", "confidence")
