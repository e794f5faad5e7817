"""Queries of the general data problems: change feeds and references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import change_log, references
from recollect.sources.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    state = change_log.current_state(table(spark, root, "wal_transactions"))
    return state.withColumn("tx_id", F.col("tx_id").cast("string"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return references.dangling_references(*(table(spark, root, t) for t in ("memory_notes", "diary_entries", "graph_edges", "removals")))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    return references.dangling_report(p7_found(spark, root))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p7_found, p7_report)}

_DANGLING = r"""
with n as (select distinct id, provenance, ingested_at, strftime(created_at, '%Y-%m') as period from memory_notes),
raw as (select id as note_id, 'parentNoteId' as field, 'note' as kind, provenance.parentNoteId as v, 'memory:' as prefix, ingested_at, period from n
    union all select id, 'parentDiaryId', 'diary', provenance.parentDiaryId, 'diary:', ingested_at, period from n
    union all select id, 'parentEdgeId', 'edge', provenance.parentEdgeId, null, ingested_at, period from n),
t as (select * exclude (v), regexp_replace(v, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') as v from raw),
r as (select *, regexp_replace(case when prefix is not null and starts_with(v, prefix) then substr(v, length(prefix) + 1) else v end, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') as ref from t),
p as (select distinct 'note' as kind, id, ingested_at as at from memory_notes union all select distinct 'diary', id, ingested_at from diary_entries union all select distinct 'edge', id, ingested_at from graph_edges),
x as (select distinct kind, id from removals),
f as (select note_id, field, case when p.id is not null then 'late' when x.id is not null then 'removed' else 'missing' end as reason, period
    from r left join p on p.kind = r.kind and p.id = r.ref left join x on x.kind = r.kind and x.id = r.ref
    where ref <> '' and (p.id is null or p.at > r.ingested_at))
"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": """
with t as (select distinct store_id, tx_id, mutation_id, ops from wal_transactions),
own as (select * from t qualify mutation_id is null or tx_id = min(tx_id) over (partition by store_id, mutation_id)),
e as (select store_id, tx_id, unnest(ops) as op, generate_subscripts(ops, 1) as ord from own),
o as (select store_id, tx_id, ord, split_part(op.type, '.', 2) as obj_kind, split_part(op.type, '.', 3) = 'put' as is_put,
    json_extract_string(op.payload, '$.id') as obj_id, json_extract_string(op.payload, '$.source') as source, json_extract_string(op.payload, '$.target') as target from e),
m as (select *, lead(tx_id) over k is null as is_last, lag(is_put) over k as was_put from o window k as (partition by store_id, obj_kind, obj_id order by tx_id, ord)),
live as (select * from m where is_last and is_put),
gone as (select store_id, obj_id as node, tx_id, ord from m where obj_kind = 'graph-node' and not is_put and was_put)
select store_id, obj_kind, obj_id, tx_id::varchar as tx_id from live l where obj_kind <> 'graph-edge' or not exists (
    select 1 from gone g where g.store_id = l.store_id and (g.node = l.source or g.node = l.target) and (g.tx_id > l.tx_id or (g.tx_id = l.tx_id and g.ord > l.ord)))""",
    "p7_found": _DANGLING + "select note_id, field, reason, period from f",
    "p7_report": _DANGLING + "select field, reason, period, count(*) as n_references, count(distinct note_id) as n_notes from f group by field, reason, period",
}
