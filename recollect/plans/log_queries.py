"""Queries of interchange, validation, mutation, analysis and log operators over whole tables, each with its SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import change_log, dream, history, mutations, portable, validate
from recollect.plans.registry import Registry
from recollect.plans.store_queries import AS_OF, CONDENSE_SQL
from recollect.session import materialize
from recollect.sources import views
from recollect.sources.tables import records, table
from recollect.sources.views import TOKENS_SQL, VIEWS_SQL

AS_OF_MS = int(AS_OF.replace(tzinfo=timezone.utc).timestamp() * 1000)
_registry = Registry()
checked_by, QUERIES, ORACLE_SQL = _registry.checked_by, _registry.queries, _registry.oracle_sql

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


# --- interchange -------------------------------------------------------------------------------------------------


def _stored_records(spark: SparkSession, root: str) -> DataFrame:
    """All notes and diary entries as stored, unrepaired, as interchange records numbered by kind and id."""
    n = records(spark, root, "memory_notes", "id", "content", "tags", "category", "source", "status", "confidence", "created_at", "updated_at")
    d = records(spark, root, "diary_entries", "id", "content", "tags", "created_at", "updated_at")
    r = portable.to_portable(n, d)
    return r.withColumn("record_index", F.xxhash64("kind", "id"))


_RECORDS = f"""with raw as (select distinct 'note' as kind, id, content, tags, source, status, confidence, created_at, updated_at from memory_notes
    union all select distinct 'diary', id, content, tags, null, null, null, created_at, updated_at from diary_entries),
i as (select kind, id as record_id, unnest(list_filter([
    case when content is null or regexp_replace(content, '[\\s\\x{{a0}}\\x{{2009}}]', '', 'g') = '' then 'MALFORMED_RECORD text' end,
    case when created_at is null then 'INVALID_TIMESTAMP createdAt' end, case when updated_at is null then 'INVALID_TIMESTAMP updatedAt' end,
    case when updated_at < created_at then 'INVALID_CHRONOLOGY updatedAt' end,
    case when tags is null or list_contains(list_transform(tags, lambda t: t is null), true) then 'MALFORMED_RECORD tags' end,
    case when kind = 'note' and status is not null and status not in ('candidate', 'active', 'archived', 'rejected') then 'INVALID_STATUS status' end,
    case when kind = 'note' and source is not null and source not in ('user', 'conversation', 'diary', 'ai', 'imported', 'system') then 'INVALID_SOURCE source' end,
    case when kind = 'note' and confidence is not null and (isnan(confidence) or confidence < 0 or confidence > 1) then 'MALFORMED_RECORD confidence' end], lambda x: x is not null)) as x from raw)
"""


@checked_by(f"""with {VIEWS_SQL} select 'note' as kind, id, content as text, 'note:' || id as ref, array_to_string(tags, ',') as tags, category, source, status, confidence, {_ISO.format('created_at')} as "createdAt", {_ISO.format('updated_at')} as "updatedAt" from notes
union all select 'diary', id, content, 'diary:' || id, array_to_string(tags, ','), null, null, null, null, {_ISO.format('created_at')}, {_ISO.format('updated_at')} from diary""")
def portable_export(spark: SparkSession, root: str) -> DataFrame:
    r = portable.to_portable(views.notes(spark, root), views.diary(spark, root))
    return r.select("kind", "id", "text", "citation.ref", F.array_join("tags", ",").alias("tags"), "category", "source", "status", "confidence", "createdAt", "updatedAt")


@checked_by(_RECORDS + "select record_id, split_part(x, ' ', 1) as code, split_part(x, ' ', 2) as field_path from i")
def import_issues(spark: SparkSession, root: str) -> DataFrame:
    return portable.record_issues(_stored_records(spark, root)).select("record_id", "code", "field_path")


@checked_by(_RECORDS + "select (select count(*) from raw) as n_records, count(*) + ((select count(*) from raw) > 10000)::int as n_issues, true as blocking, 0::bigint as imported from i")
def import_receipt(spark: SparkSession, root: str) -> DataFrame:
    r = _stored_records(spark, root)
    return portable.receipt(r, portable.record_issues(r))


@checked_by("select distinct 'EXISTING_ID_CONFLICT' as code, id as record_id from memory_notes union all select distinct 'EXISTING_ID_CONFLICT', id from diary_entries")
def import_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Every record clashes when a store's export is imported into that store."""
    issues = portable.record_issues(_stored_records(spark, root), records(spark, root, "memory_notes", "id"), records(spark, root, "diary_entries", "id"))
    return issues.where("code = 'EXISTING_ID_CONFLICT'").select("code", "record_id")


# --- validation --------------------------------------------------------------------------------------------------


@checked_by("""with n as (select distinct id, content, tags, source, status, importance, confidence, metadata, created_at, updated_at from memory_notes),
e as (select id, array_to_string(list_filter([case when content is null then 'content' end, case when tags is not null and list_contains(list_transform(tags, lambda t: t is null), true) then 'tags' end,
    case when source is not null and source not in ('user', 'conversation', 'diary', 'ai', 'imported', 'system') then 'source' end,
    case when status is not null and status not in ('candidate', 'active', 'archived', 'rejected') then 'status' end,
    case when importance is not null and (isnan(importance) or importance < 0 or importance > 1) then 'importance' end,
    case when confidence is not null and (isnan(confidence) or confidence < 0 or confidence > 1) then 'confidence' end,
    case when metadata is not null and not coalesce(json_valid(metadata) and json_type(metadata) = 'OBJECT', false) then 'metadata' end,
    case when created_at is null then 'createdAt' end, case when updated_at is null then 'updatedAt' end], lambda x: x is not null), ',') as fields from n)
select id, fields from e where fields <> ''""")
def invalid_notes(spark: SparkSession, root: str) -> DataFrame:
    raw = records(spark, root, "memory_notes", "id", "content", "tags", "source", "status", "importance", "confidence", "metadata", "created_at", "updated_at")
    return validate.invalid_notes(raw).select("id", F.array_join("fields", ",").alias("fields"))


@checked_by("""with e as (select distinct id, source, target, data from graph_edges), v as (select 'memory:' || id as id from memory_notes union select 'diary:' || id from diary_entries),
i as (select * from e union all select 'twin_' || id, source, target, '[1]' from e where target like 'diary:%' union all select 'lost_' || id, source, 'memory:nowhere', data from e where target like 'memory:%'),
x as (select id, source not in (select id from v) as a, target not in (select id from v) as b, count(*) over (partition by source, target) > 1 as p, not coalesce(json_type(data) = 'OBJECT', data is null) as d from i)
select id, array_to_string(list_filter([case when a then 'source' end, case when b then 'target' end, case when p then 'pair' end, case when d then 'data' end], lambda x: x is not null), ',') as fields from x where a or b or p or d""")
def invalid_edges(spark: SparkSession, root: str) -> DataFrame:
    """The stored edges, which are sound, among twins of those to the diary (pair in use, data no object) and copies of the others to no node."""
    nodes = table(spark, root, "memory_notes").select(F.concat(F.lit("memory:"), "id").alias("id")).union(table(spark, root, "diary_entries").select(F.concat(F.lit("diary:"), "id"))).distinct()
    e = views.edges(spark, root).select("id", "source", "target", "data")
    twins = e.where(F.col("target").startswith("diary:")).select(F.concat(F.lit("twin_"), "id").alias("id"), "source", "target", F.lit("[1]").alias("data"))
    lost = e.where(F.col("target").startswith("memory:")).select(F.concat(F.lit("lost_"), "id").alias("id"), "source", F.lit("memory:nowhere").alias("target"), "data")
    return validate.invalid_edges(e.unionByName(twins).unionByName(lost), nodes).select("id", F.array_join("fields", ",").alias("fields"))


_RELATIONS = ", ".join(f"'{r}'" for r in views.RELATIONS)


@checked_by(f"with {VIEWS_SQL} select id, case when relationship in ({_RELATIONS}) then relationship else 'related_to' end as relationship, case when relationship in ({_RELATIONS}) then null else relationship end as raw_relation from edges")
def edge_relations(spark: SparkSession, root: str) -> DataFrame:
    return validate.normal_relations(views.edges(spark, root)).select("id", "relationship", "raw_relation")


@checked_by(f"with {VIEWS_SQL} select id, nullif(status, 'active') as status, nullif(importance, 0.5) as importance, nullif(confidence, 0.75) as confidence, case when pinned then true end as pinned, case when len(tags) > 0 then array_to_string(tags, ',') end as tags from notes")
def stored_notes(spark: SparkSession, root: str) -> DataFrame:
    return validate.elided(views.notes(spark, root)).withColumn("tags", F.array_join("tags", ","))


@checked_by(f"with {VIEWS_SQL} select id, status, importance, confidence, pinned, array_to_string(tags, ',') as tags from notes")
def restored_notes(spark: SparkSession, root: str) -> DataFrame:
    return validate.hydrated(validate.elided(views.notes(spark, root))).withColumn("tags", F.array_join("tags", ","))


# --- mutations ---------------------------------------------------------------------------------------------------


@checked_by(r"""with n as (select distinct id, content, importance, confidence, pinned from memory_notes),
t as (select *, regexp_replace(content, '^[\s\x{a0}\x{2009}]+|[\s\x{a0}\x{2009}]+$', '', 'g') as body from n)
select id, body as content, coalesce(greatest(0::double, least(1::double, importance)), 0.5) as importance, coalesce(isnan(confidence), false) as confidence_is_nan,
    case when not coalesce(isnan(confidence), false) then coalesce(greatest(0::double, least(1::double, confidence)), 0.75) end as confidence, coalesce(pinned, false) as pinned from t where body <> ''""")
def added_notes(spark: SparkSession, root: str) -> DataFrame:
    raw = records(spark, root, "memory_notes", "id", "content", "tags", "category", "source", "importance", "confidence", "pinned", "status")
    nan = F.isnan("confidence")  # a NaN stays one; no two systems agree on whether it equals itself
    return mutations.new_notes(raw, F.lit(AS_OF)).select("id", "content", "importance", nan.alias("confidence_is_nan"), F.when(~nan, F.col("confidence")).alias("confidence"), "pinned")


@checked_by(f"""with {VIEWS_SQL}, p as (select id, length(content) % 2 = 0 as change from notes where status <> 'archived' union all select 'mem_absent', true)
select n.id, case when p.id is not null and not (pinned and change) then 'patched' when p.id is not null then 'CONFLICT' else 'same' end as outcome from notes n left join p using (id)
union all select id, 'NOT_FOUND' from p where id not in (select id from notes)""")
def patched_notes(spark: SparkSession, root: str) -> DataFrame:
    """Patches all notes but archived ones, about half of these in their content, which pinned notes refuse."""
    n = views.notes(spark, root)
    new = n.where("status != 'archived'").select("id", F.when(F.length("content") % 2 == 0, F.concat("content", F.lit(" (edited)"))).alias("content"), F.lit("edited").alias("category"))
    new = new.unionByName(spark.createDataFrame([("mem_absent", "x", "edited")], "id string, content string, category string"))
    out, refused = mutations.patched(n, new, F.lit(AS_OF).cast("timestamp_ntz"))
    seen = out.join(refused, "id", "left").select("id", F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("category") == "edited", "patched").otherwise("same").alias("outcome"))
    return seen.unionByName(refused.where("code = 'NOT_FOUND'").select("id", F.col("code").alias("outcome")))


@checked_by(f"with {VIEWS_SQL} select id, case when status = 'candidate' then 'active' else 'CONFLICT' end as outcome from notes")
def promoted_notes(spark: SparkSession, root: str) -> DataFrame:
    n = views.notes(spark, root)
    out, refused = mutations.promoted(n, n.select("id"))
    done = n.where("status = 'candidate'").select("id").join(out.select("id", F.col("status").alias("outcome")), "id")
    return done.unionByName(refused.select("id", F.col("code").alias("outcome")))


_EXPIRED = f"with {VIEWS_SQL}, x as (select 'memory:' || id as node, id from notes where expires_at <= timestamp '{AS_OF}' and not pinned)"


@checked_by(_EXPIRED + " select 'note' as kind, id from notes where id not in (select id from x) union all select 'node', id from nodes where id not in (select node from x) union all select 'edge', id from edges where source not in (select node from x) and target not in (select node from x)")
def purged_store(spark: SparkSession, root: str) -> DataFrame:
    """What is left when expired notes are purged with their nodes and edges."""
    n, v, e = views.notes(spark, root), views.nodes(spark, root), views.edges(spark, root)
    left = mutations.deleted(n, v, e, mutations.expired_ids(n, F.lit(AS_OF).cast("timestamp_ntz")))
    parts = [df.select(F.lit(k).alias("kind"), "id") for k, df in zip(("note", "node", "edge"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@checked_by(r"""with n as (select distinct id, provenance from memory_notes), w as (select 'memory:' || id as source, regexp_replace(regexp_replace(provenance.parentDiaryId, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '^diary:', '') as parent from n)
select distinct source, 'diary:' || parent as target, 'derived_from' as relationship from w where parent in (select id from diary_entries) and (source, 'diary:' || parent) not in (select (source, target) from graph_edges)""")
def foundation_links(spark: SparkSession, root: str) -> DataFrame:
    notes = records(spark, root, "memory_notes", "id", "provenance")
    return mutations.foundation_links(notes, records(spark, root, "diary_entries", "id"), views.edges(spark, root))


@checked_by(f"""with {VIEWS_SQL}, inc as (select 'new_' || id as id, target as source, source as target from edges union all select 'lost_' || id, source, 'memory:nowhere' from edges),
v as (select *, target = 'memory:nowhere' as lost, row_number() over (partition by source, target order by id) > 1 as again, (source, target) in (select (source, target) from edges) as taken from inc)
select id, case when lost then 'NOT_FOUND' when again or taken then 'CONFLICT' else 'added' end as outcome from v""")
def reversed_edges(spark: SparkSession, root: str) -> DataFrame:
    """Adds every edge in the other direction and one to a missing node: pairs in use and missing ends are refused."""
    e = views.edges(spark, root)
    back = e.select(F.concat(F.lit("new_"), "id").alias("id"), F.col("target").alias("source"), F.col("source").alias("target"), "relationship")
    lost = e.select(F.concat(F.lit("lost_"), "id").alias("id"), "source", F.lit("memory:nowhere").alias("target"), "relationship")
    every, refused = mutations.added_edges(e, views.nodes(spark, root), back.unionByName(lost))
    new = every.where(F.col("id").startswith("new_")).select("id", F.lit("added").alias("outcome"))
    return new.unionByName(refused.select("id", F.col("code").alias("outcome")))


@checked_by(f"""with {VIEWS_SQL}, b as (select id, content from notes where status <> 'archived'), a as (select id, case when pinned then content || '.' else content end as content from notes where status <> 'candidate')
select 'note' as kind, case when a.id is null then 'remove' else 'put' end as verb, coalesce(a.id, b.id) as id from b full join a on a.id = b.id where a.content is distinct from b.content""")
def diff_effects(spark: SparkSession, root: str) -> DataFrame:
    """The operations from the notes without archived ones to those without candidates, in which pinned ones are edited."""
    n = views.notes(spark, root).withColumn("body", F.col("content"))
    after = n.where("status != 'candidate'").withColumn("body", F.when(F.col("pinned"), F.concat("body", F.lit("."))).otherwise(F.col("body")))
    return history.effects(n.where("status != 'archived'"), after, "note").select("kind", "verb", "id")


# --- analysis cycle ----------------------------------------------------------------------------------------------

_ELIGIBLE = f"status = 'active' and created_at <= timestamp '{AS_OF}' and (expires_at is null or expires_at > timestamp '{AS_OF}')"


def _request(selector: dict) -> dream.Request:
    return dream.Request.normal(selector, AS_OF_MS)


@checked_by(f"with {VIEWS_SQL} select id from notes where {_ELIGIBLE}")
def dream_all_active(spark: SparkSession, root: str) -> DataFrame:
    return dream.selected(views.notes(spark, root), _request({"kind": "all_active"})).select("id")


@checked_by(f"with {VIEWS_SQL} select id from notes where {_ELIGIBLE} and list_contains(tags, 'inbox') and list_contains(tags, 'work')")
def dream_by_tags(spark: SparkSession, root: str) -> DataFrame:
    return dream.selected(views.notes(spark, root), _request({"kind": "tags", "tags": ["work", "inbox", "work"]})).select("id")


@checked_by(f"with {VIEWS_SQL} select id from notes where {_ELIGIBLE} and list_has_all({TOKENS_SQL.format('content')}, ['moved', 'the'])")
def dream_by_query(spark: SparkSession, root: str) -> DataFrame:
    return dream.selected(views.notes(spark, root), _request({"kind": "query", "query": "The  moved!"})).select("id")


@checked_by(f"with {VIEWS_SQL} select id from notes where {_ELIGIBLE} and created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-02-01'")
def dream_by_window(spark: SparkSession, root: str) -> DataFrame:
    low, high = (int(datetime(2024, m, 1, tzinfo=timezone.utc).timestamp() * 1000) for m in (1, 2))
    return dream.selected(views.notes(spark, root), _request({"kind": "date-window", "from": low, "to": high})).select("id")


@checked_by(f"""with {VIEWS_SQL}, s as (select * from notes where {_ELIGIBLE} order by id limit 128)
select id, content, array_to_string(list_sort(list_distinct(tags)), ',') as tags, epoch_ms(created_at) as created_at, epoch_ms(expires_at) as expires_at from s""")
def dream_dependencies(spark: SparkSession, root: str) -> DataFrame:
    """The bounded dependencies a plan captures: the first sources by id."""
    rows = dream.dependency_rows(dream.selected(views.notes(spark, root), _request({"kind": "all_active"})), dream.BUDGETS["maxSources"])
    return rows.select("id", "content", F.array_join("tags", ",").alias("tags"), "created_at", "expires_at")


@checked_by(f"""with {VIEWS_SQL}, s as (select 'memory:' || id as node from notes where {_ELIGIBLE})
select id, substr(source, 8) as source, substr(target, 8) as target, relationship from edges where source in (select node from s) and target in (select node from s)""")
def dream_relations(spark: SparkSession, root: str) -> DataFrame:
    ids = dream.selected(views.notes(spark, root), _request({"kind": "all_active"})).select("id")
    return dream.induced_relations(views.edges(spark, root), ids)


@checked_by(
    CONDENSE_SQL.replace("select id, key_facts, summary, tags", ", fin as (select id, key_facts, summary, tags", 1)
    + """), fresh as (select id, summary as content, key_facts from fin where summary not in (select content from notes))
select min(id) as id, content, key_facts from fresh group by content, key_facts"""
)
def dream_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Analyses worth proposing over all notes: new content, each (content, facts) once."""
    out = dream.novel_outputs(views.notes(spark, root).select("id", "content"))
    return out.select("id", "content", F.array_join("key_facts", "\n").alias("key_facts"))


def linked_plan(spark: SparkSession, root: str) -> tuple[dream.Plan, dict]:
    """Plan and result of one cycle over the most linked eligible notes.

    A cycle is bounded by its format: as many ids are asked for as a selector takes, and the plan cuts them to its sources.
    """
    notes, edges = views.notes(spark, root), views.edges(spark, root)
    linked = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ok = dream.selected(notes, _request({"kind": "all_active"})).select("id", F.concat(F.lit("memory:"), "id").alias("node"))
    ids = [r.id for r in ok.join(linked, "node").orderBy(F.col("n").desc(), "id").limit(dream.MAX_NAMES).collect()]
    plan = dream.preview(notes, edges, _request({"kind": "ids", "ids": ids}))
    return plan, dream.run(notes, edges, plan)


@checked_by(None)
def dream_cycle(spark: SparkSession, root: str) -> DataFrame:
    """Plan and result of one cycle as one row of JSON; ``dream_plan`` and ``dream_proposals`` check its parts."""
    plan, result = linked_plan(spark, root)
    return spark.createDataFrame([(plan.plan_id, dream.as_json(plan.fields), dream.as_json(result))], "plan_id string, plan string, result string")


# --- transaction log ---------------------------------------------------------------------------------------------


def _wal(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "wal_transactions")


@checked_by("select store_id, tx_id::varchar as tx_id, count(*) as n_copies from wal_transactions group by store_id, tx_id having count(*) > 1")
def repeated_frames(spark: SparkSession, root: str) -> DataFrame:
    return history.repeated_frames(_wal(spark, root)).withColumn("tx_id", F.col("tx_id").cast("string"))


@checked_by("""with f as (select distinct store_id, epoch_id, tx_id, mutation_id, base.tx as btx, base.epoch as bep, ops[1].type as head from wal_transactions),
own as (select * from f qualify mutation_id is null or tx_id = min(tx_id) over (partition by store_id, mutation_id)),
t as (select store_id, epoch_id, tx_id, case when head like 'ether.graph-edge.%' then btx - 1 else btx end as btx, case when head like 'ether.diary.%' then 'another' else bep end as bep from own),
p as (select *, lag(tx_id) over w as prev_tx, lag(epoch_id) over w as prev_epoch from t window w as (partition by store_id order by tx_id)),
r as (select *, case when tx_id <> prev_tx + 1 then 'gap' when btx is distinct from prev_tx then 'base' when bep is distinct from prev_epoch then 'epoch' end as reason from p where prev_tx is not null)
select store_id, tx_id::varchar as tx_id, prev_tx::varchar as prev_tx, reason from r where reason is not null""")
def chain_breaks(spark: SparkSession, root: str) -> DataFrame:
    """Breaks of a log with faults: transactions without effect are lost, those that begin with an edge or an entry have another base."""
    w, kind = _wal(spark, root), F.get("ops", F.lit(0))["type"]
    owner = w.where("mutation_id is not null").groupBy("store_id", "mutation_id").agg(F.min("tx_id").alias("owner_tx"), F.max("tx_id").alias("last_tx")).where("owner_tx < last_tx")
    kept = w.join(owner, ["store_id", "mutation_id"], "left").where("owner_tx is null or tx_id = owner_tx")
    tx = F.when(kind.startswith("ether.graph-edge."), F.col("base.tx") - 1).otherwise(F.col("base.tx")).cast("decimal(38,0)")
    epoch = F.when(kind.startswith("ether.diary."), "another").otherwise(F.col("base.epoch"))
    b = history.chain_breaks(kept.withColumn("base", F.struct(epoch.alias("epoch"), tx.alias("tx"), F.col("base.digest").alias("digest"))))
    return b.withColumns({c: F.col(c).cast("string") for c in ("tx_id", "prev_tx")})


@checked_by("""select store_id, min(tx_id)::varchar as first_tx, max(tx_id)::varchar as last_tx, (max(tx_id) + 1)::decimal(38,0)::varchar as next_tx, count(distinct tx_id) as n_transactions,
(max(tx_id) - min(tx_id) + 1 - count(distinct tx_id))::bigint as n_missing from wal_transactions group by 1""")
def store_tips(spark: SparkSession, root: str) -> DataFrame:
    return history.store_tips(_wal(spark, root))


@checked_by("""select store_id, mutation_id, count(distinct tx_id) as n_transactions, min(tx_id)::varchar as owner_tx, min(intent_digest) <> max(intent_digest) as conflict
from wal_transactions group by 1, 2 having count(distinct tx_id) > 1""")
def contested_mutations(spark: SparkSession, root: str) -> DataFrame:
    return history.contested_mutations(_wal(spark, root))


@checked_by("""select store_id, mutation_id, tx_id::varchar as tx_id, intent_digest, array_to_string(list_transform(ops, lambda o: o.type), ',') as op_types from wal_transactions
qualify row_number() over (partition by store_id, mutation_id order by tx_id) = 1""")
def mutation_receipts(spark: SparkSession, root: str) -> DataFrame:
    r = history.receipts(_wal(spark, root))
    return r.select("store_id", "mutation_id", F.col("tx_id").cast("string").alias("tx_id"), "intent_digest", F.array_join("op_types", ",").alias("op_types"))


@checked_by("""with o as (select store_id, mutation_id, tx_id, intent_digest from wal_transactions qualify row_number() over (partition by store_id, mutation_id order by tx_id) = 1),
a as (select distinct store_id, mutation_id, intent_digest from wal_transactions union all select distinct store_id, 'mut_unknown', 'x' from wal_transactions)
select a.store_id, a.mutation_id, case when o.intent_digest is null then 'absent' when o.intent_digest = a.intent_digest then 'known' else 'conflict' end as outcome, o.tx_id::varchar as owner_tx
from a left join o on o.store_id = a.store_id and o.mutation_id = a.mutation_id""")
def mutation_lookups(spark: SparkSession, root: str) -> DataFrame:
    """Every intent of the log, and one unknown mutation per store, looked up in the ledger."""
    w = _wal(spark, root)
    asked = w.select("store_id", "mutation_id", "intent_digest").distinct().unionByName(w.select("store_id", F.lit("mut_unknown").alias("mutation_id"), F.lit("x").alias("intent_digest")).distinct())
    return history.lookup(history.receipts(w), asked).withColumn("owner_tx", F.col("owner_tx").cast("string"))


@checked_by("""with t as (select distinct store_id, tx_id, ops from wal_transactions), s as (select store_id, tx_id, list_transform(ops, lambda o: strlen(o.payload)) as z from t)
select store_id, tx_id::varchar as tx_id, list_sum(z)::bigint as payload_bytes, case when list_max(z) > 65536 or list_sum(z) > 524288 then 'reference' else 'inline' end as transport from s""")
def op_transport(spark: SparkSession, root: str) -> DataFrame:
    return history.op_transport(_wal(spark, root))


@checked_by("""with t as (select distinct store_id, tx_id, ops from wal_transactions), s as (select store_id, list_sum(list_transform(ops, lambda o: strlen(o.payload)))::bigint as z from t)
select store_id, sum(z)::bigint as active_bytes, sum(z) + 1048576 > 4194304 as rotate from s group by 1""")
def rotation_due(spark: SparkSession, root: str) -> DataFrame:
    return history.rotation_due(_wal(spark, root), 4 << 20)


@checked_by("""with t as (select distinct store_id, tx_id, ops from wal_transactions), p as (select unnest(list_transform(ops, lambda o: o.payload)) as payload from t)
select sha256(payload) as digest, count(*) as n_uses from p group by payload""")
def payload_objects(spark: SparkSession, root: str) -> DataFrame:
    return history.payload_objects(_wal(spark, root)).select("digest", "n_uses")


@checked_by("""with o as (select distinct unnest(ops) as op from wal_transactions), p as (select op.type as type, sha256(op.payload) as digest from o),
i as (select distinct digest from p where type like '%.put'), m as (select distinct digest from p where type like 'ether.note.%' or type like 'ether.diary.%')
select digest, 'reclaim' as state from i where digest not in (select digest from m) union all select digest, 'missing' from m where digest not in (select digest from i)""")
def object_sweep(spark: SparkSession, root: str) -> DataFrame:
    """The objects of all puts as inventory against marks from all operations on notes and diary."""
    w = _wal(spark, root)
    inventory = history.payload_objects(w.withColumn("ops", F.filter("ops", lambda o: o["type"].endswith(".put"))))
    marks = history.payload_objects(w.withColumn("ops", F.filter("ops", lambda o: o["type"].rlike(r"^ether\.(note|diary)\."))))
    free, lost = history.reclaimable(inventory, marks)
    return free.withColumn("state", F.lit("reclaim")).unionByName(lost.withColumn("state", F.lit("missing")))


@checked_by("""with t as (select distinct store_id, tx_id, mutation_id, ops from wal_transactions),
own as (select * from t qualify mutation_id is null or tx_id = min(tx_id) over (partition by store_id, mutation_id)),
e as (select store_id, tx_id, unnest(ops) as op, generate_subscripts(ops, 1) as ord from own),
o as (select store_id, tx_id, ord, split_part(op.type, '.', 2) as obj_kind, split_part(op.type, '.', 3) = 'put' as is_put, json_extract_string(op.payload, '$.id') as obj_id,
    json_extract_string(op.payload, '$.source') as source, json_extract_string(op.payload, '$.target') as target from e),
m as (select *, coalesce(lag(is_put) over w, false) as was_put, lag(source) over w as s, lag(target) over w as t, lag(tx_id) over w as put_tx, lag(ord) over w as put_ord
    from o window w as (partition by store_id, obj_kind, obj_id order by tx_id, ord)),
g as (select store_id, obj_id as node, tx_id, ord from m where obj_kind = 'graph-node' and not is_put and was_put),
ed as (select store_id, obj_kind, obj_id, tx_id, ord, put_tx, put_ord, unnest([s, t]) as node from m where obj_kind = 'graph-edge' and not is_put and was_put),
c as (select distinct ed.store_id, ed.obj_kind, ed.obj_id, ed.tx_id, ed.ord from ed join g on g.store_id = ed.store_id and g.node = ed.node
    where (g.tx_id > put_tx or g.tx_id = put_tx and g.ord > put_ord) and (g.tx_id < ed.tx_id or g.tx_id = ed.tx_id and g.ord < ed.ord))
select store_id, obj_kind, obj_id, tx_id::varchar as tx_id from m where not is_put and not was_put union all select store_id, obj_kind, obj_id, tx_id::varchar from c""")
def absent_removes(spark: SparkSession, root: str) -> DataFrame:
    """Removes of objects of every kind that were not there, edges gone with a node included; they have no effect."""
    w = _wal(spark, root)
    ops = materialize(change_log.without_replays(change_log.explode_ops(w.dropDuplicates(["store_id", "tx_id"])), change_log.commits_of(w)), "operations")
    return change_log.absent_removes(ops).withColumn("tx_id", F.col("tx_id").cast("string"))
