"""Queries of explicit ids, edge evidence, node and diary mutations, ledgers and plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import query_tokens
from recollect.operators import graph, history, mutations, retrieval
from recollect.operators.context import Context
from recollect.plans.log_queries import linked_plan
from recollect.plans.registry import Registry
from recollect.plans.store_queries import AS_OF, CONDENSE_SQL, MATCH, TEXT, diary_index_of, match_sql, note_index_of, text_list
from recollect.sources import views
from recollect.sources.tables import records, table
from recollect.sources.views import TOKENS_SQL, VIEWS_SQL

_registry = Registry()
checked_by, QUERIES, ORACLE_SQL = _registry.checked_by, _registry.queries, _registry.oracle_sql


def _latest(df: DataFrame, n: int) -> tuple[str, ...]:
    """The ``n`` ids updated last."""
    once = df.select("id", "updated_at").distinct()
    return tuple(r.id for r in once.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(n).collect())


_PASS = f"status not in ('candidate', 'archived') and (expires_at is null or expires_at > timestamp '{AS_OF}')"
_EXPLICIT = match_sql(TEXT, "default") + f""", ask as (select id, row_number() over (order by updated_at desc nulls last, id) as place from notes), ex as (select n.*, place from notes n join ask using (id) where place <= 9 and {_PASS})"""


@checked_by(_EXPLICIT + """, u as (select id, 'explicit_id' as match_class, 1 as cr, 0::double + importance * 0.05::double + confidence * 0.025::double as score, updated_at from ex
    union all select id, match_class, cr, score, updated_at from scored where id not in (select id from ask where place <= 9)),
r as (select *, row_number() over (order by cr, score desc, updated_at desc nulls last, id) as rank from u) select rank, id, match_class, score from r where rank <= 50""")
def query_explicit(spark: SparkSession, root: str) -> DataFrame:
    """Retrieval with the nine notes updated last asked for by id, beside a text and an unknown id."""
    ids = (*_latest(views.notes(spark, root, once=False), 9), "mem_absent")
    return retrieval.query_notes(note_index_of(spark, root), retrieval.Query(TEXT, AS_OF, explicit_ids=ids)).select(*MATCH)


@checked_by(_EXPLICIT + f""", ranked as (select *, row_number() over (order by cr, score desc, updated_at desc nulls last, id) as rank from scored),
cand as (select id, place from ex union all select id, 10 + rank from ranked where rank <= 50 and id not in (select id from ex)), nn as (select id, row_number() over (order by place) as ord from cand),
dask as (select id, row_number() over (order by updated_at desc nulls last, id) as place from diary),
dd as (select *, {TOKENS_SQL.format("content || ' ' || array_to_string(tags, ' ')")} as toks from diary),
dr as (select id, row_number() over (order by updated_at desc nulls last, id) as rank from dd where list_has_any(toks, {text_list(query_tokens(TEXT))})),
dc as (select id, place from dask where place <= 2 union all select id, 2 + rank from dr where rank <= 20 and id not in (select id from dask where place <= 2)), dn as (select id, row_number() over (order by place) as ord from dc),
k as (select count(*) as n from nn where ord <= 12)
select 'note' as kind, id, ord from nn where ord <= 12 union all select 'diary', id, n + ord from dn, k where ord <= 4""")
def context_explicit(spark: SparkSession, root: str) -> DataFrame:
    """A context of notes and entries asked for by id, in the order asked, then of what the text finds."""
    ids = (*_latest(views.notes(spark, root, once=False), 9), "mem_absent")
    q = retrieval.Query(TEXT, AS_OF, explicit_ids=ids)
    c = Context(note_index_of(spark, root), diary_index_of(spark, root), views.nodes(spark, root), views.edges(spark, root), q, diary_ids=_latest(views.diary(spark, root, once=False), 2))
    return c.chosen.select("kind", "id", F.col("ord").cast("bigint").alias("ord"))


@checked_by(f"""with {VIEWS_SQL}, side as (select id, source as node from edges union select id, target from edges), r as (select *, row_number() over (partition by node order by id) as nth, count(*) over (partition by node) as n from side)
select node, max(n) as known, string_agg(id, ',' order by nth) filter (where nth <= 8) as shown from r group by node""")
def edge_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Per node the number of its edges and the first eight by id."""
    e = graph.edge_evidence(views.edges(spark, root), views.nodes(spark, root).select(F.col("id").alias("node")))
    return e.select("node", "known", F.array_join("shown", ",").alias("shown"))


@checked_by(f"""with {VIEWS_SQL}, d as (select 'diary:' || id as id from diary), every as (select id from nodes union select id from d)
select 'add' as mode, id, coalesce(type, 'entry') as type from every left join nodes using (id)
union all select 'ensure', id, case when id in (select id from d) then 'journal' else type end from every left join nodes using (id)""")
def upserted_nodes(spark: SparkSession, root: str) -> DataFrame:
    """All entries written as nodes twice: adding keeps the first, ensuring overwrites."""
    d = views.diary(spark, root).select(F.concat(F.lit("diary:"), "id").alias("id"))
    incoming = d.withColumns({"type": F.lit("entry"), "ord": F.lit(0)}).unionByName(d.withColumns({"type": F.lit("journal"), "ord": F.lit(1)}))
    have, out = views.nodes(spark, root), None
    for mode, overwrite in (("add", False), ("ensure", True)):
        one = mutations.upserted_nodes(have, incoming, overwrite).select(F.lit(mode).alias("mode"), "id", "type")
        out = one if out is None else out.unionByName(one)
    return out


_BLANK = r"regexp_replace({0}, '^[\s\x{{a0}}\x{{2009}}]+|[\s\x{{a0}}\x{{2009}}]+$', '', 'g')"


@checked_by(f"""with d as (select distinct id, content, tags from diary_entries), t as (select *, {_BLANK.format('content')} as body from d)
select id, body as content, len(coalesce(tags, [])) as n_tags from t where body <> ''""")
def added_entries(spark: SparkSession, root: str) -> DataFrame:
    """All entries as new ones: trimmed content, blank ones refused."""
    d = records(spark, root, "diary_entries", "id", "content", "tags", "metadata")
    return mutations.new_entries(d, F.lit(AS_OF)).select("id", "content", F.size("tags").cast("bigint").alias("n_tags"))


@checked_by(f"""with {VIEWS_SQL} select id, case when len(tags) = 0 then 'INVALID_INPUT' else 'patched' end as outcome, case when len(tags) = 0 then content else {_BLANK.format("content || ' more '")} end as content from diary
union all select 'diary_absent', 'NOT_FOUND', null""")
def patched_entries(spark: SparkSession, root: str) -> DataFrame:
    """Patches the content of all entries, of those without tags to a blank one, which is refused."""
    d = views.diary(spark, root)
    new = d.select("id", F.when(F.size("tags") == 0, "  ").otherwise(F.concat("content", F.lit(" more "))).alias("content"))
    new = new.unionByName(spark.createDataFrame([("diary_absent", "x")], "id string, content string"))
    out, refused = mutations.patched(d, new, F.lit(AS_OF).cast("timestamp_ntz"))
    seen = out.join(refused, "id", "left").select("id", F.coalesce("code", F.lit("patched")).alias("outcome"), "content")
    return seen.unionByName(refused.where("code = 'NOT_FOUND'").select("id", F.col("code").alias("outcome"), F.lit(None).cast("string").alias("content")))


@checked_by(f"""with {VIEWS_SQL}, x as (select 'diary:' || id as node, id from diary where created_at < timestamp '{AS_OF}')
select 'diary' as kind, id from diary where id not in (select id from x) union all select 'node', id from nodes where id not in (select node from x)
union all select 'edge', id from edges where source not in (select node from x) and target not in (select node from x)""")
def removed_entries(spark: SparkSession, root: str) -> DataFrame:
    """What is left when the entries of the past are deleted with their nodes and edges."""
    d = views.diary(spark, root)
    left = mutations.deleted(d, views.nodes(spark, root), views.edges(spark, root), d.where(F.col("created_at") < F.lit(AS_OF).cast("timestamp_ntz")).select("id"), "diary")
    parts = [df.select(F.lit(k).alias("kind"), "id") for k, df in zip(("diary", "node", "edge"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@checked_by("""with m as (select epoch_us(min(received_at)) + (epoch_us(max(received_at)) - epoch_us(min(received_at))) // 2 as middle from wal_transactions),
h as (select store_id, mutation_id, min(tx_id) as tx, epoch_us(received_at) > (select middle from m) as is_late from wal_transactions where mutation_id is not null group by store_id, mutation_id, is_late)
select store_id, mutation_id, count(*) > 1 as corrupt, min(tx)::varchar as tx_id from h group by store_id, mutation_id""")
def merged_ledgers(spark: SparkSession, root: str) -> DataFrame:
    """The ledgers of both halves of the log by time of receipt, merged; identities in both are corruption."""
    w = table(spark, root, "wal_transactions")
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    low, high = w.agg(F.min(at), F.max(at)).first()
    middle = (low or 0) + ((high or 0) - (low or 0)) // 2
    merged = history.merge_ledgers(history.receipts(w.where(at <= middle)), history.receipts(w.where(at > middle)))
    return merged.select("store_id", "mutation_id", "corrupt", F.col("tx_id").cast("string").alias("tx_id"))


_ELIGIBLE = f"status = 'active' and created_at <= timestamp '{AS_OF}' and (expires_at is null or expires_at > timestamp '{AS_OF}')"
_PLAN = CONDENSE_SQL.replace("select id, key_facts, summary, tags", ", fin as (select id, key_facts, summary, tags", 1) + f"""), linked as (select node, count(*) as n from (select unnest([source, target]) as node from edges) group by 1),
asked as (select id from notes join linked on node = 'memory:' || id where {_ELIGIBLE} order by n desc, id limit 256), src as (select id from asked order by id limit 128),
rel as (select id, substr(source, 8) as source, substr(target, 8) as target from edges where substr(source, 8) in (select id from src) and substr(target, 8) in (select id from src) and source like 'memory:%' and target like 'memory:%'),
fresh as (select id, summary, key_facts from fin where id in (select id from src) and summary not in (select content from notes where id in (select id from src))),
made as (select min(id) as id, summary as content, key_facts from fresh group by summary, key_facts), shown as (select *, row_number() over (order by id) as nth from made)
"""


@checked_by(_PLAN + "select (select count(*) from asked) as known, (select count(*) from src) as selected, (select count(*) from asked) > (select count(*) from src) as truncated, (select count(*) from rel) as relations, (select count(*) from made) as proposals, (select count(*) from shown where nth <= 32) as shown")
def dream_plan(spark: SparkSession, root: str) -> DataFrame:
    """Counts of the plan and the result of one cycle over the most linked eligible notes."""
    plan, result = linked_plan(spark, root)
    f = plan.fields
    row = (f["knownCount"], f["selectedCount"], f["selectionTruncated"], f["graph"]["relationshipCount"], result["knownProposalCount"], result["proposalCount"])
    return spark.createDataFrame([row], "known bigint, selected bigint, truncated boolean, relations bigint, proposals bigint, shown bigint")


@checked_by(_PLAN + """, inc as (select p.id, rel.id as edge, row_number() over (partition by p.id order by rel.id) as nth from shown p join rel on p.id in (rel.source, rel.target))
select id, content, key_facts, (select count(*) from inc where inc.id = shown.id) as relations_known, coalesce((select string_agg(edge, ',' order by nth) from inc where inc.id = shown.id and nth <= 8), '') as relations from shown where nth <= 32""")
def dream_proposals(spark: SparkSession, root: str) -> DataFrame:
    """The proposals of that cycle with their evidence."""
    _, result = linked_plan(spark, root)
    rows = [(p["sourceIds"][0], p["content"], "\n".join(p["evidence"]["keyFacts"]), p["evidence"]["relationshipKnownCount"], ",".join(r["id"] for r in p["evidence"]["relationships"])) for p in result["proposals"]]
    return spark.createDataFrame(rows, "id string, content string, key_facts string, relations_known bigint, relations string")

