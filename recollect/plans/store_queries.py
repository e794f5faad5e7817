"""Queries of the store's own operators over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import phrase, query_tokens, tokens
from recollect.operators import graph, retrieval
from recollect.operators.condense import CATEGORY_RULES, condensed
from recollect.operators.context import Context
from recollect.operators.inspect import explained, health_findings, health_report, note_health
from recollect.operators.note_index import NoteIndex
from recollect.plans.registry import Registry
from recollect.session import scratch_path
from recollect.sources import views
from recollect.sources.views import TOKENS_SQL, VIEWS_SQL

AS_OF = datetime(2024, 6, 1)
TEXT = "moved to the archive"
WIDE = retrieval.Filters(include_candidate=True, include_archived=True, include_expired=True)
NARROW = retrieval.Filters(pinned_only=True, categories=("project", "task"))
MATCH = ["rank", "id", "match_class", "score"]

_registry = Registry()
checked_by, QUERIES, ORACLE_SQL = _registry.checked_by, _registry.queries, _registry.oracle_sql


def note_index_of(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.note_index(views.notes(spark, root, once=False))


def diary_index_of(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.diary_index(views.diary(spark, root, once=False))


def text_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_META = "array_to_string(list_transform(json_keys(metadata), lambda k: k || ' ' || coalesce(json_extract_string(metadata, '$.' || k), 'null')), ' ')"
INDEX_SQL = f"""with {VIEWS_SQL},
idx as (select *, {TOKENS_SQL.format("content || ' ' || coalesce(summary, '')")} as toks,
    list_distinct({TOKENS_SQL.format("array_to_string(tags, ' ') || ' ' || coalesce(category, '')")}) as tt,
    list_distinct(coalesce({TOKENS_SQL.format(_META)}, [])) as mt from notes)
"""
_PASS = {
    "default": f"status not in ('candidate', 'archived') and (expires_at is null or expires_at > timestamp '{AS_OF}')",
    "wide": "true",
    "narrow": f"status not in ('candidate', 'archived') and (expires_at is null or expires_at > timestamp '{AS_OF}') and pinned and coalesce(category in ('project', 'task'), false)",
}


def match_sql(text: str, passes: str) -> str:
    """All direct matches of ``text`` as ``scored``."""
    q = query_tokens(text)
    return (
        INDEX_SQL
        + f""", m as (select *, list_filter({text_list(q)}, lambda t: list_contains(toks, t)) as mtoks, list_filter({text_list(q)}, lambda t: list_contains(tt, t)) as mtags,
    list_filter({text_list(q)}, lambda t: list_contains(mt, t)) as mmeta, contains(' ' || array_to_string(toks, ' ') || ' ', ' {" ".join(q)} ') as ex from idx where {_PASS[passes]}),
c as (select *, case when ex then 'exact_phrase' when len(mtoks) = {len(q)} then 'full_token_match' when len(mtoks) > 0 then 'partial_token_match' when len(mtags) + len(mmeta) > 0 then 'tag_metadata_match' end as match_class from m),
l as (select *, case match_class when 'exact_phrase' then 0.9::double + len(mtoks) * 0.02::double when 'full_token_match' then 0.7::double + len(mtoks) * 0.02::double
    when 'partial_token_match' then 0.5::double + len(mtoks) * 0.02::double else 0.3::double + (len(mtags) + len(mmeta)) * 0.02::double end as lexical,
    case match_class when 'exact_phrase' then 2 when 'full_token_match' then 3 when 'partial_token_match' then 4 else 5 end as cr from c where match_class is not null),
scored as (select *, lexical + importance * 0.05::double + confidence * 0.025::double as score from l)
"""
    )


_RANK = "row_number() over (order by cr, score desc, updated_at desc nulls last, id)"


def top_sql(text: str, passes: str, limit: int = 50) -> str:
    return match_sql(text, passes) + f", ranked as (select *, {_RANK} as rank from scored) "


@checked_by(f"with {VIEWS_SQL} select id, array_to_string({TOKENS_SQL.format('content')}, ' ') as phrase, len({TOKENS_SQL.format('content')}) as n_tokens from notes")
def note_phrases(spark: SparkSession, root: str) -> DataFrame:
    t = views.notes(spark, root).select("id", tokens(F.col("content")).alias("t"))
    return t.select("id", phrase(F.col("t")).alias("phrase"), F.size("t").cast("bigint").alias("n_tokens"))


@checked_by(top_sql(TEXT, "default") + "select rank, id, match_class, score from ranked where rank <= 50")
def query_memories(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.query_notes(note_index_of(spark, root), retrieval.Query(TEXT, AS_OF)).select(*MATCH)


@checked_by(top_sql("project", "wide") + "select rank, id, match_class, score from ranked where rank <= 50")
def query_all_states(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.query_notes(note_index_of(spark, root), retrieval.Query("project", AS_OF, WIDE)).select(*MATCH)


@checked_by(top_sql(TEXT, "narrow") + "select rank, id, match_class, score from ranked where rank <= 20")
def query_filtered(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.query_notes(note_index_of(spark, root), retrieval.Query(TEXT, AS_OF, NARROW, 20)).select(*MATCH)


def _texts_sql(texts: tuple[str, ...]) -> str:
    return " union all ".join(f"(select '{t}' as text, rank, id, match_class, score from ({top_sql(t, 'default')} select * from ranked where rank <= 50))" for t in texts)


TEXTS = ("archive choir", "moved to the archive", "nosuchwordanywhere")


@checked_by(_texts_sql(TEXTS))
def query_indexed(spark: SparkSession, root: str) -> DataFrame:
    """Queries of rare, common and unknown words over an index built from all notes and opened again."""
    path = scratch_path(spark, "note-index")
    NoteIndex.build(views.notes(spark, root, once=False), path)
    index, out = NoteIndex.open(spark, path), None
    for t in TEXTS:
        one = index.query(retrieval.Query(t, AS_OF)).select(F.lit(t).alias("text"), *MATCH)
        out = one if out is None else out.unionByName(one)
    return out


@checked_by(match_sql("the archive choir", "default") + "select match_class, count(*) as n, sum(len(mtoks))::bigint as n_hits, max(score) as best from scored group by 1")
def match_classes(spark: SparkSession, root: str) -> DataFrame:
    found = retrieval.direct_matches(note_index_of(spark, root), retrieval.Query("the archive choir", AS_OF))
    return found.groupBy("match_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("matched_tokens")).alias("n_hits"), F.max("score").alias("best"))


@checked_by(
    match_sql("archive choir archive", "wide")
    + """select id, match_class, score, array_to_string(mtoks, ' ') as matched_tokens, array_to_string(mtags, ' ') as tags, array_to_string(mmeta, ' ') as metadata_fields,
case when match_class = 'exact_phrase' then 'archive choir archive' end as exact_phrase, lexical as by_text, importance * 0.05::double as by_importance, confidence * 0.025::double as by_confidence from scored"""
)
def match_evidence(spark: SparkSession, root: str) -> DataFrame:
    text = "archive choir archive"
    e = retrieval.evidence(retrieval.direct_matches(note_index_of(spark, root), retrieval.Query(text, AS_OF, WIDE)), text).select("id", "evidence.*")
    return e.select("id", "match_class", "score", *[F.array_join(c, " ").alias(c) for c in ("matched_tokens", "tags", "metadata_fields")], "exact_phrase", "by_text", "by_importance", "by_confidence")


_DIARY = f"""with {VIEWS_SQL}, d as (select *, {TOKENS_SQL.format("content || ' ' || array_to_string(tags, ' ')")} as toks from diary),
h as (select id, updated_at, contains(' ' || array_to_string(toks, ' ') || ' ', ' {TEXT} ') as ex from d where list_has_any(toks, {text_list(query_tokens(TEXT))})),
r as (select *, row_number() over (order by updated_at desc nulls last, id) as rank from h)
"""


@checked_by(_DIARY + "select rank, id, case when ex then 'exact_phrase token' else 'token' end as matched_by from r where rank <= 20")
def diary_search(spark: SparkSession, root: str) -> DataFrame:
    found = retrieval.search_diary(diary_index_of(spark, root), TEXT)
    return found.select("rank", "id", F.array_join("matched_by", " ").alias("matched_by"))


@checked_by(f"with {VIEWS_SQL} select id, created_at, updated_at from diary")
def diary_entries(spark: SparkSession, root: str) -> DataFrame:
    return views.diary(spark, root).select("id", "created_at", "updated_at")


@checked_by(f"with {VIEWS_SQL} select type, count(*) as n from nodes group by 1")
def nodes_by_type(spark: SparkSession, root: str) -> DataFrame:
    return views.nodes(spark, root).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@checked_by(f"with {VIEWS_SQL} select id as node, count(*) as degree from (select unnest(list_distinct([source, target])) as id from edges) group by 1")
def node_degrees(spark: SparkSession, root: str) -> DataFrame:
    return graph.degrees(views.edges(spark, root))


def _pinned_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of all pinned notes."""
    nodes = views.nodes(spark, root).select(F.col("id").alias("seed"))
    return nodes.join(views.notes(spark, root).where("pinned").select(F.concat(F.lit("memory:"), "id").alias("seed")), "seed", "left_semi")


_SEEDS = f"with {VIEWS_SQL}, seeds as (select 'memory:' || id as seed from notes where pinned and 'memory:' || id in (select id from nodes)),"
_ADJ = """adj as (select source as node, target as other, id as edge from edges union all select target, source, id from edges),
l1 as (select distinct seed, other as node from seeds join adj on node = seed where other <> seed),
l2 as (select distinct l1.seed, other as node from l1 join adj on adj.node = l1.node where other <> l1.seed and not exists (select 1 from l1 z where z.seed = l1.seed and z.node = other))
"""


@checked_by(_SEEDS + _ADJ + "select seed, node, 1 as level from l1 union all select seed, node, 2 from l2")
def neighbourhood_nodes(spark: SparkSession, root: str) -> DataFrame:
    return graph.neighbourhood(views.edges(spark, root), _pinned_seeds(spark, root), 2)[0]


@checked_by(_SEEDS + _ADJ + "select distinct seed, edge as edge_id from seeds join adj on node = seed union select l1.seed, edge from l1 join adj on adj.node = l1.node")
def neighbourhood_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.neighbourhood(views.edges(spark, root), _pinned_seeds(spark, root), 2)[1]


@checked_by(_SEEDS + "o as (select distinct seed, source as node from seeds join edges on target = seed where source <> seed and relationship in ('supports', 'about')) select seed, node from o")
def neighbourhood_incoming(spark: SparkSession, root: str) -> DataFrame:
    return graph.neighbourhood(views.edges(spark, root), _pinned_seeds(spark, root), 1, "in", ("supports", "about"))[0].select("seed", "node")


_RECALL = """adj as (select source as node, target as other, id as edge from edges where source <> target union all select target, source, id from edges where source <> target),
first as (select seed, other as node, min(edge) as e1 from seeds join adj on node = seed group by 1, 2),
one as (select * from (select *, row_number() over (partition by seed order by e1, node) as found, count(*) over (partition by seed) as n from first) where found <= {cap}),
st as (select k.seed, k.e1, a.other, a.edge, k.n, row_number() over (partition by k.seed order by k.node, a.edge) as seq from one k join adj a on a.node = k.node
    where k.n < {cap} and a.other <> k.seed and not exists (select 1 from one z where z.seed = k.seed and z.node = a.other)),
fo as (select seed, other, min(seq) as first_seq, max(n) as n from st group by 1, 2),
kp as (select * from (select *, row_number() over (partition by seed order by first_seq) as pl from fo) where pl <= {cap} - n),
ct as (select seed, case when count(*) = {cap} - max(n) then max(first_seq) end as cut from kp group by 1),
two as (select st.seed, st.other as node, min(st.e1 || ' ' || st.edge) as path, max(kp.n + kp.pl) as found from st join kp on kp.seed = st.seed and kp.other = st.other join ct on ct.seed = st.seed where cut is null or seq <= cut group by 1, 2)
"""


@checked_by(_SEEDS + _RECALL.format(cap=8) + "select seed, node, e1 as path, found from one")
def recall_one_hop(spark: SparkSession, root: str) -> DataFrame:
    return graph.recall_nodes(views.edges(spark, root), _pinned_seeds(spark, root), graph.Recall()).select("seed", "node", F.array_join("path", " ").alias("path"), "found")


@checked_by(_SEEDS + _RECALL.format(cap=5) + "select seed, node, e1 as path, found from one union all select seed, node, path, found from two")
def recall_two_hops(spark: SparkSession, root: str) -> DataFrame:
    return graph.recall_nodes(views.edges(spark, root), _pinned_seeds(spark, root), graph.Recall(2, 5)).select("seed", "node", F.array_join("path", " ").alias("path"), "found")


@checked_by(
    _SEEDS
    + _RECALL.format(cap=8)
    + """select o.seed, o.node, e.id as edge_id, case when e.source = o.seed then 'out' else 'in' end as way, e.relationship from one o join edges e on e.id = o.e1"""
)
def recall_steps(spark: SparkSession, root: str) -> DataFrame:
    e = views.edges(spark, root)
    steps = graph.path_steps(graph.recall_nodes(e, _pinned_seeds(spark, root), graph.Recall()), e)
    return steps.select("seed", "node", F.explode("steps").alias("s")).select("seed", "node", "s.edge_id", "s.way", "s.relationship")


@checked_by(
    top_sql("archive choir", "default")
    + ", best as (select 'memory:' || id as seed, id as seed_id, score as seed_score from ranked where rank <= 20), seeds as (select seed from best),"
    + _RECALL.format(cap=8)
    + f""", g as (select i.id, i.updated_at, b.seed_id, b.seed_score * 0.5::double + i.importance * 0.05::double + i.confidence * 0.025::double as score
    from one o join idx i on o.node = 'memory:' || i.id join best b on b.seed = o.seed where {_PASS['default']} and i.id not in (select id from scored)),
g1 as (select * from g qualify row_number() over (partition by id order by score desc, seed_id) = 1),
u as (select id, match_class, cr, score, updated_at from scored union all select id, 'graph_only', 6, score, updated_at from g1),
r as (select *, {_RANK} as rk from u) select rk as rank, id, match_class, score from r where rk <= 20"""
)
def query_with_recall(spark: SparkSession, root: str) -> DataFrame:
    q = retrieval.Query("archive choir", AS_OF, limit=20)
    notes = views.notes(spark, root, once=False)
    return graph.query_with_recall(retrieval.note_index(notes), views.edges(spark, root), q, graph.Recall(), notes).select(*MATCH)


def _context(spark: SparkSession, root: str, filters: retrieval.Filters = retrieval.Filters()) -> Context:
    q = retrieval.Query(TEXT, AS_OF, filters)
    return Context(note_index_of(spark, root), diary_index_of(spark, root), views.nodes(spark, root), views.edges(spark, root), q)


def _context_sql(passes: str) -> str:
    return (
        top_sql(TEXT, passes)
    + f""", dd as (select *, {TOKENS_SQL.format("content || ' ' || array_to_string(tags, ' ')")} as toks from diary),
dr as (select id, content, row_number() over (order by updated_at desc nulls last, id) as rank from dd where list_has_any(toks, {text_list(query_tokens(TEXT))})),
ch as (select 'note' as kind, id, content, rank as ord from ranked where rank <= 12 union all select 'diary', id, content, 12 + rank from dr where rank <= 4),
rm as (select *, greatest(0, 12000 - coalesce(sum(length(content)) over (order by ord rows between unbounded preceding and 1 preceding), 0)) as room from ch),
sh as (select *, case when length(content) <= room then content when room >= 3 then substr(content, 1, (room - 3)::int) || '...' else substr(content, 1, room::int) end as shown from rm),
sd as (select case kind when 'note' then 'memory:' else 'diary:' end || id as seed, ord from ch where (case kind when 'note' then 'memory:' else 'diary:' end || id) in (select id from nodes)),
adj as (select source as node, target as other, id as edge from edges union all select target, source, id from edges),
nn as (select seed as id, ord, 0 as part from sd union all select other, ord, 1 from sd join adj on node = seed),
n1 as (select id, ord, part from nn qualify row_number() over (partition by id order by ord, part) = 1),
gn as (select id, rn from (select id, row_number() over (order by ord, part, id) as rn from n1) where rn <= 24),
e1 as (select edge as id, min(ord) as ord from sd join adj on node = seed group by 1),
ge as (select id, rn from (select e1.id, row_number() over (order by e1.ord, e1.id) as rn from e1 join edges using (id) where source in (select id from gn) and target in (select id from gn)) where rn <= 32)
"""
)


_CONTEXT = _context_sql("default")


@checked_by(_CONTEXT + "select kind, id, ord, shown from sh")
def context_items(spark: SparkSession, root: str) -> DataFrame:
    return _context(spark, root).chosen.select("kind", "id", "ord", "shown")


@checked_by(
    _CONTEXT
    + """, cites as (select kind, id, 0 as part, ord from sh union all select 'node', id, 2, rn from gn union all select 'edge', id, 3, rn from ge)
select kind || ':' || id as ref, kind, id, row_number() over (order by part, ord) as ord from cites"""
)
def context_citations(spark: SparkSession, root: str) -> DataFrame:
    return _context(spark, root).citations()


_REPORT = f""", z as (select least((select count(*) from ranked), 50) as nn, least((select count(*) from dr), 20) as nd, (select count(*) from sh where kind = 'note') as kn, (select count(*) from sh where kind = 'diary') as kd,
(select sum(length(content) - length(shown))::bigint from sh) as co, (select count(*) from n1) as an, (select count(*) from gn) as gnn, (select count(*) from e1) as ae, (select count(*) from ge) as gee)
select 'query' as mode, '{{0}}' as filters_applied, nn as matched_notes, nd as matched_diary, nn - kn as notes_omitted, nd - kd as diary_omitted, an - gnn as nodes_omitted, ae - gee as edges_omitted, co as chars_omitted,
nn > kn or nd > kd or an > gnn or ae > gee or co > 0 as hit_budget from z"""


@checked_by(_CONTEXT + _REPORT.format(""))
def context_report(spark: SparkSession, root: str) -> DataFrame:
    return _context(spark, root).report()


@checked_by(_context_sql("narrow") + _REPORT.format("pinnedOnly,categories"))
def context_report_filtered(spark: SparkSession, root: str) -> DataFrame:
    """The report of a context of pinned notes of two categories."""
    return _context(spark, root, NARROW).report()



CONDENSE_SQL = (
    f"with {VIEWS_SQL},"
    + r""" t as (select id, content, regexp_replace(content, '^[\s\x{a0}\x{2009}]+|[\s\x{a0}\x{2009}]+$', '', 'g') as body, """
    + TOKENS_SQL.format("content")
    + r""" as toks from notes),
s as (select *, string_split_regex(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') as parts from t where body <> ''),
p as (select id, generate_subscripts(parts, 1) as i, regexp_replace(regexp_replace(unnest(parts), '\s+', ' ', 'g'), '^[\s\x{a0}\x{2009}]+|[\s\x{a0}\x{2009}]+$', '', 'g') as sentence from s),
k as (select *, array_to_string("""
    + TOKENS_SQL.format("sentence").replace("nfc_normalize(sentence)", "sentence")
    + r""", ' ') as key from p where length(sentence) between 8 and 240),
f as (select id, i, sentence from k where key <> '' qualify row_number() over (partition by id, key order by i) = 1),
g as (select id, i, sentence from f qualify row_number() over (partition by id order by i) <= 5),
facts as (select id, string_agg(sentence, chr(10) order by i) as key_facts, count(*) as n from g group by id),
a as (select s.id, coalesce(key_facts, '') as key_facts, coalesce(n, 0) as n, case when length(body) <= 200 then body else substr(body, 1, 197) || '...' end as summary,
    array_to_string(list_slice(list_sort(list_distinct(toks)), 1, 8), ' ') as tags, case """
    + " ".join(f"when list_has_any(toks, {text_list(list(words))}) then '{name}'" for name, words in CATEGORY_RULES)
    + """ end as category from s left join facts using (id))
select id, key_facts, summary, tags, category, greatest(0::double, least(1::double, 0::double + 0.4::double + case when n > 0 then 0.1::double else 0 end + least(n, 5) * 0.02::double
    + case when category is not null then 0.1::double else 0 end + case when tags <> '' then 0.05::double else 0 end + 0::double)) as confidence from a"""
)


@checked_by(CONDENSE_SQL)
def condensation(spark: SparkSession, root: str) -> DataFrame:
    c = condensed(views.notes(spark, root).select("id", "content"))
    return c.select("id", F.array_join("key_facts", "\n").alias("key_facts"), "summary", F.array_join("tags", " ").alias("tags"), "category", "confidence")


@checked_by(
    f"""with {VIEWS_SQL}, side as (select id as edge_id, source as node, target as adjacent, case when source = target then 'self' else 'out' end as direction from edges
    union all select id, target, source, 'in' from edges where source <> target),
fr as (select node, edge_id || ' ' || direction || ' ' || adjacent as t, row_number() over (partition by node order by edge_id) as nth, count(*) over (partition by node) as known from side),
rel as (select node, max(known) as known, count(*) as returned, string_agg(t, ',' order by nth) as relationships from fr where nth <= 32 group by node)
select id, status, category, array_to_string(list_slice(list_sort(tags), 1, 32), ',') as tags, len(tags) as tags_known, confidence, coalesce(expires_at <= timestamp '{AS_OF}', false) as expired,
('memory:' || id) in (select id from nodes) as node_present, coalesce(known, 0) as known_count, coalesce(returned, 0) as returned_count, coalesce(relationships, '') as relationships
from notes left join rel on rel.node = 'memory:' || id"""
)
def explanations(spark: SparkSession, root: str) -> DataFrame:
    e = explained(views.notes(spark, root), views.nodes(spark, root), views.edges(spark, root), AS_OF)
    shown = F.coalesce(F.array_join(F.transform("relationships", lambda x: F.concat_ws(" ", x["edge_id"], x["direction"], x["adjacent"])), ","), F.lit(""))
    return e.withColumns({"tags": F.array_join("tags", ","), "relationships": shown, "tags_known": F.col("tags_known").cast("bigint"), "returned_count": F.col("returned_count").cast("bigint")})


_HEALTH = f"""with {VIEWS_SQL}, raw as (select distinct id, lower(trim(status)) as status, confidence, created_at, updated_at, expires_at from memory_notes),
dg as (select distinct unnest([source, target]) as node from edges),
h as (select id, status, coalesce(expires_at <= timestamp '{AS_OF}', false) as expired, ('memory:' || id) not in (select node from dg) as missing_node,
    not coalesce(status in ('candidate', 'active', 'archived', 'rejected'), false) as e1, not coalesce(confidence >= 0 and confidence <= 1 and not isnan(confidence), false) as e2, created_at is null or updated_at is null as e3 from raw),
"""


def _health(spark: SparkSession, root: str) -> DataFrame:
    """Health of the notes as stored: states and scores are not repaired first."""
    raw = views.records(spark, root, "memory_notes", "id", "status", "confidence", "created_at", "updated_at", "expires_at").withColumn("status", F.lower(F.trim("status")))
    return note_health(raw, views.nodes(spark, root), views.edges(spark, root), AS_OF)


@checked_by(
    _HEALTH
    + """k as (select count(*) as known, count(*) filter (where status = 'candidate') as candidate, count(*) filter (where status = 'active') as active, count(*) filter (where status = 'archived') as archived,
    count(*) filter (where status = 'rejected') as rejected, count(*) filter (where expired) as expired, count(*) filter (where missing_node) as missing_nodes, 0::bigint as isolated, count(*) filter (where e1 or e2 or e3) as failing from h)
select *, case when known > 4096 then 0 else least(known, 256) end as inspected, known <= 256 as complete,
    case when known > 4096 then 'population-work-limit' when known > 256 then 'note-output-limit' else '' end as reasons,
    array_to_string(list_filter([case when expired > 0 then 'expired-notes' end, case when missing_nodes > 0 then 'missing-graph-nodes' end, case when isolated > 0 then 'isolated-notes' end], lambda x: x is not null), ',') as observations,
    array_to_string(list_filter([case when expired > 0 then 'review-expired-notes' end, case when missing_nodes + isolated > 0 then 'consider-note-links' end], lambda x: x is not null), ',') as suggestions from k"""
)
def health(spark: SparkSession, root: str) -> DataFrame:
    r = health_report(_health(spark, root))
    return r.withColumns({c: F.array_join(c, ",") for c in ("reasons", "observations", "suggestions")})


@checked_by(
    _HEALTH
    + """f as (select id, unnest(list_filter([case when e1 then 'invalid-status' end, case when e2 then 'invalid-confidence' end, case when e3 then 'invalid-timestamp' end], lambda x: x is not null)) as error from h)
select id, error from f order by id, error limit 128"""
)
def health_failures(spark: SparkSession, root: str) -> DataFrame:
    return health_findings(_health(spark, root))


@checked_by(f"""with {VIEWS_SQL}, k as (select id, json_extract_string(metadata, '$.claimKey') as claim_key from notes where json_valid(metadata))
select claim_key, count(*) as n_notes, string_agg(id, ',' order by id) as note_ids from k where claim_key is not null group by 1 having count(*) > 1""")
def claim_groups(spark: SparkSession, root: str) -> DataFrame:
    k = views.notes(spark, root).select("id", F.get_json_object("metadata", "$.claimKey").alias("claim_key")).where("claim_key is not null")
    return k.groupBy("claim_key").agg(F.count(F.lit(1)).alias("n_notes"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("note_ids")).where("n_notes > 1")
