"""Queries of the training-data operators over whole tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import strip_white
from recollect.llm import cooccurrence, format_duplicates, lookalikes, mixing, near_duplicates, survivorship, term_counts, tokenizer
from recollect.session import materialize
from recollect.sources.tables import table


def _notes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "memory_notes")


def _diary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "diary_entries")


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return format_duplicates.format_copies(_notes(spark, root))


def p1_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return format_duplicates.collapsed_notes(_notes(spark, root))


def _p2(spark: SparkSession, root: str) -> DataFrame:
    return term_counts.corpus_counts(_notes(spark, root), _diary(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _p2(spark, root).where("mark is not null").select("field", "term", "mark")


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    return _p2(spark, root)


def p2_revised(spark: SparkSession, root: str) -> DataFrame:
    """Counts kept in a store that is opened again and told that archived notes are gone and pinned ones lost their tags."""
    archived, pinned = F.coalesce(F.lower(strip_white(F.col("status"))) == "archived", F.lit(False)), F.coalesce("pinned", F.lit(False))
    return term_counts.revised_counts(_notes(spark, root), _diary(spark, root), archived, pinned)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    weighted = cooccurrence.all_baskets(_notes(spark, root), _diary(spark, root))
    return cooccurrence.strong_pairs(cooccurrence.item_pairs(weighted, cooccurrence.MIN_RECORDS))


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    return cooccurrence.item_pairs(cooccurrence.all_baskets(_notes(spark, root), _diary(spark, root)))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return survivorship.claim_survivors(_notes(spark, root))


def p5_consistent(spark: SparkSession, root: str) -> DataFrame:
    """As p5_found, with status and pinned chosen so that the two occur together in a note of the claim."""
    return survivorship.claim_survivors(_notes(spark, root), [("status", "pinned")])


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.contents(_notes(spark, root), "memory").unionByName(near_duplicates.contents(_diary(spark, root), "diary"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_texts(spark, root))


def p6_degrees(spark: SparkSession, root: str) -> DataFrame:
    """One row per record: its class of equal word sets and the number of classes near it."""
    return near_duplicates.near_duplicate_degrees(_texts(spark, root))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.token_ids(_docs(spark, root))


def p8_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Per document whether it has tokens, and whether decoding them gives the text again (null and empty: the empty text)."""
    docs = _docs(spark, root)
    ids = materialize(tokenizer.token_ids(docs), "token-ids")
    back = tokenizer.decoded(ids).withColumnRenamed("text", "decoded")
    counted = ids.select("doc_id", (F.size("ids") > 0).alias("has_tokens"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").join(counted, "doc_id").select("doc_id", "has_tokens", (F.col("text") == F.col("decoded")).alias("same"))


def p9_draws(spark: SparkSession, root: str) -> DataFrame:
    return mixing.draw_mixes(_docs(spark, root), table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_shares(_docs(spark, root), table(spark, root, "mix_targets"))


def p9_checks(spark: SparkSession, root: str) -> DataFrame:
    """What every row of ``p9_shares`` must hold: the cut is within one text of its budget, no text is over its repeats, shares add up."""
    docs = _docs(spark, root)
    sized = mixing.sized_documents(docs)
    s = mixing.mix_shares(docs, table(spark, root, "mix_targets"), sized=sized)
    longest = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    s = s.join(longest, "source", "left").withColumn("total", F.sum("reached_share").over(W.partitionBy("mix_name")))
    cut = F.coalesce((F.col("budget") - F.col("tokens")).between(0, F.col("longest")), F.col("tokens") == 0)
    return s.select("mix_name", "source", "max_repeats", (F.col("source_tokens") > 0).alias("has_tokens"), cut.alias("cut_exactly"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("total") - 1) < 1e-9).alias("whole"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_docs(spark, root))


def p10_forms(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.normal_forms(_docs(spark, root))


def p10_classes(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.lookalike_classes(_docs(spark, root))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_collapsed, p2_found, p2_counts, p2_revised, p3_found, p3_pairs, p5_found, p5_consistent, p6_found, p6_degrees, p8_ids, p8_roundtrip, p9_draws, p9_shares, p9_checks, p10_found, p10_forms, p10_classes)
}

_CANONICAL = r"""
with n as (select distinct id, regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g') as c,
    list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g')), lambda t: t is not null and t <> ''))) as t
    from memory_notes),
g as (select id, min(id) over (partition by c, t) as first_id, count(*) over (partition by c, t) as n_copies from n where c <> '')
"""

_TERM = r"lower(regexp_replace({0}, '^[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g'))"

def _counts(notes: str) -> str:
    return f"""
with n as ({notes}), d as (select distinct id, tags from diary_entries),
raw as (select 'note_tag' as field, id, unnest(tags) as v from n union all select 'note_category', id, category from n union all select 'diary_tag', id, unnest(tags) from d),
t as (select field, id, {_TERM.format('v')} as term from raw),
c as (select field, term, count(*) as n_occurrences, count(distinct id) as n_records from t where term <> '' group by field, term),
m as (select *, case when field = 'diary_tag' then (select count(*) from d) else (select count(*) from n) end as total from c)
"""


_COUNTS = _counts("select distinct id, tags, category from memory_notes")
_REVISED = _counts(f"select distinct id, case when not coalesce(pinned, false) then tags end as tags, category from memory_notes where {_TERM.format('status')} is distinct from 'archived'")
_MARK = "case when n_records < 3 then 'rare' when n_records * 10 > total then 'common' end"

_PAIRS = f"""
with r as (select distinct 'note' as collection, id, tags from memory_notes union all select distinct 'diary', id, tags from diary_entries),
t as (select distinct collection, id, {_TERM.format('v')} as term from (select collection, id, unnest(tags) as v from r)),
k as (select * from t where term <> ''),
one as (select collection, term, count(*) as n from k group by 1, 2),
total as (select collection, count(*) as n from r group by 1),
two as (select a.collection, a.term as tag_a, b.term as tag_b, count(*) as n_ab from k a join k b on a.collection = b.collection and a.id = b.id and a.term < b.term group by 1, 2, 3),
p as (select two.*, x.n as n_a, y.n as n_b, total.n as n from two join one x on x.collection = two.collection and x.term = tag_a join one y on y.collection = two.collection and y.term = tag_b join total on total.collection = two.collection)
"""

_CLAIMS = r"""
with n as (select distinct id, confidence, status, pinned, updated_at, metadata from memory_notes),
k as (select *, json_extract_string(metadata, '$.claimKey') as claim_key, lower(trim(status, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as st,
    coalesce(confidence >= 0 and confidence <= 1 and not isnan(confidence), false) as ok
    from n where json_valid(metadata) and json_type(metadata, '$.claimKey') = 'VARCHAR'),
c as (select *, case st when 'active' then 0 when 'candidate' then 1 when 'archived' then 2 when 'rejected' then 3 else 4 end as sr from k where claim_key <> ''),
"""
_FIRST = _CLAIMS + """
s as (select claim_key, min(id) as lo, max(id) as hi,
    first(id order by case when pinned then 0 else 1 end, sr, case when ok then -confidence else 2 end, updated_at desc nulls last, id) as survivor_id,
    coalesce(first(id order by updated_at desc nulls last, id) filter (where ok), '') as confidence_id,
    coalesce(first(id order by updated_at desc nulls last, id) filter (where sr < 4), '') as status_id,
    coalesce(first(id order by updated_at desc nulls last, id) filter (where pinned is not null), '') as pinned_id
    from c group by claim_key)
"""

# Pairs ``ra, rb`` of records that share at least seven tenths of all their words, as ``hit``; by an inverted index.
_NEAR = r"""
with recs as (select distinct 'memory:' || id as ref, content from memory_notes union all select distinct 'diary:' || id, content from diary_entries),
r as (select ref, ws, len(ws) as n from (select ref, list_sort(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) as ws from recs where content is not null) where len(ws) >= 20),
t as (select ref, n, unnest(ws) as word from r), df as (select word, count(*) as d from t group by 1),
p as (select ref, n, word, row_number() over (partition by ref order by d, word) as pos from t join df using (word)),
f as (select * from p where pos <= n - ((7 * n + 9) // 10) + 1),
c as (select distinct a.ref as ra, b.ref as rb from f a join f b on a.word = b.word and a.ref < b.ref),
hit as (select ra, rb, x.ws as wa, y.ws as wb from c join r x on x.ref = ra join r y on y.ref = rb
    where len(list_intersect(x.ws, y.ws)) * 10 >= 7 * (x.n + y.n - len(list_intersect(x.ws, y.ws))))
"""


# Look-alike letters that the corpus holds, and the letters they are drawn like.
_ALIKE = (
    "АВЕКМНОРСТУХЬЅІЈ" + "агеорсухѕіјһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹνο" + "ɑɡօ" + "ЁёӦӧӒӓӰӱЀѐЇї" + "αγιρσυάίόύϊϋΆΈΊΌΎ",
    "ABEKMHOPCTYXbSIJ" + "areopcyxsijhdqw" + "ABEZHIKMNOPTYXCvo" + "ago" + "ËëÖöÄäŸÿÈèÏï" + "ayipouáíóúïüÁÉÍÓÝ",
)
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_SPACES = "".join(map(chr, (0x3000, 0xA0, 0x2007, 0x202F)))
_FORMS = (
    r"with f as (select doc_id, text, regexp_replace(text, '[\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g') as t from documents),"
    + f" n as (select doc_id, text, nfc_normalize(translate(nfc_normalize(t), '{_ALIKE[0]}{_WIDE}{_SPACES}', '{_ALIKE[1]}{_PLAIN}    ')) as form from f) "
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "p8_roundtrip": "select doc_id, coalesce(text, '') <> '' as has_tokens, true as same from documents",
    "p9_checks": """with d as (select source, sum(length(text)) as n from documents where source is not null group by source), t as (select distinct mix_name, source, max_repeats from mix_targets)
select mix_name, source, max_repeats, coalesce(n, 0) > 0 as has_tokens, true as cut_exactly, true as within_repeats, true as whole from t left join d using (source)""",
    "p6_found": _NEAR + "select ra as ref_a, rb as ref_b from hit",
    "p6_degrees": _NEAR
    + """, k as (select ref, ws, min(ref) over (partition by ws) as class_id, count(*) over (partition by ws) as n_equal from r),
l as (select wa as ws, wb as other from hit where wa <> wb union select wb, wa from hit where wa <> wb), d as (select ws, count(*) as n_near from l group by ws)
select ref, class_id, n_equal, coalesce(n_near, 0) as n_near from k left join d using (ws)""",
    "p10_forms": _FORMS + "select doc_id, form from n",
    "p10_found": _FORMS + f"select a.doc_id as doc_a, b.doc_id as doc_b from n a join n b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text where trim(a.form, {_BLANKS}) <> ''",
    "p10_classes": _FORMS
    + f""", c as (select form, min(doc_id) as class_id, count(distinct text) as n_texts from n where trim(form, {_BLANKS}) <> '' group by form)
select doc_id, class_id, n_texts from n join c using (form) where n_texts > 1""",
    "p1_found": _CANONICAL + "select first_id, id as note_id from g where id <> first_id",
    "p1_collapsed": _CANONICAL + "select id as note_id, n_copies from g where id = first_id",
    "p2_found": _COUNTS + f"select field, term, {_MARK} as mark from m where {_MARK} is not null",
    "p2_counts": _COUNTS + f"select field, term, n_occurrences, n_records, {_MARK} as mark from m",
    "p2_revised": _REVISED + f"select field, term, n_occurrences, n_records, {_MARK} as mark from m",
    "p3_found": _PAIRS + "select collection, tag_a, tag_b from p where n_ab >= 8 and n_ab::hugeint * n >= 3 * n_a::hugeint * n_b",
    "p3_pairs": _PAIRS
    + """select collection, tag_a, tag_b, n_ab, n_a, n_b, n, n_ab::double * n::double / (n_a::double * n_b::double) as lift,
    case when n_ab < n_a then n_a::double * (n::double - n_b::double) / (n::double * (n_a::double - n_ab::double)) end as conviction from p""",
    "p5_found": _FIRST + "select claim_key, survivor_id, confidence_id, status_id, pinned_id from s where lo < hi",
    "p5_consistent": _FIRST
    + """, v as (select *, coalesce(epoch_ms(updated_at), 0) as score from c),
bs as (select claim_key, st, max(score) as sc, first(id order by score desc, id) as sid from v where sr < 4 group by 1, 2),
bp as (select claim_key, pinned, max(score) as pc, first(id order by score desc, id) as pid from v where pinned is not null group by 1, 2),
w as (select distinct claim_key, st, pinned from v where sr < 4 and pinned is not null),
b as (select claim_key, first(sid order by sc + pc desc, sid, pid) as sid, first(pid order by sc + pc desc, sid, pid) as pid from w join bs using (claim_key, st) join bp using (claim_key, pinned) group by 1)
select claim_key, survivor_id, confidence_id,
    case when status_id = '' or pinned_id = '' then status_id else coalesce(sid, '') end as status_id,
    case when status_id = '' or pinned_id = '' then pinned_id else coalesce(pid, '') end as pinned_id
from s left join b using (claim_key) where lo < hi""",
}
