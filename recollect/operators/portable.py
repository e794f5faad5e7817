"""Portable interchange records: export, validation with an issue list, and all-or-nothing import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import strip_white
from recollect.sources.views import STATUSES

# Record schema name, note sources, limits of the exchange.
SCHEMA_NAME = "ether.portable_record.v1"
SOURCES = ("user", "conversation", "diary", "ai", "imported", "system")
MAX_RECORDS, MAX_TEXT, MAX_TOTAL, MAX_DEPTH, MAX_BYTES = 10_000, 100_000, 5_000_000, 8, 1 << 20
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
STRUCT = "schema string, id string, kind string, text string, citation struct<ref:string,kind:string,id:string>, tags array<string>, category string, source string, status string, confidence double, createdAt string, updatedAt string"


def to_portable(notes: DataFrame, diary: DataFrame, schema_name: str = SCHEMA_NAME) -> DataFrame:
    """Notes and diary entries as one set of interchange records; fields a diary entry lacks are null."""

    def base(df: DataFrame, kind: str) -> DataFrame:
        cite = F.struct(F.concat(F.lit(f"{kind}:"), "id").alias("ref"), F.lit(kind).alias("kind"), F.col("id"))
        return df.withColumns({"schema": F.lit(schema_name), "kind": F.lit(kind), "text": F.col("content"), "citation": cite, "createdAt": F.date_format("created_at", ISO), "updatedAt": F.date_format("updated_at", ISO)})

    shared = ["schema", "id", "kind", "text", "citation", "tags"]
    n = base(notes, "note").select(*shared, "category", "source", "status", "confidence", "createdAt", "updatedAt")
    return n.unionByName(base(diary, "diary").select(*shared, "createdAt", "updatedAt"), allowMissingColumns=True)


def parsed_time(c: Column) -> Column:
    """The instant of a strict UTC text with milliseconds; null for any other, such as the 30th of February."""
    t = F.try_to_timestamp(c, F.lit(ISO)).cast("timestamp_ntz")
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    return F.when(shape & (F.date_format(t, ISO) == c), t)


def record_issues(records: DataFrame, note_ids: DataFrame | None = None, diary_ids: DataFrame | None = None, max_text: int = MAX_TEXT, schema_name: str = SCHEMA_NAME) -> DataFrame:
    """``record_index, record_id, field_path, code`` of everything wrong with ``records`` (which have a ``record_index``).

    A record without id has its schema, kind and id checked only; one with a ``depth`` over the limit nothing else. All issues block.
    """
    deep = F.coalesce(F.col("depth") > MAX_DEPTH, F.lit(False)) if "depth" in records.columns else F.lit(False)
    r = records.withColumn("__deep", deep)
    earlier = W.partitionBy("id").orderBy("record_index")
    named = F.col("id").isNotNull() & (strip_white(F.col("id")) != "")
    r = r.withColumn("again", named & (F.row_number().over(earlier) > 1))
    for ids, flag, is_kind in ((note_ids, "in_notes", F.col("kind") == "note"), (diary_ids, "in_diary", ~F.coalesce(F.col("kind") == "note", F.lit(False)))):
        if ids is None:
            r = r.withColumn(flag, F.lit(False))
        else:
            r = r.join(ids.select("id", F.lit(True).alias("__there")).distinct(), "id", "left").withColumn(flag, F.coalesce("__there", F.lit(False)) & is_kind).drop("__there")
    kind, note = F.col("kind"), F.coalesce(F.col("kind") == "note", F.lit(False))
    text, cite = F.col("text"), F.col("citation")
    created, updated = parsed_time(F.col("createdAt")), parsed_time(F.col("updatedAt"))
    cited = F.coalesce((cite["kind"] == kind) & (cite["id"] == F.col("id")) & (cite["ref"] == F.concat_ws(":", kind, "id")), F.lit(False))

    def found(when: Column, code: str, path: str, needs_id: bool = True) -> Column:
        held = F.coalesce(when, F.lit(False))
        return F.when(~F.col("__deep") & (held & named if needs_id else held), F.struct(F.lit(code).alias("code"), F.lit(path).alias("field_path"), F.when(named & F.lit(needs_id), F.col("id")).alias("record_id")))

    conf = F.col("confidence")
    nothing = F.lit(None).cast("string")
    checks = [
        F.when(F.col("__deep"), F.struct(F.lit("INPUT_LIMIT_EXCEEDED").alias("code"), F.lit("$").alias("field_path"), nothing.alias("record_id"))),
        found(F.col("schema").isNull(), "MALFORMED_RECORD", "schema", False),
        found(F.col("schema") != schema_name, "UNSUPPORTED_SCHEMA", "schema", False),
        found(kind.isNull() | ~kind.isin("note", "diary"), "INVALID_KIND", "kind", False),
        found(~named, "INVALID_ID", "id", False),
        found(F.col("again"), "DUPLICATE_PAYLOAD_ID", "id"),
        found(~F.col("again") & (F.col("id") != strip_white(F.col("id"))), "INVALID_ID", "id"),
        found(F.col("in_notes") | F.col("in_diary"), "EXISTING_ID_CONFLICT", "id"),
        found(F.length(text) > max_text, "INPUT_LIMIT_EXCEEDED", "text"),
        found(text.isNull() | ((strip_white(text) == "") & (F.length(text) <= max_text)), "MALFORMED_RECORD", "text"),
        found(created.isNull(), "INVALID_TIMESTAMP", "createdAt"),
        found(updated.isNull(), "INVALID_TIMESTAMP", "updatedAt"),
        found(updated < created, "INVALID_CHRONOLOGY", "updatedAt"),
        found(~cited, "INVALID_CITATION", "citation"),
        found(F.col("tags").isNull() | F.exists("tags", lambda t: t.isNull()), "MALFORMED_RECORD", "tags"),
        found(note & F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "INVALID_STATUS", "status"),
        found(note & F.col("source").isNotNull() & ~F.col("source").isin(*SOURCES), "INVALID_SOURCE", "source"),
        found(note & conf.isNotNull() & (F.isnan(conf) | (conf < 0) | (conf > 1)), "MALFORMED_RECORD", "confidence"),
    ]
    return r.select("record_index", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("record_index", "i.record_id", "i.field_path", "i.code")


def issue_order(issues: DataFrame) -> DataFrame:
    """Issues by record, field and code."""
    return issues.orderBy(F.col("record_index").asc_nulls_last(), F.col("field_path").asc_nulls_last(), "code")


def receipt(records: DataFrame, issues: DataFrame, max_records: int = MAX_RECORDS) -> DataFrame:
    """One row: records, issues, whether they block, and the records imported (all or none)."""
    n = records.agg(F.count(F.lit(1)).alias("n_records"))
    i = issues.agg(F.count(F.lit(1)).alias("n_issues"))
    over = F.col("n_records") > max_records
    blocked = over | (F.col("n_issues") > 0)
    return n.join(i).select("n_records", (F.col("n_issues") + over.cast("int")).alias("n_issues"), blocked.alias("blocking"), F.when(blocked, 0).otherwise(F.col("n_records")).alias("imported"))


def text_size(records: DataFrame) -> Column:
    """Characters of all strings of a record, the names of its fields included."""
    kinds = dict(records.dtypes)
    own = lambda c: F.length(c) if kinds[c] == "string" else F.lit(0)
    fields = [c for c in ("schema", "id", "kind", "text", "category", "source", "status", "confidence", "createdAt", "updatedAt") if c in kinds]
    parts = [F.coalesce(F.lit(len(c)) + own(c) if kinds[c] == "string" else F.when(F.col(c).isNotNull(), F.lit(len(c))), F.lit(0)) for c in fields]
    parts.append(F.coalesce(F.lit(len("tags")) + F.aggregate("tags", F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))), F.lit(0)))
    cite = [F.lit(len("citation")), *[F.coalesce(F.lit(len(c)) + F.length(f"citation.{c}"), F.lit(0)) for c in ("ref", "kind", "id")]]
    parts.append(F.when(F.col("citation").isNotNull(), sum(cite[1:], cite[0])).otherwise(0))
    return sum(parts[1:], parts[0]).cast("bigint")


def receipts(records: DataFrame, issues: DataFrame, by: str, max_records: int = MAX_RECORDS, max_total: int = MAX_TOTAL) -> DataFrame:
    """The receipts of many imports at once, told apart by the column ``by``: records, those with issues, size, whether blocked, records imported.

    An import of too many records, or of too many characters in all, is blocked as a whole.
    """
    bad = issues.select("record_index").distinct().withColumn("bad", F.lit(True))
    r = records.withColumn("chars", text_size(records)).select(by, "record_index", "chars").join(bad, "record_index", "left")
    per = r.groupBy(by).agg(F.count(F.lit(1)).alias("n_records"), F.count("bad").alias("n_bad"), F.sum("chars").alias("chars"))
    blocked = (F.col("n_bad") > 0) | (F.col("n_records") > max_records) | (F.col("chars") > max_total)
    return per.withColumn("blocking", blocked).withColumn("imported", F.when(blocked, 0).otherwise(F.col("n_records")))


def imported(records: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and diary entries with the defaults of an import; none at all where there is an issue."""
    return accepted(records if issues.isEmpty() else records.limit(0))


def accepted(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and diary entries of sound records, with the defaults of an import."""
    text = strip_white(F.col("text"))
    times = [parsed_time(F.col("createdAt")).alias("created_at"), parsed_time(F.col("updatedAt")).alias("updated_at")]
    notes = clean.where("kind = 'note'").select(
        "id", text.alias("content"), "category", "tags", F.coalesce("source", F.lit("imported")).alias("source"), F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("confidence", F.lit(0.75)).alias("confidence"), F.lit(0.5).alias("importance"), F.lit(False).alias("pinned"), F.lit("{}").alias("metadata"), *times
    )
    return notes, clean.where("kind = 'diary'").select("id", text.alias("content"), "tags", F.lit("{}").alias("metadata"), *times)
