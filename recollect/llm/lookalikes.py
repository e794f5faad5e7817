"""Visually identical text with different characters (problem 10).

Confusables skeleton: decompose canonically, replace every character by its prototype, decompose again; originals are grouped by
equal skeleton. Prototypes come from rules, not from a transcribed list: wide forms by their compatibility mapping, letters in a rare
font by theirs, white space that does not break to a space, zero-width characters to nothing, and letters of other scripts by the
public look-alike data (UTS #39) in the ICU library that Spark ships, where their skeleton is that of one basic Latin letter
(the data takes ``m`` apart into ``rn``; the texts ``m`` and ``rn`` themselves stay apart).

Kept apart: letter case, accents, superscripts, fractions, circled and narrow forms, number of spaces.

Defined results: a null text has a null form; an empty or blank one is brought to form but groups with nothing; equal texts are
one class member each but never a found pair; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.skew import pairs_in_groups
from recollect.session import materialize

# Characters without width, spaces at which no line breaks, and kinds of compatibility mapping that stay apart.
ZERO_WIDTH = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
NO_BREAK_SPACES = (0xA0, 0x2007, 0x202F)
APART = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<narrow>")

_TABLES: dict[str, dict[int, str]] = {}


def _basic_latin(s: str) -> bool:
    return len(s) == 1 and s.isascii() and s.isalpha()


def prototypes(spark: SparkSession) -> dict[int, str]:
    """The replacement of each character that has one: built once on the driver, a few thousand entries of fixed size."""
    app = spark.sparkContext.applicationId
    if app in _TABLES:
        return _TABLES[app]
    letters = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo", "Lt", "Nl")]
    single = [c for c in letters if (how := unicodedata.decomposition(c)) == "" or how[0] == "<" and not how.startswith(APART)]
    jvm = spark.sparkContext._jvm
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    basic = [*string.ascii_letters]
    alike = checker.getSkeleton("\n".join(basic + single)).split("\n")
    assert len(alike) == len(basic) + len(single), "the look-alike data must keep line breaks"
    letter = dict(zip(alike, basic)) | {"l": "l"}
    table: dict[int, str] = {}
    for ch, proto in zip(single, alike[len(basic) :]):
        if proto in letter:
            # The data has one prototype for I, l and the digit one; the case of the letter tells them apart.
            table[ord(ch)] = "I" if proto == "l" and unicodedata.category(ch) in ("Lu", "Nl") else letter[proto]
    for c in range(0x80, sys.maxunicode + 1):
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        to = "".join(chr(int(x, 16)) for x in rest.split()) if kind.startswith("<") else ""
        if kind == "<wide>" or kind == "<font>" and _basic_latin(to):
            table[c] = to
    table |= dict.fromkeys(NO_BREAK_SPACES, " ") | dict.fromkeys(ZERO_WIDTH, "")
    _TABLES[app] = table
    return table


def skeleton(text: str, table: dict[int, str]) -> str:
    """Decompose, replace by prototypes, decompose again."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _mapped(docs: DataFrame, schema: str, column: Callable[[list[str | None], dict[int, str]], list[pa.Array]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(prototypes(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *column(texts, shared.value)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def normal_forms(docs: DataFrame) -> DataFrame:
    """``doc_id, form``: the text in the one form that equals that of every text looking the same (composed skeleton)."""

    def column(texts, table):
        return [pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", skeleton(t, table)) for t in texts], type=pa.string())]

    return _mapped(docs, "doc_id bigint, form string", column)


def _digests(docs: DataFrame) -> DataFrame:
    """``doc_id, skeleton_key, text_key`` of each text that is not blank."""

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode(), digest_size=16).digest()

    def column(texts, table):
        shown = [None if t is None else skeleton(t, table) for t in texts]
        keys = [None if s is None or not s.strip() else digest(s) for s in shown]
        return [pa.array(keys, type=pa.binary()), pa.array([None if k is None else digest(t) for k, t in zip(keys, texts)], type=pa.binary())]

    return _mapped(docs, "doc_id bigint, skeleton_key binary, text_key binary", column).where("skeleton_key is not null and doc_id is not null")


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_texts`` of documents whose class holds texts stored differently; the class is its smallest id."""
    keyed = materialize(_digests(docs), "skeletons")
    classes = keyed.groupBy("skeleton_key", "text_key").agg(F.min("doc_id").alias("first"))
    classes = classes.groupBy("skeleton_key").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    return keyed.join(classes, "skeleton_key").select("doc_id", "class_id", "n_texts")


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """``doc_a, doc_b``: documents that look the same but are stored differently.

    Skeletons stored in one way only are left out before pairs are made; large groups are paired block by block.
    """
    keyed = materialize(_digests(docs), "skeletons")
    several = keyed.groupBy("skeleton_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a < b").select("skeleton_key")
    pairs = pairs_in_groups(keyed.join(several, "skeleton_key", "left_semi"), ["skeleton_key"], "doc_id", differ="text_key")
    return pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))
