"""Problems 6, 8, 9 and 10 on small odd tables, against brute force and round trips."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import lookalikes, mixing, near_duplicates, tokenizer


@pytest.fixture(scope="module")
def enc():
    return tokenizer.TreeEncoder(tokenizer.read_ranks(tokenizer.vocabulary()), leaf=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "th", "'s", "'r", "e", " ", "\n", "\t", "1", "9", ".", "=", "é", "の", "🙂", "‍", "　", "\x1d", "͸", "<|endoftext|>"]), st.integers(1, 9)), max_size=40))
def test_tree_encoding_equals_one_pass(enc, parts):
    text = "".join(p * n for p, n in parts)
    assert enc.encode(text) == enc.bpe.encode_ordinary(text)
    assert enc.decode(enc.encode(text)) == text


def test_long_runs(enc):
    r = random.Random(2)
    for alphabet, n in (("a", 20_000), (" ", 9_000), ("=", 9_000), ("abcdefghij", 20_000), ("のにしまは", 9_000), ("0123456789", 9_000)):
        text = "".join(r.choice(alphabet) for _ in range(n)) + "x"
        assert enc.encode(text) == enc.bpe.encode_ordinary(text)


def test_both_public_libraries_agree(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Hello  world's 123\n", "naïve <|endoftext|> ☃ 日本語のテキスト", "​﻿ x"):
        assert enc.encode(text) == t.encode(text, add_special_tokens=False).ids


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, ids int, n_tokens int")


def test_ids_of_odd_texts(spark):
    df = documents(spark, [(1, None, "a"), (2, "", "a"), (3, " ", None), (4, "x y" * 50_000, "b"), (4, "x y" * 50_000, "b")])
    got = sorted((r.doc_id, r.ids) for r in tokenizer.token_ids(df).collect())
    assert [g[1] for g in got[:2]] == [[], []] and len(got) == 5 and got[3] == got[4]
    back = {r.doc_id: r.text for r in tokenizer.decoded(tokenizer.token_ids(df)).collect()}
    assert back == {1: "", 2: "", 3: " ", 4: "x y" * 50_000}
    assert tokenizer.token_ids(df.limit(0)).count() == 0


def records(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "ref string, content string, n int")


def words_of(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


def brute(rows, low=20, share=0.7):
    sets = {r: words_of(t) for r, t in rows if t is not None}
    sets = {r: s for r, s in sets.items() if len(s) >= low}
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) * 10 >= round(share * 10) * len(sets[a] | sets[b])}


def edited(r, words, vocabulary):
    out = list(words)
    for _ in range(r.randint(0, 12)):
        at, what = r.randrange(len(out)), r.randint(0, 2)
        if what == 0:
            out[at] = r.choice(vocabulary)
        elif what == 1:
            out.insert(at, r.choice(vocabulary))
        elif len(out) > 5:
            out.pop(at)
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("vocabulary", "rare", "pair"), [(60, 2, 1), (60, 500, 2000), (4000, 3, 4), (200, 5, 2)])
def test_near_duplicates_equal_brute_force(spark, vocabulary, rare, pair, monkeypatch):
    r = random.Random(vocabulary + rare)
    vocab = [f"w{i}" for i in range(vocabulary)]
    monkeypatch.setattr(near_duplicates, "PAIR_ROWS", pair)
    rows = []
    for base in range(60):
        words = [r.choice(vocab[: 1 + int(vocabulary * r.random())]) for _ in range(r.randint(22, 70))]
        rows += [(f"r{base:02d}-{k}", " ".join(edited(r, words, vocab))) for k in range(r.randint(1, 5))]
    got = {tuple(x) for x in near_duplicates.near_duplicate_pairs(records(spark, rows), rare=rare).collect()}
    assert got == brute(rows)


def test_reach_covers_all_ways_to_miss_words():
    """At any settings two sets that share enough meet at an anchor where the smaller plays its role."""
    r = np.random.default_rng(4)
    for trial in range(40):
        vocab = r.integers(-(2**63), 2**63, int(r.integers(60, 400)))
        sets = []
        for _ in range(30):
            base = r.choice(vocab, int(r.integers(20, 58)), replace=False)
            keep = base[r.random(len(base)) > r.random() * 0.25]
            sets += [np.unique(base), np.unique(np.concatenate([keep, r.choice(vocab, int(r.integers(0, 6)))]))]
        sets = [s for s in sets if len(s) >= 20]
        flat, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        sketch = near_duplicates.levels(np.bincount((flat.view(np.uint64) >> np.uint64(54)).astype(np.int64), minlength=1 << 10))
        cover = near_duplicates.AnchorCover(sketch, int(r.integers(0, 30)), pair=int(r.integers(0, 5)))
        for _ in range(int(r.integers(0, 1 + cover.rounds(20, near_duplicates.SHARE)))):
            found = cover.suspects(flat, offsets) >> np.uint64(64 - near_duplicates.CELL_BITS)
            hot = np.bincount(found.astype(np.int64), minlength=1 << near_duplicates.CELL_BITS) > cover.pair
            cover.hot.append(np.packbits(hot, bitorder="little"))
        rec, anchor, smaller, _ = cover.anchors(flat, offsets)
        at = [(set(anchor[rec == i]), set(anchor[(rec == i) & smaller])) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = len(np.intersect1d(a, b))
                if i != j and len(a) <= len(b) and same * 10 >= 7 * (len(a) + len(b) - same) and not np.array_equal(a, b):
                    assert at[i][1] & at[j][0], trial


def test_blocks_meet_as_the_join_does(spark, monkeypatch):
    r = np.random.default_rng(8)
    n = 3000
    size, role = r.choice([20, 21, 25, 30, 40, 300, 400, 511], n).astype(np.uint64), r.integers(0, 2, n).astype(np.uint64)
    near = r.integers(0, 4, n).astype(np.uint64)
    columns = [r.integers(-9, 9, n) ** 3, r.integers(0, 400, n), (near << np.uint64(11) | size << np.uint64(1) | role).view(np.int64), r.integers(0, 9, n)]
    columns[0][:900] = -7
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in columns))), "anchor bigint, k1 bigint, info bigint, more bigint")
    want = sorted(tuple(x) for x in near_duplicates.meetings(df, 7, 10).where("ka != kb").collect())
    for rows, pairs in ((100_000, 1 << 20), (50, 17)):
        monkeypatch.setattr(near_duplicates, "ROWS_AT_ONCE", rows)
        monkeypatch.setattr(near_duplicates, "PAIRS_AT_ONCE", pairs)
        size_of = lambda c: (c[2] >> 1) & 511
        order = np.lexsort((size_of(columns), columns[0]))
        ordered = [c[order] for c in columns]
        got = [x for a, b in near_duplicates.compared(ordered[0], ordered[1], ordered[2].view(np.uint64), ordered[3].view(np.uint64), 7, 10) for x in zip(a.tolist(), b.tolist())]
        assert sorted(set(got)) == want
        assert sorted(tuple(x) for x in near_duplicates.block_meetings(df, 4, 7, 10).collect()) == want


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(25))
    huge = " ".join(f"h{i}" for i in range(20_000))
    rows = [("memory:a", text), ("memory:a", text), ("diary:a", text.upper() + "!!"), ("memory:b", None), ("memory:c", ""), ("memory:d", "few words"), ("memory:e", huge), ("memory:f", huge + " more"), ("memory:g", text.replace("word1 ", "other "))]
    got = {tuple(x) for x in near_duplicates.near_duplicate_pairs(records(spark, rows)).collect()}
    assert got == brute(rows) and ("memory:e", "memory:f") in got
    degrees = {r.ref: (r.class_id, r.n_equal, r.n_near) for r in near_duplicates.near_duplicate_degrees(records(spark, rows), share=(8, 10)).collect()}
    assert degrees["memory:a"] == degrees["diary:a"] == ("diary:a", 2, 1) and degrees["memory:g"] == ("memory:g", 1, 1)
    assert near_duplicates.near_duplicate_pairs(records(spark, [])).count() == 0


def test_one_class_with_a_third_of_all_records(spark):
    text = " ".join(f"word{i}" for i in range(25))
    rows = [(f"r{i:03d}", text if i % 3 == 0 else text + " more" if i == 1 else " ".join(f"u{i}x{k}" for k in range(22))) for i in range(150)]
    for hot_rows in (5, 100_000):
        assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(records(spark, rows), hot_rows=hot_rows).collect()} == brute(rows)
        degrees = {r.ref: (r.class_id, r.n_equal, r.n_near) for r in near_duplicates.near_duplicate_degrees(records(spark, rows), hot_rows=hot_rows).collect()}
        assert len(degrees) == 150 and degrees["r003"] == ("r000", 50, 1) and degrees["r001"] == ("r001", 1, 1)


def test_a_hot_class_is_spread_over_the_tasks(spark, monkeypatch):
    """Two thirds of all records are copies: no bucket takes more than its share of rows, and words travel once per reading task."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_duplicates, "ROWS_PER_BUCKET", 100)
    text = " ".join(f"word{i}" for i in range(25))
    rows = [(f"r{i:04d}", text if i % 3 else " ".join(f"u{i}x{k}" for k in range(22))) for i in range(1200)]
    classes, others, n = near_duplicates.word_classes(records(spark, rows).repartition(4))
    assert n == 1200 and classes.count() == 401 and others.where(F.col("ref").isNotNull()).count() >= 799
    per_task = [r.n for r in near_duplicates.word_sets(records(spark, rows).repartition(4)).repartition(12, "b").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) == 12 and max(per_task) < 2 * 1200 / 12
    with_words = near_duplicates.word_sets(records(spark, rows).repartition(4)).where("words is not null").groupBy("k1", "k2").count().agg(F.max("count")).first()[0]
    assert with_words <= 4


def test_hot_anchors_are_split(spark, monkeypatch):
    """Records of a small common vocabulary: hot anchors are counted and split, so none is met by as many records, and no pair is lost."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(f"r{i:03d}", " ".join(r.sample(vocab, 30))) for i in range(300)]
    rows += [(f"s{i:03d}", f"{t} more") for i, (_, t) in enumerate(rows[::10])]
    most = {}
    for pair in (40, 10**6):
        monkeypatch.setattr(near_duplicates, "PAIR_ROWS", pair)
        classes, _, n = near_duplicates.word_classes(records(spark, rows))
        cover = near_duplicates.AnchorCover(near_duplicates.frequency_sketch(classes), rare=3, pair=pair)
        near_duplicates.count_hot(classes, cover, 20)
        met = near_duplicates.anchor_rows(classes, cover).groupBy("anchor").agg(F.sum(F.col("info").bitwiseAND(F.lit(1))).alias("small"), F.count("*").alias("n"))
        most[pair] = met.agg(F.max(F.col("small") * F.col("n"))).first()[0]
        assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(records(spark, rows), rare=3).collect()} == brute(rows)
    assert most[40] < most[10**6] / 2


def test_lookalikes(spark):
    table = lookalikes.prototypes(spark)
    same = ["Café no. 1", "Café no. 1", "Сafé no. 1", "Cаfé nο. 1", "Ｃａｆé　no. 1", "Ca​fé ⁠no.﻿ 1", "\U0001d402afé no. 1"]
    forms = {unicodedata.normalize("NFC", lookalikes.skeleton(t, table)) for t in same}
    assert forms == {"Café no. 1"}
    apart = ["Café no. 1", "café no. 1", "Cafe no. 1", "Café  no. 1", "Café no. ¹", "Café no. ½", "Café no. l", "Café no. I", "Café n0. 1", "Ⓒafé no. 1"]
    assert len({lookalikes.skeleton(t, table) for t in apart}) == len(apart)
    rows = [(i, t, "s") for i, t in enumerate([*same, *apart, None, "", "  ", " ", "x" * 200_000, "х" * 200_000])]
    pairs = {tuple(r) for r in lookalikes.lookalike_pairs(documents(spark, rows)).collect()}
    cafe = [i for i, t, _ in rows if t and unicodedata.normalize("NFC", lookalikes.skeleton(t, table)) == "Café no. 1"]
    want = {(a, b) for a in cafe for b in cafe if a < b and rows[a][1] != rows[b][1]} | {(len(rows) - 2, len(rows) - 1)}
    assert pairs == want
    assert {r.doc_id for r in lookalikes.lookalike_classes(documents(spark, rows)).collect()} == {*cafe, len(rows) - 2, len(rows) - 1}
    assert {r.doc_id: r.form for r in lookalikes.normal_forms(documents(spark, rows)).collect()}[len(same) + len(apart)] is None
    assert lookalikes.lookalike_pairs(documents(spark, [])).count() == 0


def test_letters_drawn_like_m(spark):
    table = lookalikes.prototypes(spark)
    alike = [f"{c}odern" for c in ("m", "\u217f", "\U00011700", "\uff4d", "\U0001d426")]
    assert {lookalikes.skeleton(t, table) for t in alike} == {"modern"}
    rows = [(i, t, "s") for i, t in enumerate([*alike, "rnodern", "Modern"])]
    assert {tuple(r) for r in lookalikes.lookalike_pairs(documents(spark, rows)).collect()} == {(a, b) for b in range(5) for a in range(b)}
    assert {r.doc_id: r.form for r in lookalikes.normal_forms(documents(spark, rows)).collect()} == {i: "modern" for i in range(5)} | {5: "rnodern", 6: "Modern"}


def test_a_third_of_all_texts_look_alike(spark):
    rows = [(i, ("сop" if i % 6 else "cop") if i % 3 == 0 else f"t{i}", "s") for i in range(300)]
    want = {(min(a, b), max(a, b)) for a in range(0, 300, 6) for b in range(3, 300, 6)}
    assert {tuple(r) for r in lookalikes.lookalike_pairs(documents(spark, rows)).collect()} == want


TARGET = "mix_name string, source string, target_share double, max_repeats int"


def test_mix_meets_targets_within_repeats(spark):
    docs = documents(spark, [(i, "one two three", "big") for i in range(600)] + [(1000 + i, "four", "small") for i in range(40)] + [(2000, "left", "untargeted"), (2001, None, "big"), (2002, "", "small"), (2003, "x", None)])
    targets = spark.createDataFrame([("m", "big", 3.0, 1), ("m", "small", 1.0, 5), ("m", "nowhere", 1.0, 2), ("m", "small", 1.0, 5), ("n", "small", 1.0, 3), (None, "big", 1.0, 1), ("n", "big", None, None)], TARGET)
    for per_range in (7, 50_000):
        drawn = mixing.draw_mixes(docs, targets, docs_per_range=per_range).collect()
        of = {(m, s): [r for r in drawn if (r.mix_name, r.source) == (m, s)] for m, s in (("m", "big"), ("m", "small"), ("n", "small"))}
        assert len(drawn) == sum(map(len, of.values()))
        tokens = {k: sum(r.n_tokens * r.repeats for r in v) for k, v in of.items()}
        assert tokens["m", "small"] == 200 and tokens["m", "big"] == 600 and tokens["n", "small"] == 120
        assert {r.repeats for r in of["m", "small"]} == {5} and {r.repeats for r in of["m", "big"]} == {1}
    shares = {(r.mix_name, r.source): r for r in mixing.mix_shares(docs, targets).collect()}
    assert shares["m", "big"].reached_share == 0.75 and shares["m", "nowhere"].reached_share == 0.0 and shares["m", "big"].target_share == 0.6
    capped = {(r.mix_name, r.source): r.tokens for r in mixing.mix_shares(docs, targets, total_tokens=10_000).collect()}
    assert capped["m", "small"] == 200 and capped["m", "big"] == 1800
    assert mixing.draw_mixes(docs.limit(0), targets).count() == 0 and mixing.draw_mixes(docs, targets.limit(0)).count() == 0


def test_prefix_sums_are_whole(spark):
    docs = spark.createDataFrame([(i, "s", 1 + i % 5) for i in range(500)], "doc_id bigint, source string, n_tokens int")
    got = sorted((r.upto, r.n_tokens) for r in mixing.prefix_sums(docs, docs_per_range=9).collect())
    total = 0
    for upto, n in got:
        total += n
        assert upto == total
