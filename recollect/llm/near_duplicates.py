"""Near-duplicate records with small edits (problem 6).

Anchor-point covering over word sets. A record is the set of its distinct words, in one order common to all records, rare words first.
The code words (anchors) are small word sets: one rare word, or two frequent words of one hash class, or three where two are still
too frequent. A pair of records that shares at least the threshold misses at most ``m`` words of either, so the words it shares
begin early in both orders. Either its first shared word is rare, which is an anchor of both, among their first ``m + 1`` words.
Or both records miss all their ``r`` rare words; then of the first ``CLASSES + 1`` frequent words they share, which lie among the
first ``m - r + CLASSES + 1`` of either, two fall into one of the ``CLASSES`` classes and are an anchor of both. Each record is replicated
with its fingerprint to every anchor within that reach (covering radius plus threshold) and compared per anchor. Nothing is lost:
the replicas cover all ways to miss ``m`` words. Words found in one record only are misses for certain and lessen ``m``.

The smaller record of a pair needs the lesser reach (it misses at most ``n - 14 n / 17`` words at 0.7), so each replica says whether its
record may also play the smaller one; only such replicas meet the others. Fingerprints fold the words into 117 parity bits: a word in
one record only changes one bit, hence records whose fingerprints differ in more bits than the threshold allows are dropped unseen,
without loss. A second fingerprint of 256 parity bits thins what remains, and the word sets decide exactly.

Anchors that could be hot are counted over all records before any record goes there: an anchor holds at most as many records as its
rarest word, and where that bound is over ``PAIR_ROWS`` the anchor's records are counted, by cells of a fixed number, so a count is never too
low. A hot anchor is split by each further word its pairs must share, which lies one place further at most, for up to ``ROUNDS`` rounds
of counting. What is hot even then is text that really shares that many words; it is counted once more and goes to a join that adaptive skew
handling splits. All other anchors hold few records, which are compared in blocks as they stream by in the order of anchors.

Equal word sets form one class first; links are found between classes and members expanded only where the result is pairs of
records. A class of copies is collapsed in the task that reads it: its words travel once per task, and the other copies are slim rows
spread by their own id, so a class with a third of all records is no task's burden. The order of words uses a sketch of word
frequencies over all records, one byte for each of 2^24 cells whatever the data's size; a wrong estimate costs time, never a link. A binary covering code over bit fingerprints cannot give this result: at 30 words and 0.7 a pair differs in up to 10 bits,
and perfect codes of radius 1 to 3 then need thousands of replicas per record.

Defined results: null content and records with fewer than ``min_words`` distinct words are left out; a redelivered row is one record;
records with equal words are always linked; a record of any length takes part whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import WORD
from recollect.operators.skew import HOT_ROWS, hot_groups, pairs_in_groups, spread_join
from recollect.session import freeing_shuffles, materialize, scratch_path

MIN_WORDS = 20
SHARE = (7, 10)
RARE_ROWS = 500
PAIR_ROWS = 2000
CLASSES = 4
ROUNDS = 3
CELL_BITS = 24
BLOCK_BITS = 16
STEPS = 8
WIDE = 48
PRINT_BITS = (53, 64)
SIZE_LIMIT = (1 << 9) - 1
ROWS_AT_ONCE, PAIRS_AT_ONCE = 100_000, 1 << 20
HASH_CACHE = 1 << 20
SEEN_KEYS = 1 << 18
ROWS_PER_BUCKET = 20_000
ROWS_PER_PARTITION = 8_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
DICTIONARY_BYTES = 16 << 20
PARITY = [f"parity{i}" for i in range(4)]


def contents(df: DataFrame, kind: str) -> DataFrame:
    """``ref, content`` of the records of one table."""
    return df.where("id is not null and content is not null").select(F.concat(F.lit(f"{kind}:"), F.col("id")).alias("ref"), "content")


def word_sets(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``b, k1, k2, ref, words``: the sorted distinct word hashes of each record with enough of them, and two hashes of the set.

    A task gives the words of a set once, with ``b = k1``; its further copies have null words and a ``b`` of their own. (Keys seen
    are forgotten now and then, which only gives some words once more.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        class Hashes(dict):
            def __missing__(self, word: str) -> int:
                self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
                return h

        find, cache, seen = regex.compile(WORD).findall, Hashes(), set()
        for batch in batches:
            keep, sizes, keys, flat, own = [], [], [], [], []
            refs = batch.column(0).to_pylist()
            for at, text in enumerate(batch.column(1).to_pylist()):
                words = set(find(text.lower()))
                if len(words) < min_words:
                    continue
                if len(cache) > HASH_CACHE:
                    cache.clear()
                hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)).view(np.int64)
                hashes.sort()
                key = xxhash.xxh3_128_digest(hashes.tobytes())
                again = key in seen
                if not again:
                    if len(seen) > SEEN_KEYS:
                        seen.clear()
                    seen.add(key)
                    flat.append(hashes)
                keep.append(at)
                sizes.append(0 if again else len(hashes))
                keys.append(key)
                own.append(xxhash.xxh3_64_intdigest(key + refs[at].encode()) if again else None)
            if keep:
                both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                again = np.array([x is not None for x in own])
                spread = np.where(again, np.array([x or 0 for x in own], np.uint64).view(np.int64), both[:, 0])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                words = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)), mask=pa.array(again))
                columns = [pa.array(spread), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column(0).take(pa.array(keep)), words]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "k1", "k2", "ref", "words"])

    return records.where("ref is not null and content is not null").select("ref", "content").mapInArrow(run, "b bigint, k1 bigint, k2 bigint, ref string, words array<bigint>")


def word_classes(records: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """Classes of equal word sets ``k1, k2, ref, n, words, parity*``, their other members ``k1, k2, ref``, and the number of records.

    A class is named by ``k1, k2`` and has one of its records as ``ref``; the others may name it again. The table of classes is bucketed by
    ``k1``: it meets candidate pairs and links without being shuffled again. The number of buckets grows with the records.
    """
    spark = records.sparkSession
    rows = records.count()
    parts = min(max(-(-rows // ROWS_PER_BUCKET), LEAST_BUCKETS), MOST_BUCKETS)
    path = scratch_path(spark, "word-classes")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    names = ["c1", "k1", "k2", "ref", "n", "words", *PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_ref, of_class = None, None, None
        for batch in batches:
            k1, k2, refs, slim = (batch.column(i).to_pylist() for i in (1, 2, 3, 5))
            keep, first = [], []
            for at, key in enumerate(zip(k1, k2)):
                if key == last_key and refs[at] == last_ref:
                    continue
                keep.append(at)
                first.append(not slim[at] and key != of_class)
                last_key, last_ref = key, refs[at]
                if not slim[at]:
                    of_class = key
            if not keep:
                continue
            rows, own = batch.take(pa.array(keep)), pa.array(first)
            lists = rows.column(4)
            words = pa.compute.if_else(own, lists, pa.scalar(None, lists.type))
            sizes = pa.compute.list_value_length(words)
            flat, counts = words.flatten().to_numpy(zero_copy_only=False), pa.compute.fill_null(sizes, 0).to_numpy()
            parity = parities(flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(0), rows.column(2), rows.column(3), sizes, words, *[pa.array(parity[:, i], mask=~np.array(first)) for i in range(4)]], names=names)

    once = word_sets(records, min_words).withColumn("slim", F.col("words").isNull()).repartition(parts, "b").sortWithinPartitions("b", "k1", "k2", "slim", "ref")
    columns = "c1 bigint, k1 bigint, k2 bigint, ref string, n int, words array<bigint>, " + ", ".join(f"{c} bigint" for c in PARITY)
    spark.sql(f"create table {name} ({columns}) using parquet options (`parquet.dictionary.page.size` '{DICTIONARY_BYTES}', compression 'zstd') clustered by (k1) into {parts} buckets location '{path}'")
    with freeing_shuffles(spark):
        once.mapInArrow(run, columns).write.insertInto(name)
    table = spark.table(name)
    others = table.where("n is null").select(F.col("c1").alias("k1"), "k2", "ref").distinct()
    return table.where("n is not null").drop("c1"), materialize(others, "class-members"), rows


def partitions_for(classes: DataFrame, rows: int) -> int:
    """Shuffle partitions for what ``rows`` records are replicated to."""
    return max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-rows // ROWS_PER_PARTITION), MOST_BUCKETS))


def parities(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """256 parity bits of each word set, as four whole numbers."""
    w = words.view(np.uint64)
    out = np.zeros((len(offsets) - 1, 4), np.uint64)
    rec = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    np.bitwise_xor.at(out, (rec, ((w >> np.uint64(8)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << ((w >> np.uint64(10)) & np.uint64(63)))
    return out.view(np.int64)


def cell_levels(cells: DataFrame) -> np.ndarray:
    """One byte for each of 2^24 cells out of ``cell, level`` (0 where missing), packed by tasks: 16 MB reach the driver at most."""
    size = 1 << BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, level = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in np.unique(cell >> BLOCK_BITS):
                mine = (cell >> BLOCK_BITS) == block
                blocks.setdefault(int(block), np.zeros(size, np.uint8))[cell[mine] & (size - 1)] = level[mine]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks.values()], pa.binary())], names=["block", "bytes"])

    import zlib

    out = np.zeros(1 << CELL_BITS, np.uint8)
    packed = cells.repartition(8, F.shiftright("cell", BLOCK_BITS)).mapInArrow(run, "block int, bytes binary")
    with freeing_shuffles(cells.sparkSession):
        for block, data in packed.collect():  # at most 2^8 rows of 2^16 bytes
            out[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as steps of an eighth of a power of two, rounded up; 0 for one and none."""
    return np.minimum(np.ceil(STEPS * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """Levels of the number of classes that hold a word, by cell of its hash. Words of one class alone are not sent."""
    cells = classes.select(F.explode("words").alias("w")).groupBy(F.shiftrightunsigned("w", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.ceil(F.log2("n") * STEPS), F.lit(255)).cast("int")
    return cell_levels(cells.where("n > 1").select("cell", level.alias("level")))


def _mix(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of one or two columns of hashes."""
    x = a.astype(np.uint64)
    if b is not None:
        x = x * np.uint64(0x9E3779B97F4A7C15) + (b.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x


class AnchorCover:
    """Replicates records to anchors. ``sketch`` gives the levels of words, ``hot`` per round which cells of anchors are hot, ``left`` those hot after the last."""

    def __init__(self, sketch: np.ndarray, rare: int = RARE_ROWS, share: tuple[int, int] = SHARE, pair: int = PAIR_ROWS):
        self.sketch, self.rare, self.share, self.pair = sketch, rare, share, pair
        self.shift = np.uint64(64 - (len(sketch).bit_length() - 1))
        self.hot: list[np.ndarray] = []
        self.left: np.ndarray | None = None

    @staticmethod
    def rounds(min_words: int, share: tuple[int, int]) -> int:
        """How often a hot anchor may be split: all pairs must share enough words for one more."""
        return max(0, min(ROUNDS, -(-share[0] * min_words // share[1]) - CLASSES - 1))

    @staticmethod
    def _in(bits: np.ndarray | None, key: np.ndarray) -> np.ndarray:
        if bits is None:
            return np.zeros(len(key), bool)
        cell = (key >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

    def misses(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words a record of ``n`` may miss as the larger and as the smaller of a pair: with at least p/q of all words shared,
        the larger shares p/q of its own, and the smaller 2p / (p + q) of its own."""
        p, q = self.share
        return n - -(-p * n // q), n - -(-2 * p * n // (p + q))

    def anchors(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Record number, anchor, role (whether the record may be the smaller one) and whether the anchor stayed hot, of each replica."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._each(words, offsets, out, None)
        return tuple(np.concatenate(x) for x in zip(*out))

    def suspects(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Anchors of the round after those in ``hot`` that may hold more than ``pair`` records, once per record."""
        out: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self._each(words, offsets, None, out)
        return np.concatenate(out)

    def _each(self, words: np.ndarray, offsets: np.ndarray, out: list | None, suspects: list | None) -> None:
        n = np.diff(offsets)
        rec = np.repeat(np.arange(len(n)), n)
        seen = self.sketch[(words.view(np.uint64) >> self.shift).astype(np.int64)]
        larger, smaller = (m - np.bincount(rec[seen == 0], minlength=len(n)) for m in self.misses(n))
        kept = (seen > 0) & (larger[rec] >= 0)
        if out is None:
            kept &= self._may_be_suspect(rec, seen, kept, larger, len(n))[rec]
        order = np.flatnonzero(kept)[np.lexsort((words[kept], seen[kept], rec[kept]))]
        rec, w, e = rec[order], words[order].view(np.uint64), np.exp2(seen[order] / STEPS)
        first = np.searchsorted(rec, np.arange(len(n)))
        position = np.arange(len(rec)) - first[rec]
        rare = e <= self.rare
        if out is not None:
            single = rare & (position <= larger[rec])
            out.append((rec[single], _mix(w[single]), position[single] <= smaller[rec[single]], np.zeros(int(single.sum()), bool)))
        n_rare = np.bincount(rec[rare], minlength=len(n))
        self._pairs(w, e, first + n_rare, np.bincount(rec, minlength=len(n)) - n_rare, larger - n_rare, smaller - n_rare, out, suspects)

    def _may_be_suspect(self, rec, seen, kept, larger, n: int) -> np.ndarray:
        """Whether a record has a pair within reach whose rarer word is over the bound; counted, not sorted."""
        e = np.exp2(seen / STEPS)
        rare, low, all_kept = (np.bincount(rec[kept & x], minlength=n) for x in (e <= self.rare, e <= self.pair, seen > 0))
        reach = np.minimum(larger - rare + CLASSES, all_kept - rare - 1)
        return (larger - rare >= 0) & (np.maximum(low - rare, 0) < reach)

    def _pairs(self, w, e, start, count, larger, smaller, out, suspects) -> None:
        """Anchors of two or more frequent words: ``start`` and ``count`` say where a record's frequent words are."""
        reach = np.where(larger >= 0, np.minimum(larger + CLASSES, count - 1), -1)
        if suspects is not None:  # the first word of a suspect is over the bound, and words are in rising order
            reach = np.where((reach > 0) & (e[np.minimum(start + np.maximum(reach - 1, 0), len(e) - 1)] > self.pair), reach, -1) if len(e) else reach
        kind = ((w >> np.uint64(20)) % np.uint64(CLASSES)).astype(np.int8)
        for r in np.flatnonzero(reach >= WIDE):
            for c in range(CLASSES):
                at = start[r] + np.flatnonzero(kind[start[r] : start[r] + reach[r] + 1] == c)
                i, j = np.triu_indices(len(at), 1)
                self._leaves(np.full(len(i), r), at[i], at[j], w, e, start, count, larger, smaller, out, suspects)
        narrow = np.where(reach < WIDE, reach, -1)
        for i in range(int(narrow.max(initial=-1))):
            for j in range(i + 1, int(narrow.max()) + 1):
                r = np.flatnonzero(narrow >= j)
                r = r[kind[start[r] + i] == kind[start[r] + j]]
                if len(r):
                    self._leaves(r, start[r] + i, start[r] + j, w, e, start, count, larger, smaller, out, suspects)

    def _leaves(self, r, a, b, w, e, start, count, larger, smaller, out, suspects) -> None:
        """Code words of two words, or where these are hot of them and each later word within reach, and so on.

        An anchor holds no more records than its rarest word, the first; only where that is too many can it be hot.
        """
        key, depth, may_grow = _mix(w[a], w[b]), 0, e[a] > self.pair
        while len(r):
            if suspects is not None and depth == len(self.hot):
                suspects.append(key[may_grow])
                return
            hot = may_grow & self._in(self.hot[depth] if depth < len(self.hot) else None, key)
            if out is not None:
                done = ~hot
                left = may_grow & self._in(self.left if depth == len(self.hot) else None, key)
                out.append((r[done], key[done], (smaller[r[done]] >= 0) & (b[done] - start[r[done]] <= smaller[r[done]] + CLASSES + depth), left[done]))
            r, key, k = r[hot], key[hot], b[hot] + 1
            grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(r):
                inside = k - start[r] <= np.minimum(larger[r] + CLASSES + 1 + depth, count[r] - 1)
                r, key, k = r[inside], key[inside], k[inside]
                grown.append((r, _mix(key, w[k]), k))
                k = k + 1
            if not grown:
                return
            r, key, b = (np.concatenate(x) for x in zip(*grown))
            depth, may_grow = depth + 1, np.ones(len(r), bool)


def fingerprints(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word set 117 parity bits in two numbers, of 53 and 64 bits."""
    low = PRINT_BITS[0]
    bit = words.view(np.uint64) % np.uint64(sum(PRINT_BITS))
    rec = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    np.bitwise_xor.at(out, ((bit >= low).astype(np.int64), rec), np.uint64(1) << np.where(bit >= low, bit - np.uint64(low), bit))
    return out[0], out[1]


def anchor_rows(classes: DataFrame, cover: AnchorCover) -> DataFrame:
    """``anchor, k1, info, more``: every class at every anchor within reach.

    ``info`` packs the first part of the fingerprint, whether the anchor stayed hot (1 bit), size (9 bits) and role (1 bit), ``more`` is its second part.
    """
    shared = classes.sparkSession.sparkContext.broadcast(cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column(2)
                offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
                r, anchor, smaller, left = shared.value.anchors(words, offsets)
                k1, n = batch.column(0).to_numpy(), np.minimum(batch.column(1).to_numpy(), SIZE_LIMIT).astype(np.uint64)
                first, second = fingerprints(words, offsets)
                info = (first << np.uint64(11) | n << np.uint64(1))[r] | left.astype(np.uint64) << np.uint64(10) | smaller.astype(np.uint64)
                columns = [anchor.view(np.int64), k1[r], info.view(np.int64), second.view(np.int64)[r]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "k1", "info", "more"])

    return classes.select("k1", "n", "words").mapInArrow(run, "anchor bigint, k1 bigint, info bigint, more bigint")


def hot_anchors(classes: DataFrame, cover: AnchorCover) -> np.ndarray | None:
    """Bits of the cells of the next round's anchors that hold more than ``cover.pair`` records; None where there are none."""
    shared = classes.sparkSession.sparkContext.broadcast(cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = [np.zeros(0, np.uint64)]
            for at in range(0, whole.num_rows, 2000):
                lists = whole.slice(at, 2000).column(0)
                found.append(shared.value.suspects(lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()))
            cell, n = np.unique((np.concatenate(found) >> np.uint64(64 - CELL_BITS)).astype(np.int32), return_counts=True)
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    counted = classes.select("words").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > cover.pair)
    hot = cell_levels(counted.select("cell", F.lit(1).alias("level")))
    shared.destroy()
    return np.packbits(hot, bitorder="little") if hot.any() else None


def count_hot(classes: DataFrame, cover: AnchorCover, min_words: int) -> None:
    """Count what may be hot, round by round, until nothing is or the rounds end."""
    if not (cover.sketch > STEPS * np.log2(max(cover.pair, 1))).any():
        return
    rounds = cover.rounds(min_words, cover.share)
    for depth in range(rounds + 1):
        hot = hot_anchors(classes, cover)
        if hot is None:
            return
        if depth == rounds:
            cover.left = hot
        else:
            cover.hot.append(hot)


def class_links(classes: DataFrame, rows: int, min_words: int = MIN_WORDS, rare: int = RARE_ROWS, share: tuple[int, int] = SHARE, pair: int | None = None) -> DataFrame:
    """``a1, a2, ra, b1, b2, rb``: every two different classes whose word sets share at least ``share`` of all their words."""
    p, q = share
    partitions = partitions_for(classes, rows)
    cover = AnchorCover(frequency_sketch(classes), rare, share, PAIR_ROWS if pair is None else pair)
    count_hot(classes, cover, min_words)
    at = anchor_rows(classes, cover)
    left = F.col("info").bitwiseAND(F.lit(1 << 10)) != 0
    near = block_meetings(at if cover.left is None else at.where(~left), partitions, p, q)
    if cover.left is not None:
        near = near.unionByName(meetings(at.where(left), p, q))
    ends = {s: classes.select(F.col("k1").alias(f"k{s}"), F.col("n").alias(f"n{s}"), *[F.col(c).alias(f"{c}{s}") for c in PARITY]) for s in "ab"}
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in PARITY), F.lit(0))
    near = near.join(ends["a"], "ka").join(ends["b"], "kb").where(apart * (p + q) <= (F.col("na") + F.col("nb")) * (q - p)).select("ka", "kb").distinct()
    near = materialize(near, "near-classes", partitions)
    side = {s: classes.select(F.col("k1").alias(f"k{s}"), F.col("k2").alias(f"k2{s}"), F.col("ref").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("words").alias(f"words{s}")) for s in "ab"}
    both = F.size(F.array_intersect("wordsa", "wordsb"))
    linked = near.join(side["a"], "ka").join(side["b"], "kb").where(both * q >= (F.col("na") + F.col("nb") - both) * p)
    return materialize(linked.select(F.col("ka").alias("a1"), F.col("k2a").alias("a2"), "ra", F.col("kb").alias("b1"), F.col("k2b").alias("b2"), "rb"), "class-links", partitions)


def compared(anchor: np.ndarray, k1: np.ndarray, info: np.ndarray, more: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes, as ``meetings`` gives them, of rows in order of anchor and size.

    The partners of a row as the smaller one are those after it at its anchor up to the greatest size the threshold allows; a row that may not
    be the smaller one only meets rows of its own size.
    """
    size = (info >> np.uint64(1) & np.uint64(SIZE_LIMIT)).astype(np.int32)
    role = (info & np.uint64(1)).astype(bool)
    run = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])]) * (2 * SIZE_LIMIT)
    upto = np.where(role, np.minimum(size * q // p, 2 * SIZE_LIMIT - 1), size)
    at = np.arange(len(size))
    many = np.searchsorted(run + size, run + upto, side="right") - at - 1
    ends, low = np.cumsum(many), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
        n = many[low:high]
        i = np.repeat(at[low:high], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        limit = (size[i] + size[j]) * (q - p)
        apart = np.bitwise_count((info[i] ^ info[j]) >> np.uint64(11)).astype(np.int32)
        ok = (apart * (p + q) <= limit) | (size[j] == SIZE_LIMIT)  # most pairs end here
        i, j, limit, apart = i[ok], j[ok], limit[ok], apart[ok]
        apart += np.bitwise_count(more[i] ^ more[j])
        even = size[i] == size[j]
        ok = ((apart * (p + q) <= limit) | (size[j] == SIZE_LIMIT)) & (role[i] | even & role[j]) & (k1[i] != k1[j])
        a, b, even = k1[i[ok]], k1[j[ok]], even[ok]
        yield np.where(even, np.minimum(a, b), a), np.where(even, np.maximum(a, b), b)
        low = high


def block_meetings(at: DataFrame, partitions: int, p: int, q: int) -> DataFrame:
    """``ka, kb`` as ``meetings`` gives them, for anchors of few records: rows stream by in order, a few anchors at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((columns[2].view(np.uint64) >> np.uint64(1) & np.uint64(SIZE_LIMIT), columns[0]))
            anchor, k1, info, more = (c[order] for c in columns)
            for a, b in compared(anchor, k1, info.view(np.uint64), more.view(np.uint64), p, q):
                if len(a):
                    once = np.unique(np.stack([a, b], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(once[:, 0].copy()), pa.array(once[:, 1].copy())], names=["ka", "kb"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) < ROWS_AT_ONCE:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
            held = [[c[cut:] for c in rows]]
            if cut:
                yield from pairs([c[:cut] for c in rows])
        if held:
            yield from pairs([np.concatenate(c) for c in zip(*held)])

    return at.repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "ka bigint, kb bigint").distinct()


def meetings(at: DataFrame, p: int, q: int) -> DataFrame:
    """``ka, kb``: classes that meet at an anchor, the smaller first, and whose sizes and fingerprints allow the threshold.

    Both sides of the join are the same rows with conditions across sides only, so they are shuffled once.
    """
    x, y = at.alias("x"), at.alias("y")
    size = {s: F.shiftrightunsigned(f"{s}.info", 1).bitwiseAND(F.lit(SIZE_LIMIT)) for s in "xy"}
    as_smaller = F.when(F.col("x.info").bitwiseAND(F.lit(1)) == 1, size["x"]).otherwise(F.lit(SIZE_LIMIT + 1))
    apart = F.bit_count(F.shiftrightunsigned(F.col("x.info").bitwiseXOR(F.col("y.info")), 11)) + F.bit_count(F.col("x.more").bitwiseXOR(F.col("y.more")))
    meet = (
        (F.col("x.anchor") == F.col("y.anchor"))
        & ((as_smaller < size["y"]) | ((as_smaller == size["y"]) & (F.col("x.k1") != F.col("y.k1"))))
        & (size["x"] * q >= size["y"] * p)
        & ((size["y"] == SIZE_LIMIT) | (apart * (p + q) <= (size["x"] + size["y"]) * (q - p)))
    )
    found = x.join(y, meet).select(F.col("x.k1").alias("ka"), F.col("y.k1").alias("kb"), (size["x"] == size["y"]).alias("even"))
    low, high = F.least("ka", "kb"), F.greatest("ka", "kb")
    return found.select(F.when(F.col("even"), low).otherwise(F.col("ka")).alias("ka"), F.when(F.col("even"), high).otherwise(F.col("kb")).alias("kb")).distinct()


def near_duplicate_pairs(records: DataFrame, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, rare: int = RARE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ref_a, ref_b`` of every two records that share at least ``share`` of all their words, equal ones included."""
    classes, others, rows = word_classes(records, min_words)
    links, key = class_links(classes, rows, min_words, rare, share), ["k1", "k2"]
    hot = hot_groups(others, key, hot_rows)
    for end in ("a", "b"):
        names = {f"{end}1": "k1", f"{end}2": "k2"}
        more = spread_join(others, links.withColumnsRenamed(names), key, "ref", hot, rows_per_salt=hot_rows).where(F.col("ref") != F.col(f"r{end}"))
        more = more.drop(f"r{end}").withColumnsRenamed({"k1": f"{end}1", "k2": f"{end}2", "ref": f"r{end}"})
        links = links.unionByName(more)
    across = links.select(F.least("ra", "rb").alias("ref_a"), F.greatest("ra", "rb").alias("ref_b"))
    firsts = classes.select(*key, "ref").join(others.select(*key).distinct(), key, "left_semi")
    members = materialize(firsts.unionByName(others).distinct(), "members-of-several")
    within = pairs_in_groups(members, key, "ref", hot_rows=hot_rows).select(F.col("id_a").alias("ref_a"), F.col("id_b").alias("ref_b"))
    return across.unionByName(within)


def near_duplicate_degrees(records: DataFrame, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per record in scope: ``ref, class_id`` (smallest ref with equal words), ``n_equal`` and ``n_near`` classes linked to it."""
    classes, others, rows = word_classes(records, min_words)
    links, key = class_links(classes, rows, min_words, RARE_ROWS, share), ["k1", "k2"]
    ends = links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionAll(links.select(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    near = ends.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_near"))
    members = materialize(classes.select(*key, "ref").unionByName(others).distinct(), "members")
    own = members.groupBy("k1", "k2").agg(F.min("ref").alias("class_id"), F.count(F.lit(1)).alias("n_equal"))
    hot = hot_groups(others, key, hot_rows)
    return spread_join(members, own.join(near, key, "left"), key, "ref", hot, rows_per_salt=hot_rows).select("ref", "class_id", "n_equal", F.coalesce("n_near", F.lit(0)).alias("n_near"))
