"""Near duplicates by exact similarity of their five-word shingles, joined on rare shingles.

The similarity of two texts is the number of distinct shingles in both over the number in either. If it
is at least s, then the first n - ceil(s * n) + 1 of the n shingles of each, in any order that is the same for
all texts, have one in common (prefix filter), so that no pair is missed. The order puts rare shingles
first, as told by a map of counters that grows with the corpus up to 64 MB; a full map costs comparisons and loses no pair.

Shingles are never stored. A text's set is named by a 64-bit hash; passes over the texts make the sets anew and send on only
what a bitmap of bounded size lets through: prefix shingles that two different sets have, then the sets that are to
be compared. A full bitmap lets more through and loses nothing.

Texts that share such a shingle are first compared with one of them, that whose rare shingles are shared the most and which is
therefore edited least. That joins a crowd of copies at a cost that grows with its members, not its pairs. Those still apart
are compared with up to sixteen, and then all pairs that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm import simhash
from velotide.llm.common import all_shingles, free_name, in_short_batches, scramble, text_slices
from velotide.llm.common import stage_and_release as stage
from velotide.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
BITMAP_BITS = 27  # 16 MB at most
BITMAP_PART = 20
SEEN = 200_000  # sets that a task remembers, so that copies among its texts are sent once
PER_COUNTER = 8  # shingles to a counter, while the map is no larger than
MAP_BITS = 26  # 64 MB of counters of one byte
PART_BITS = 16  # counters that one row carries to the driver
CENTERS = 16  # sets that others with the same shingle are compared with, if one does not join them


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Batches with the shingle set of every text, in order, and the hash that names it."""
    for batch in text_slices(batches, "text"):
        sets = [np.unique(part) for part in all_shingles(batch["text"], SHINGLE)[1]]
        names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
        yield batch, sets, names


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets, names in _sets(batches):
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.record_batch([batch["doc_id"], pa.array(names.view(np.int64)), sizes], ["doc_id", "key", "n"])


def _first_seen(names: np.ndarray, seen: set) -> list[int]:
    """Places of the names that this task has not met yet, as far as it remembers."""
    fresh = []
    for place, name in enumerate(names.tolist()):
        if name not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            fresh.append(place)
    return fresh


class Bitmap:
    """Which values may be in a column of longs."""

    def __init__(self, values: DataFrame, column: str):
        spark = values.sparkSession
        self.bits = int(min(BITMAP_BITS, max(BITMAP_PART, np.ceil(np.log2(values.count() + 1)) + 5)))
        shift, low = 64 - self.bits, (1 << BITMAP_PART) - 1

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.unique(scramble(batch[0].to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(shift))
                found = found.astype(np.int64)
                yield pa.record_batch([pa.array(found >> BITMAP_PART), pa.array(found & low)], ["part", "slot"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                part, slot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for k in np.unique(part).tolist():
                    parts.setdefault(k, np.zeros(1 << BITMAP_PART, bool))[slot[part == k]] = True
            for k, flags in parts.items():
                yield pa.record_batch([pa.array([k]), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["part", "bits"])

        dealt = values.select(column).mapInArrow(slots, "part long, slot long").repartition("part")
        full = np.zeros((1 << (self.bits - BITMAP_PART), 1 << (BITMAP_PART - 3)), np.uint8)
        for row in dealt.mapInArrow(packed, "part long, bits binary").collect():
            full[row.part] = np.frombuffer(row.bits, np.uint8)
        self.shared = spark.sparkContext.broadcast(full.ravel())

    def test(self):
        """A function of an array of 64-bit numbers, for use in tasks."""
        shared, shift = self.shared, np.uint64(64 - self.bits)

        def may_hold(values: np.ndarray) -> np.ndarray:
            slot = (scramble(values) >> shift).astype(np.int64)
            return (shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0

        return may_hold


def _counters(shingles: np.ndarray, size: int) -> np.ndarray:
    return (scramble(shingles) & np.uint64(size - 1)).astype(np.int64)


def _count_batches(size: int):
    """Whole parts of a task's map as bytes: rows of single counters would take a multiple of that. A counter stays at 255
    within a task, which is beyond rare wherever it happens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint8)
        for _, sets, _ in _sets(batches):
            places, many = np.unique(_counters(np.concatenate(sets), size), return_counts=True)
            counts[places] = np.minimum(counts[places] + many, 255)
        for part, values in enumerate(counts.reshape(-1, 1 << PART_BITS)):
            if values.any():
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["part", "counts"])

    return run


def _power_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal parts, as twice the logarithm."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"], strict=True):
            parts.setdefault(part, np.zeros(1 << PART_BITS, np.int64))
            parts[part] += np.frombuffer(counts.as_buffer(), np.uint8)
    for part, counts in parts.items():
        powers = np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.int8)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([powers.tobytes()], pa.binary())], ["part", "powers"])


def _prefix_batches(shared, similar: float, keep=None):
    """(token, key, place in the order) for the shingles of each set that a similar one must share in part; of these,
    those that ``keep`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        for _, sets, names in _sets(batches):
            tokens, keys, places = [], [], []
            for place in _first_seen(names, seen):
                own = sets[place]
                if not len(own):
                    continue
                first = len(own) - int(np.ceil(similar * len(own) - 1e-9)) + 1
                chosen = own[np.lexsort((own, common[_counters(own, len(common))]))[:first]]
                at = np.arange(len(chosen)) if keep is None else np.flatnonzero(keep(chosen))
                chosen = chosen[at]
                places.append(at)
                tokens.append(chosen.view(np.int64))
                keys.append(np.full(len(chosen), names[place]).view(np.int64))
            if tokens:
                columns = [pa.array(np.concatenate(c)) for c in (tokens, keys, places)]
                yield pa.record_batch(columns, ["token", "key", "place"])

    return run


def _common(texts: DataFrame, sizes: DataFrame) -> np.ndarray:
    """Twice the logarithm of every counter's shingles. The map grows with the corpus, so that counters tell
    rare shingles from common ones."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = min(MAP_BITS, max(PART_BITS, int(total / PER_COUNTER).bit_length()))
    counted = texts.mapInArrow(_count_batches(1 << bits), "part int, counts binary").repartition("part")
    common = np.zeros((1 << (bits - PART_BITS), 1 << PART_BITS), np.int8)
    for row in counted.mapInArrow(_power_batches, "part int, powers binary").collect():
        common[row.part] = np.frombuffer(row.powers, np.int8)
    return common.ravel()


def _met(texts: DataFrame, sizes: DataFrame, similar: float) -> DataFrame:
    """``token``, ``key``, ``place`` for the prefix shingles that different sets have."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, sizes))
    schema = "token long, key long, place long"
    every = texts.mapInArrow(_prefix_batches(shared, similar), schema)
    several = every.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    several = stage(several.select("token"), "tokens")
    some = texts.mapInArrow(_prefix_batches(shared, similar, Bitmap(several, "token").test()), schema).distinct()
    return stage(some.join(several, "token"), "met")


def _sizes_allow(n: Column, m: Column, similar: float) -> Column:
    return F.least(n, m) >= similar * F.greatest(n, m) - 1e-9


def _sketch(shingles: np.ndarray) -> bytes:
    """A bit for every shingle, at its hash modulo the number of bits: a power of two, twice the shingles or more."""
    bits = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(scramble(shingles) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _most_shared(x: bytes, n: int, y: bytes, m: int) -> int:
    """Shingles that two sets of ``n`` and ``m`` can share at most: each bit that only one has set stands for one or more
    that the other does not have. The longer sketch is folded to the length of the other."""
    size = min(len(x), len(y))
    a, b = (np.bitwise_or.reduce(np.frombuffer(v, np.uint8).reshape(-1, size), axis=0) for v in (x, y))
    only_a, only_b = (int(np.bitwise_count(v).sum()) for v in (a & ~b, b & ~a))
    return min(n - only_a, m - only_b)


def _may_be_alike(similar: float):
    """The pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("x", "n_a", "y", "n_b"))
            keep = []
            for x, n, y, m in zip(*columns, strict=True):
                shared = _most_shared(x, n, y, m)
                keep.append(shared >= similar * (n + m - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _chosen_sets(keep, value, kind: pa.DataType):
    """(key, ``value`` of the set) for the sets whose name ``keep`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for _, sets, names in _sets(batches):
            hits = keep(names)
            due = [k for k in _first_seen(np.where(hits, names, np.uint64(0)), seen) if hits[k]]
            values = pa.array([value(sets[k]) for k in due], kind)
            yield pa.record_batch([pa.array(names[due].view(np.int64)), values], ["key", "value"])

    return run


def _of_keys(keys: DataFrame, texts: DataFrame, value, sql_type: str, kind: pa.DataType) -> DataFrame:
    """``key`` and what ``value`` makes of its set, for the distinct ``keys``. A pass over the texts makes the sets anew."""
    found = texts.mapInArrow(_chosen_sets(Bitmap(keys, "key").test(), value, kind), f"key long, value {sql_type}")
    return stage(found.join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def _of_pairs(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` with ``x`` and ``y``, the values of their ends."""
    of_a = values.select(F.col("key").alias("a"), F.col("value").alias("x"))
    of_b = values.select(F.col("key").alias("b"), F.col("value").alias("y"))
    return pairs.join(of_a, "a").join(of_b, "b")


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """The pairs of keys ``a``, ``b`` (of ``n_a``, ``n_b`` shingles) whose sets are similar enough.

    Sketches, a thirty-second of the sets or less than twice that, go with every pair first and drop those that cannot be
    similar; whole sets then go only with pairs that are nearly all links.
    """
    pairs = stage(pairs.distinct(), "candidates")
    sketched = _of_pairs(pairs, sketches)
    close = stage(sketched.mapInArrow(_may_be_alike(similar), "a long, b long"), "close")
    keys = stage(close.select(F.col("a").alias("key")).union(close.select("b")).distinct(), "compared")
    whole = _of_pairs(close, _of_keys(keys, texts, lambda s: s.view(np.int64), "array<long>", pa.list_(pa.int64())))
    both = F.size(F.array_intersect("x", "y"))
    alike = both / (F.size("x") + F.size("y") - both) >= similar
    return stage(whole.where(alike).select("a", "b"), "alike")


def _pairs(left: DataFrame, right: DataFrame, similar: float, *more: Column) -> DataFrame:
    """Pairs of keys of ``left`` and ``right``, and the sizes of their sets, that have a shingle in common which can be the
    first: all that two sets share is still to come in both there, and where less is left than similar sets share, it is not
    the first."""
    a, b = left.alias("a"), right.alias("b")
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    joined = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & _sizes_allow(F.col("a.n"), F.col("b.n"), similar)
        & (rest >= similar / (1 + similar) * (F.col("a.n") + F.col("b.n")) - 1e-9)
        & reduce(and_, more),
    )
    ends = (F.struct(F.col(f"{end}.key").alias("key"), F.col(f"{end}.n").alias("n")) for end in "ab")
    ends = joined.select(F.array_sort(F.array(*ends)).alias("e"))
    return ends.select(*(F.col("e")[k][c].alias(name) for k, c, name in
                         ((0, "key", "a"), (0, "n", "n_a"), (1, "key", "b"), (1, "n", "n_b"))))


def _centers(members: DataFrame, many: int) -> DataFrame:
    """The rows of the ``many`` or fewer members of every token whose prefixes are shared the most. Edits make shingles that
    nobody else has, so these are edited least and similar to the most others."""
    best = F.max_by(F.struct("key", "n", "place", "label"), F.struct("met", "key")).alias("best")
    deal = F.pmod(F.xxhash64("key"), F.lit(many)).alias("deal")
    return members.groupBy("token", deal).agg(best).select("token", "best.*")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their ``label``, of the tokens whose members are in different components."""
    named = members.drop("label").join(labels, F.col("key") == F.col("node"), "left").drop("node")
    named = stage(named.withColumn("label", F.coalesce("label", "key")), "named")
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return stage(named.join(mixed.select("token"), "token", "left_semi"), "apart")


def _labels(texts: DataFrame, sizes: DataFrame, similar: float) -> DataFrame:
    """``node``, ``label`` of all keys that are linked with others."""
    met = _met(texts, sizes, similar)
    often = met.groupBy("key").agg(F.count("*").alias("often")).join(sizes, "key")
    often = stage(often.select("key", "n", (F.col("often") / F.col("n")).alias("met")), "often")
    members = stage(met.join(often, "key").withColumn("label", F.col("key")), "members")
    sketches = _of_keys(often.select("key"), texts, _sketch, "binary", pa.binary())

    def linked(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
        pairs = _pairs(left, right, similar, F.col("a.label") != F.col("b.label"), *more)
        return _verified(pairs, texts, sketches, similar)

    labels = stage(components(linked(members, stage(_centers(members, 1), "centers"))), "labels")
    # What one star a token has not joined: more centers, and then the pairs of which neither was a center there.
    for last in (False, True):
        members = _apart(members, labels)
        if last:
            more = linked(members, members, F.col("a.key") < F.col("b.key"))
        else:
            centers = stage(_centers(members, CENTERS), "centers")
            more = linked(members, centers)
            members = members.join(centers, ["token", "key"], "left_anti")
        if not more.isEmpty():
            known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = stage(components(known.union(more)), "labels")
    return labels


@in_short_batches
def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id``, ``component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents link if the sets of their five-word shingles are similar to ``similar`` (0.8) or more;
    ``component_id`` is the smallest ``doc_id`` that can be reached. Words are lower-cased. A text of fewer
    than five words is one shingle; null and blank texts have none and equal each other.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = stage(plain.mapInArrow(_key_batches, "doc_id long, key long, n long"), "keys")
    distinct = stage(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")), "distinct")
    labels = _labels(plain.select("text"), distinct.select("key", "n"), similar)
    known = distinct.join(labels, distinct["key"] == labels["node"], "left").select(
        "key", "least", F.coalesce("label", "key").alias("label")
    )
    known = stage(known, "labelled")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of_key = known.join(least, "label").select("key", "component_id")
    return keys.select("doc_id", "key").join(of_key, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of one document of each group of near duplicates, that with the smallest id.

    Groups are those of SimHash (four words, four bits) and of the exact similarity, united: what either
    links stays linked, over any number of steps. All columns are kept as they are. Rows that repeat an id
    are one document and stay or go together. Rows without an id cannot stand for a group: they are kept
    and compared with nothing.
    """
    named = docs.where("doc_id IS NOT NULL")
    plain = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links = [
        groups.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        for groups in (simhash.near_duplicates(plain), near_duplicates(plain, similar))
    ]
    key = free_name(docs, "_copy")
    copies = components(links[0].union(links[1])).where("node <> label").select(F.col("node").alias(key))
    kept = named.join(copies, named["doc_id"].cast("long") == F.col(key), "left_anti")
    return kept.unionByName(docs.where("doc_id IS NULL"))
