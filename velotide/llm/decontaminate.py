"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

A window of a document is compared with an item of as many words; a document of fewer words than the
item is one window. Both are multisets of shingles of
five words; their similarity is the sum of the smaller counts over the sum of the larger ones.

1. Where windows are laid: a bit map of fixed size says which shingles items of a length may have. A window of w
   shingles and an item of n that are similar to s share at least s / (1 + s) * (w + n) of them, so one with fewer known
   shingles cannot match.
2. Windows and items get a fingerprint of 64 bits: a bit is set if it is set in over half of the shingle hashes, repeats
   counted. It is cut into 8 blocks. Two fingerprints that differ in 8 * (f + 1) - 1 bits at most differ in f at most in
   some block, so an item is listed under all values of each block within f flips, and a window looks up its own:
   every pair within that radius meets.
3. Pairs within the radius are verified by their exact similarity.

The radius is 4.5 standard deviations beyond the bits in which texts of the asked similarity differ on average: 23
bits, two flips, for 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import all_shingles, encode_words, free_name, in_short_batches, scramble, shingle_hashes, stage, text_slices, word_hashes

SHINGLE = 5
SIMILAR = 0.8
MAP_BITS = 24  # 16 million bits, 2 MB, whatever the number of items


BITS, BLOCKS = 64, 8
WIDTH = BITS // BLOCKS
DEVIATIONS = 4.5
PART_BITS = 20  # bits of the map that one row carries to the driver


def flips(similar: float) -> int:
    """Flips per block for texts of this similarity. Their counts have a cosine of about 2s / (1 + s), and a bit
    differs with the share that the angle has of a half turn."""
    share = np.arccos(2 * similar / (1 + similar)) / np.pi
    reach = BITS * share + DEVIATIONS * np.sqrt(BITS * share * (1 - share))
    return int(min(WIDTH, max(0, np.ceil((reach + 1) / BLOCKS) - 1)))


def radius(similar: float) -> int:
    """Differing bits up to which every pair of fingerprints meets."""
    return BLOCKS * (flips(similar) + 1) - 1


def fingerprint(shingles: np.ndarray) -> int:
    """64 bits as a signed long, of shingle hashes with their repeats."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over_half = bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)
    return int(np.packbits(over_half, bitorder="little").view("<i8")[0])


def _blocks(fp: Column) -> Column:
    """Pairs of block and value."""
    cut = [F.shiftrightunsigned(fp, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for k in range(BLOCKS)]
    return F.array(*(F.struct(F.lit(k).alias("block"), v.alias("value")) for k, v in enumerate(cut)))


def _masks(most: int) -> list[int]:
    """All values of a block with ``most`` bits or fewer."""
    return [sum(1 << p for p in places) for size in range(most + 1) for places in combinations(range(WIDTH), size)]


def _least(size: int, n: int, similar: float) -> int:
    """How many of ``size`` and ``n`` shingles two similar texts share at least."""
    return max(1, int(np.ceil(similar / (1 + similar) * (size + n) - 1e-9)))


ITEM = "item_id long, n int, fp long, shingles array<long>, bits array<int>"


def _bits(shingles: np.ndarray, n: int) -> np.ndarray:
    """Places in the bit map of shingles of items of ``n`` words; of any item with ``n`` = 0."""
    mixed = scramble(shingles + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))
    return (mixed & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        counts, parts = all_shingles(batch["text"], SHINGLE)
        full = [k for k, p in enumerate(parts) if len(p)]
        places = [np.concatenate((_bits(parts[k], 0), _bits(parts[k], int(counts[k])))) for k in full]
        yield pa.record_batch(
            [
                batch["item_id"].take(pa.array(full, pa.int64())),
                pa.array(counts[full].astype(np.int32)),
                pa.array([fingerprint(parts[k]) for k in full], pa.int64()),
                pa.array([parts[k].view(np.int64) for k in full], pa.list_(pa.int64())),
                pa.array(places, pa.list_(pa.int32())),
            ],
            ["item_id", "n", "fp", "shingles", "bits"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        bits = batch["bit"].to_numpy(zero_copy_only=False).astype(np.int64)
        for part in np.unique(bits >> PART_BITS).tolist():
            flags = parts.setdefault(part, np.zeros(1 << PART_BITS, bool))
            flags[bits[bits >> PART_BITS == part] & ((1 << PART_BITS) - 1)] = True
    for part, flags in parts.items():
        yield pa.record_batch([pa.array([part]), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["part", "bits"])


def _bit_map(items: DataFrame) -> np.ndarray:
    """The map of all items' shingles, packed; it comes to the driver as 16 rows of bytes at most."""
    places = items.select(F.explode("bits").alias("bit")).distinct()
    dealt = places.repartition(F.shiftright("bit", PART_BITS)).mapInArrow(_packed, "part long, bits binary")
    packed = np.zeros((1 << (MAP_BITS - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for row in dealt.collect():
        packed[row.part] |= np.frombuffer(row.bits, np.uint8)
    return packed.ravel()


def _windows(bit_map: np.ndarray, lengths: list[int], similar: float):

    def of_text(hits: np.ndarray, shingles: np.ndarray, n_words: int):
        """Begin and length of the windows that may match, and their shingles."""
        places = np.flatnonzero(hits)
        for n in lengths:
            size = max(1, n - SHINGLE + 1)
            # A text of fewer words than the item is one window.
            laid = min(size, len(shingles))
            shared = _least(laid, size, similar)
            if (min(n, n_words) < SHINGLE and n != n_words) or shared > min(laid, len(places)):
                continue
            sums = np.zeros(len(shingles) + 1, np.int64)
            sums[1 + places] = bit_map[_bits(shingles[places], n)]
            sums = np.cumsum(sums)
            inside = sums[laid:] - sums[:-laid]
            for begin in np.flatnonzero(inside >= shared).tolist():
                yield begin, n, shingles[begin : begin + laid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            counts, codes, words = encode_words(batch["text"])
            hashes = word_hashes(words)
            owner, _, mixed = shingle_hashes(counts, codes, hashes, SHINGLE)
            known = bit_map[_bits(mixed, 0)]
            some = np.unique(owner[known])
            begin = np.searchsorted(owner, np.arange(len(counts) + 1))
            todo = {int(k): (known[begin[k] : begin[k + 1]], mixed[begin[k] : begin[k + 1]]) for k in some}
            short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
            if len(short) and min(lengths, default=SHINGLE) < SHINGLE:
                _, parts = all_shingles(batch["text"].take(pa.array(short)), SHINGLE)
                for k, part in zip(short.tolist(), parts, strict=True):
                    todo[k] = (bit_map[_bits(part, 0)], part)
            out = [], [], [], [], []
            ids = batch["doc_id"]
            for k in sorted(todo):
                for begins, n, part in of_text(*todo[k], int(counts[k])):
                    row = (ids[k].as_py(), begins, n, fingerprint(part), part.view(np.int64).tolist())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "word", "n", "fp", "shingles"]
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of the two lists of shingles of each row."""
    for batch in batches:
        values, lengths = [], []
        for n, a, b in zip(batch["n"].to_pylist(), batch["shingles"].to_pylist(), batch["item_shingles"].to_pylist(), strict=True):
            lengths.append(n if n < SHINGLE else len(a) + SHINGLE - 1)
            seen, place = np.unique(np.array(a + b, np.int64), return_inverse=True)
            of_a = np.bincount(place[: len(a)], minlength=len(seen))
            of_b = np.bincount(place[len(a) :], minlength=len(seen))
            values.append(float(np.minimum(of_a, of_b).sum() / np.maximum(of_a, of_b).sum()))
        yield pa.record_batch(
            [batch["doc_id"], batch["item_id"], batch["word"], pa.array(lengths, pa.int32()), pa.array(values, pa.float64())],
            ["doc_id", "item_id", "word", "n", "similarity"],
        )


@in_short_batches
def contaminated(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id``, ``item_id``, ``word`` (place of the first word), ``n_words`` (of the window), ``similarity`` for
    every item (``item_id``, ``text``) of which a window of a row of ``docs`` (``doc_id``, ``text``) has
    the shingles to ``similar`` (0.8) or more.

    Of several windows that match one item the most similar counts, then the first. Words are lower-cased.
    Null and blank texts and items match nothing; an item or a text of fewer than five words is one
    shingle and matches only whole. Rows that repeat an id are one document or item. A text without
    an id is reported with a null ``doc_id``, an item without one with a null ``item_id``.

    Pairs of that similarity whose fingerprints differ in more bits than ``radius(similar)`` are missed unless a
    neighbouring window meets the item: none of 3,000 planted ones at 0.80 to 0.85 (tests/llm).

    The table of items is never broadcast, only the bit map of its shingles and the distinct lengths
    of items, which the longest item bounds. With many items the map fills up, which costs more windows but
    loses none; the lookup of blocks is a join that Spark plans by size.
    """
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_batches, ITEM)
    known = stage(known.withColumn("item_key", F.xxhash64("shingles")), "items")
    lengths = [r.n for r in known.select("n").distinct().orderBy("n").collect()]
    shared = spark.sparkContext.broadcast(_bit_map(known))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _windows(np.unpackbits(shared.value).view(bool), lengths, similar)(batches)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = plain.mapInArrow(lay, "doc_id long, word int, n int, fp long, shingles array<long>")
    windows = stage(windows.distinct().withColumn("key", F.xxhash64("shingles")), "windows")
    looked = windows.select("n", "key", "fp").distinct().select("n", "key", "fp", F.inline(_blocks(F.col("fp"))))
    listed = known.select("item_id", "n", "item_key", F.col("fp").alias("item_fp")).distinct()
    listed = listed.select("*", F.inline(_blocks(F.col("item_fp"))))
    mask = F.explode(F.array(*map(F.lit, _masks(flips(similar)))))
    listed = listed.withColumn("mask", mask).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius(similar)
    near = looked.join(listed, ["n", "block", "value"]).where(within).select("n", "key", "item_id", "item_key").distinct()
    texts = known.select("n", "item_key", F.col("shingles").alias("item_shingles")).dropDuplicates(["n", "item_key"])
    both = windows.join(near, ["n", "key"]).select("doc_id", "word", "n", "item_id", "item_key", "shingles")
    pairs = both.join(texts, ["n", "item_key"]).select("doc_id", "item_id", "word", "n", "shingles", "item_shingles")
    checked = pairs.mapInArrow(_compare, "doc_id long, item_id long, word int, n int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("word")).alias("w"), "n"))
    found = checked.where(F.col("similarity") >= similar).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select(
        "doc_id", "item_id", (-F.col("b.w")).cast("long").alias("word"), F.col("b.n").cast("long").alias("n_words"), "b.similarity"
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those documents that contain an item, all columns as they are.
    Rows that repeat an id go together; rows without an id are kept and not compared."""
    named = docs.where("doc_id IS NOT NULL")
    key = free_name(docs, "_bad")
    bad = contaminated(named, items).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == F.col(key), "left_anti")
