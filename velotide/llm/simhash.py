"""Near duplicates by 64-bit SimHash, compared at the anchor points of a covering code.

A fingerprint is cut into two halves of 32 bits. If two fingerprints differ in 4 bits at most, then
their low halves differ in 2 at most or their high halves in 1 at most. In each half the anchors
are the words of the Hamming code of 31 bits, each with either value of the last bit: every half
lies within 1 bit of exactly one anchor that shares its last bit (the code is perfect). A
fingerprint has its home at that anchor and visits every anchor within 1 + 2 bits in the low half,
1 + 1 in the high half. By the triangle inequality two linked fingerprints meet at the home of each
of them. There are 2^27 anchors in each half, so a cell stays small until there are about that many
distinct fingerprints; a fingerprint pays about 190 visits, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import free_name, in_short_batches, stage, text_slices
from velotide.llm.components import components

SHINGLE = 4
SEED = 42
THRESHOLD = 4  # bits; the halves below are made for it
LOW_VISIT, HIGH_VISIT = 3, 2  # covering radius 1 + the bits that a half may differ in
HOMES_PER_GROUP, VISITS_PER_GROUP = 256, 4096  # crowded cells are cut into blocks of this size
COMPARED, JOINED = 1 << 20, 1 << 16  # comparisons, and links found, that a task holds at once
LOW32 = (1 << 32) - 1


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingle hashes. No words: 0."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    begin, end = starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin, end)), "<u8", len(begin))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        texts = pc.fill_null(batch["text"], "").cast(pa.binary()).to_pylist()
        prints = np.fromiter(map(fingerprint_of, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.record_batch([batch["doc_id"], pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row; null texts count as empty."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _flips(within: int) -> list[tuple[int, int]]:
    """(syndrome, mask): the masks of at most ``within`` bits that lead from a half with this
    syndrome to an anchor. 32 syndromes and fewer than 6,000 rows, whatever the data."""
    rows = []
    for size in range(within + 1):
        for places in combinations(range(1, 32), size):
            syndrome, mask = 0, 0
            for p in places:
                syndrome, mask = syndrome ^ p, mask | 1 << (p - 1)
            rows.append((syndrome, mask))
            if size < within:
                rows.append((syndrome, mask | 1 << 31))
    return rows


def _syndrome(half: Column) -> Column:
    total = F.lit(0)
    for k in range(5):
        covered = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        total = total + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(covered))) % 2, k)
    return total


def _halves(prints: DataFrame) -> DataFrame:
    low, high = F.col("fp").bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned("fp", 32)
    sides = F.array(*(F.struct(F.lit(side).alias("side"), half.alias("half"))
                      for side, half in ((0, low), (1, high))))
    cut = prints.select("fp", F.explode(sides).alias("s")).select("fp", "s.side", "s.half")
    return cut.withColumn("syndrome", _syndrome(F.col("half")))


def _cell(anchor: Column) -> Column:
    return (F.shiftleft(F.col("side").cast("long"), 32) + anchor).alias("cell")


def _pairs_of_runs(begin: np.ndarray, homes: np.ndarray, end: np.ndarray):
    """Index pairs (home, visit) of sorted runs: rows begin..begin+homes are homes, the rest visits."""
    visits = end - begin - homes
    visit_run = np.repeat(np.arange(len(begin)), visits)
    first = np.cumsum(visits) - visits
    visit = np.arange(len(visit_run)) - first[visit_run] + (begin + homes)[visit_run]
    each = homes[visit_run]
    home_first = np.cumsum(each) - each
    home = np.arange(each.sum()) - np.repeat(home_first, each) + np.repeat(begin[visit_run], each)
    return home, np.repeat(visit, each)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare homes with visits in every run of equal (cell, part), rows sorted so that homes come
    first. Of the links found, each task sends on a spanning forest: no link between two different
    components is lost, and a crowd of copies costs a line per member, not per pair."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def links(rows: np.ndarray, last: bool):
        """Compare the complete runs of ``rows``; give back the rest."""
        cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
        begin = np.concatenate(([0], cut))
        end = np.concatenate((cut, [len(rows)]))
        rest = rows[len(rows) :]
        if not last:
            rest, begin, end = rows[begin[-1] :], begin[:-1], end[:-1]
        found = [], []
        if len(begin):
            homes = np.add.reduceat(1 - rows[: end[-1], 2], begin)
            work = np.cumsum(homes * (end - begin - homes))
            at = 0
            while at < len(begin):  # blocks of runs, or one run, which crowded cells are cut to
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + COMPARED)))
                h, v = _pairs_of_runs(begin[at:to], homes[at:to], end[at:to])
                a, b = rows[h, 3], rows[v, 3]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD
                pairs = np.unique(np.stack((a[near], b[near]), 1)[a[near] != b[near]], axis=0)
                for x, y in chain.from_iterable(pairs[k : k + JOINED].tolist() for k in range(0, len(pairs), JOINED)):
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
                        found[0].append(x)
                        found[1].append(y)
                at = to
        return rest, pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    rest = np.zeros((0, 4), np.int64)
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.int64)
        if len(new):
            rest, out = links(np.concatenate((rest, new)), last=False)
            yield out
    if len(rest):
        yield links(rest, last=True)[1]


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct ``fp`` of ``prints`` within 4 bits of each other into
    the same components as all such pairs would."""
    spark = prints.sparkSession
    halves = _halves(prints)
    home_anchor = F.when(F.col("syndrome") == 0, F.col("half")).otherwise(
        F.col("half").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("syndrome") - 1))
    )
    homes = halves.select(_cell(home_anchor), "fp")
    cells = homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("only"))
    flips = [(0, s, m) for s, m in _flips(LOW_VISIT)] + [(1, s, m) for s, m in _flips(HIGH_VISIT)]
    flips = spark.createDataFrame(flips, "side int, syndrome int, mask long")
    visits = halves.join(F.broadcast(flips), ["side", "syndrome"]).select(
        _cell(F.col("half").bitwiseXOR(F.col("mask"))), "fp"
    )
    # Nearly all cells on the way are nobody's home, or only the visitor's own.
    met = stage(
        visits.join(cells, "cell").where("n > 1 OR fp <> only").select("cell", "fp", "n"), "visits"
    )
    sizes = met.groupBy("cell").agg(
        F.ceil(F.max("n") / HOMES_PER_GROUP).alias("rows"),
        F.ceil(F.count("*") / VISITS_PER_GROUP).alias("cols"),
    )
    part = F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")
    hashed = F.xxhash64("fp")
    home_rows = homes.join(sizes, "cell").select(
        "cell", "fp", F.pmod(hashed, "rows").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("col")
    )
    visit_rows = met.join(sizes, "cell").select(
        "cell", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"), F.pmod(hashed, "cols").alias("col")
    )
    rows = home_rows.select("cell", part.alias("part"), F.lit(0).cast("long").alias("visit"), "fp").union(
        visit_rows.select("cell", part.alias("part"), F.lit(1).cast("long").alias("visit"), "fp")
    )
    dealt = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "visit")
    return dealt.mapInArrow(_link_batches, "a long, b long")


@in_short_batches
def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents link if their fingerprints differ in 4 bits at most; ``component_id`` is the smallest
    ``doc_id`` that can be reached. Null and blank texts have fingerprint 0 and link like others.
    Repeated rows give repeated rows. A row without an id takes part in linking; ``component_id`` is
    null only if no row of the component has an id. An empty table gives an empty one.
    """
    marked = stage(fingerprints(docs), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    labels = components(near_links(distinct.select("fp")))
    known = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    known = stage(known, "labels")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = known.join(least, "label").select("fp", "component_id")
    return marked.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group of near duplicates, that with the smallest id.

    All columns are kept as they are. Rows that repeat an id are one document and stay or go
    together. Rows without an id cannot stand for a group: they are kept and compared with nothing.
    """
    named = docs.where("doc_id IS NOT NULL")
    groups = near_duplicates(named)
    key = free_name(docs, "_kept")
    ids = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = named.join(ids, named["doc_id"].cast("long") == F.col(key), "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL"))
