"""Recall of the fingerprints' lookup on planted passages just over the limit of similarity."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from velotide.llm import decontaminate
from velotide.llm.common import all_shingles


def passage(seed, n):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 2000, n)]


def edited(words, seed, changed):
    """A copy with other words near its ends, where a change costs the fewest shingles."""
    draw, copy = np.random.default_rng(seed), list(words)
    places = draw.choice([*range(8), *range(len(words) - 8, len(words))], changed, replace=False)
    for at in places.tolist():
        copy[at] = f"edit{seed}x{at}"
    return copy


def similarity(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def planted(least, most, many, start):
    """Pairs of an item and an edited copy with a similarity in the given range."""
    found, seed = [], start
    while len(found) < many:
        seed += 1
        words = passage(seed, 30 + seed % 60)
        copy = edited(words, seed, 1 + seed % 3)
        if least <= similarity(words, copy) <= most:
            found.append((words, copy))
    return found


def test_every_pair_within_the_radius_meets_in_a_block():
    flips, width = decontaminate.flips(0.8), decontaminate.WIDTH
    masks = set(decontaminate._masks(flips))
    assert len(masks) == 37 and decontaminate.radius(0.8) == 23
    draw = np.random.default_rng(1)
    for _ in range(2000):
        apart = draw.choice(64, decontaminate.radius(0.8), replace=False)
        assert any(sum(1 << int(p % width) for p in apart if p // width == b) in masks for b in range(decontaminate.BLOCKS))


def test_fingerprints_of_planted_pairs_are_within_the_radius():
    pairs = planted(0.8, 0.85, 3000, 0)
    prints = []
    for side in zip(*pairs, strict=True):
        _, parts = all_shingles(pa.array([" ".join(w) for w in side]), decontaminate.SHINGLE)
        prints.append([decontaminate.fingerprint(p) for p in parts])
    apart = [((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(*prints, strict=True)]
    assert max(apart) <= decontaminate.radius(0.8)


def test_planted_passages_are_found(spark):
    pairs = planted(0.8, 0.85, 1000, 10_000)
    items = spark.createDataFrame([(k, " ".join(a)) for k, (a, _) in enumerate(pairs)], "item_id long, text string")
    texts = [(k, " ".join(passage(50_000 + k, k % 40) + b + passage(90_000 + k, k % 31))) for k, (_, b) in enumerate(pairs)]
    docs = spark.createDataFrame(texts + [(5000 + k, " ".join(passage(200_000 + k, 200))) for k in range(200)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(k, k) for k in range(1000)}


@pytest.mark.parametrize("extra", [[], [(1, None), (1, ""), (None, "a b c d e f"), (None, None)]])
def test_empty_and_odd_benchmarks(spark, extra):
    """No item, or only blank ones and ones without an id, that still count by their text."""
    items = spark.createDataFrame(extra, "item_id long, text string").selectExpr("*", "1 AS n", "2 AS fp", "3 AS bits")
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, None), (3, ""), (None, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.word) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == ({(1, None, 1), (None, None, 0)} if extra else set())
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
