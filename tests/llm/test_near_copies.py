"""Sketches of shingle sets bound what two sets share; they never drop a pair that is similar."""

import numpy as np
import pytest

from velotide.llm import near_copies


@pytest.mark.parametrize("sizes", [(1, 1), (3, 40), (100, 90), (500, 4000), (4096, 4097), (20_000, 19_000)])
def test_sketches_never_promise_too_little(sizes):
    draw = np.random.default_rng(sum(sizes))
    for share in (0.0, 0.3, 0.8, 0.95, 1.0):
        common = int(share * min(sizes))
        pool = np.unique(draw.integers(0, 1 << 62, 2 * sum(sizes)).astype(np.uint64))
        draw.shuffle(pool)
        a = pool[: sizes[0]]
        b = np.concatenate((a[:common], pool[sizes[0] : sizes[0] + sizes[1] - common]))
        most = near_copies._most_shared(near_copies._sketch(a), len(a), near_copies._sketch(b), len(b))
        assert common <= most <= min(sizes)
        if share == 0 and 50 < max(sizes) <= 1.25 * min(sizes):  # other sizes are not compared
            assert most < 0.75 * min(sizes)
        if a.size == b.size == common:
            assert most == common


def test_sketch_sizes():
    lengths = {n: len(near_copies._sketch(np.arange(n, dtype=np.uint64))) for n in (1, 32, 33, 1000)}
    assert lengths == {1: 8, 32: 8, 33: 16, 1000: 256}


def test_crowds_larger_than_the_centers(spark):
    """Chains of copies in which most are similar to a few neighbours only, beside a crowd around one text."""
    base = [f"w{k}" for k in range(120)]
    texts = []
    for steps in (range(0, 40), range(60, 90)):  # neighbours differ in one word, the chains are far apart
        texts += [" ".join(f"v{j}" if j < i else w for j, w in enumerate(base)) for i in steps]
    texts += [" ".join("x" * (1 + k) if j in (5 + k, 60 + k) else w for j, w in enumerate(base)) for k in range(30)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_what_either_method_links_is_one_group(spark, monkeypatch):
    """0 and 1 are linked by SimHash alone, 1 and 2 by similarity alone: one document of the three stays."""
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(f"a{k}" for k in range(60)), " ".join(base), " ".join([*base[:-1], "other"]), " ".join(base[::-1])]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[1])], "doc_id long, text string")
    linked = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 3)], "doc_id long, component_id long")
    monkeypatch.setattr(near_copies.simhash, "near_duplicates", lambda _: linked)
    kept = near_copies.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "3", "None"]


def test_a_crowd_is_compared_with_few_of_its_texts(spark, monkeypatch):
    """Pairs to compare grow with the members of a crowd, two or so for each, not with the pairs of members."""
    draw, compared, write = np.random.default_rng(5), {}, near_copies.stage
    for members in (100, 300):
        texts = []
        for k in range(members):
            words = [f"w{j}" for j in range(200)]
            for place in draw.choice(200, 2, replace=False):
                words[place] = f"edit{k}x{place}"
            texts.append((k, " ".join(words)))
        compared[members] = 0

        def counted(df, name, members=members):
            written = write(df, name)
            compared[members] += written.count() if name == "candidates" else 0
            return written

        monkeypatch.setattr(near_copies, "stage", counted)
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        assert {r.component_id for r in near_copies.near_duplicates(docs).collect()} == {0}
    assert all(pairs <= 5 * members for members, pairs in compared.items()), compared
    assert compared[300] <= 4 * compared[100], compared
