"""What a worker holds at once does not go by the rows of a default batch or by the number of crowded cells."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from velotide.llm import classifier, decontaminate, near_copies, simhash
from velotide.llm.common import BATCH_ROWS, in_short_batches

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Reached(Exception):
    pass


@pytest.mark.parametrize(
    "module, first, run",
    [
        (classifier, "word_vectors", lambda d: classifier.score(d, d)),
        (simhash, "stage", simhash.near_duplicates),
        (near_copies, "stage", near_copies.near_duplicates),
        (decontaminate, "stage", lambda d: decontaminate.contaminated(d, d.withColumnRenamed("doc_id", "item_id"))),
    ],
)
def test_passes_over_texts_get_short_batches(spark, monkeypatch, module, first, run):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")

    def seen(*_):
        raise Reached(spark.conf.get(ROWS))

    monkeypatch.setattr(module, first, seen)
    before = spark.conf.get(ROWS)
    with pytest.raises(Reached) as reached:
        run(docs)
    assert int(str(reached.value)) == BATCH_ROWS
    assert spark.conf.get(ROWS) == before


def test_batches_are_short_and_no_row_is_lost(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    found = in_short_batches(lambda docs: docs.mapInArrow(sizes, "n long").collect())(spark.range(5_300, numPartitions=2))
    assert sum(r.n for r in found) == 5_300 and max(r.n for r in found) <= BATCH_ROWS


def _cells(prints):
    """A dozen cells, each with all ``prints``, of which 256 are at home there."""
    rows = np.array([(c, 0, int(k >= 256), p) for c in range(12) for k, p in enumerate(prints.tolist())], np.int64)
    return iter([pa.record_batch([pa.array(rows[:, k]) for k in range(4)], ["cell", "part", "visit", "fp"])])


def test_crowded_cells_are_compared_in_bounded_memory():
    draw = np.random.default_rng(5)
    cells = _cells(draw.integers(0, 1 << 62, 1300))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in simhash._link_batches(cells)) == 0
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_a_crowd_of_near_copies_is_one_group(monkeypatch):
    """Blocks and lists of any size find the same groups."""
    draw = np.random.default_rng(6)
    prints = np.unique(1 << draw.integers(0, 60, 600) ^ 1 << draw.integers(0, 60, 600))
    for compared, joined in ((1 << 20, 1 << 16), (1, 7), (5_000, 1)):
        monkeypatch.setattr(simhash, "COMPARED", compared)
        monkeypatch.setattr(simhash, "JOINED", joined)
        links = [pair for b in simhash._link_batches(_cells(prints)) for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        reached, grown = {int(prints[0])}, True
        while grown:
            more = {x for pair in links if reached & set(pair) for x in pair}
            grown, reached = not more <= reached, reached | more
        assert reached == set(prints.tolist()) and len(links) == len(prints) - 1


@pytest.mark.parametrize("texts", [500, 1])
def test_classifier_holds_a_bounded_number_of_words(texts):
    """A batch of 600,000 words, and one text of them: besides the table (16 MB) and the coded words no pass holds much."""
    draw = np.random.default_rng(7)
    words = np.array([f"w{k}" for k in range(5_000)])
    each = [" ".join(words[draw.integers(0, 5_000, 600_000 // texts)]) for _ in range(texts)]
    batch = pa.record_batch([pa.array(range(texts)), pa.array(each)], ["doc_id", "text"])
    table = draw.normal(size=(classifier.ROWS, classifier.WIDTH)).astype(np.float32)
    for run in (classifier._accumulate, classifier._pooled_batches(SimpleNamespace(value=table))):
        tracemalloc.start()
        try:
            for _ in run(iter([batch])):
                pass
            assert tracemalloc.get_traced_memory()[1] < 50e6
        finally:
            tracemalloc.stop()


def test_pieces_give_the_sums_of_whole_texts(monkeypatch):
    draw = np.random.default_rng(8)
    batch = pa.array(["", None, "a b  c a", " ".join(f"w{k}" for k in range(300)), "one", " x y "])
    counts, rows = classifier._rows(batch)
    table = draw.integers(-9, 9, (classifier.ROWS, classifier.WIDTH)).astype(np.float32)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = [table[rows[owner == k]].sum(axis=0) for k in range(len(counts))]
    one = pa.record_batch([pa.array(range(6)), batch], ["doc_id", "text"])
    seen = set()
    for words in (1 << 16, 7, 1):
        monkeypatch.setattr(classifier, "WORDS", words)
        assert (classifier._sums(table, counts, rows) == whole).all()
        seen.add(tuple((b["block"][0].as_py(), b["sums"][0].as_py()) for b in classifier._accumulate(iter([one]))))
    assert len(seen) == 1
