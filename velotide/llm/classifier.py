"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing gives every word a fixed sparse vector of signs. The vector of a word is the sum of
the sparse vectors of the words around it, over the whole corpus. Words are hashed to a fixed number of rows, so
that the table of vectors has a size set by parameters (65,536 x 32 numbers, 8 MB) whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import encode_words, free_name, id_fold, in_short_batches, scramble, stage, text_slices, word_hashes

ROWS, WIDTH, SIGNS = 1 << 16, 32, 2
REACH = 2  # words before and after
BLOCKS = 64  # the table travels in pieces of ROWS / BLOCKS rows
WORDS = 1 << 16  # looked up at once: a worker's memory goes by them, not by the words of a batch or of a long text
SAMPLE = 20_000  # labelled rows that the network is fitted on, at most; of them the first by hash
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 256, 0.01, 1e-4
THRESHOLD = 0.3


def _signs() -> tuple[np.ndarray, np.ndarray]:
    """For every row the places and signs of its sparse vector."""
    draw = scramble(np.arange(ROWS * SIGNS, dtype=np.uint64) + np.uint64(7919)).reshape(ROWS, SIGNS)
    return (draw % np.uint64(WIDTH)).astype(np.int64), np.where(draw >> np.uint64(63), 1, -1)


def _rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the table row of each word in order. Case is kept: it tells quality."""
    counts, codes, words = encode_words(texts, lower=False)
    hashed = (scramble(word_hashes(words)) % np.uint64(ROWS)).astype(np.int64)
    return counts, hashed[codes]


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task as one row per block of the table that is not zero, ``WORDS`` pairs at once."""
    place, sign = _signs()
    table = np.zeros(ROWS * WIDTH, np.int64)
    for batch in text_slices(batches, "text", 4 << 20):
        counts, rows = _rows(batch["text"])
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        for step in range(1, REACH + 1):
            for at in range(0, len(rows) - step, WORDS):
                left, right = slice(at, min(at + WORDS, len(rows) - step)), slice(at + step, at + step + WORDS)
                near = owner[left] == owner[right]
                ends = rows[left][near], rows[right][near]
                for word, other in (ends, ends[::-1]):
                    for k in range(SIGNS):
                        np.add.at(table, word * WIDTH + place[other, k], sign[other, k])
    for k, block in enumerate(table.reshape(BLOCKS, -1)):
        if block.any():
            small = block.astype(np.int32) if -(2**31) < block.min() and block.max() < 2**31 else block
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["block", "sums"])


def _add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = ROWS * WIDTH // BLOCKS
    total = np.zeros(size, np.int64)
    for batch in rows:
        for raw in batch["sums"]:
            buffer = raw.as_buffer()
            total += np.frombuffer(buffer, np.int32 if buffer.size == 4 * size else np.int64)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all texts, each of length 1 (or zero). It comes to the driver
    as 64 blocks, 16 MB in all, by the parameters above."""
    sums = docs.select("text").mapInArrow(_accumulate, "block int, sums binary")
    blocks = sums.groupBy("block").applyInArrow(_add, "block int, sums binary").collect()
    table = np.zeros((BLOCKS, ROWS * WIDTH // BLOCKS))
    for row in blocks:
        table[row.block] = np.frombuffer(row.sums, np.int64)
    table = table.reshape(ROWS, WIDTH)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length, length, 1)).astype(np.float32)


def _sums(table: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the vectors of every text's words; no words: zeros. As many texts as have ``WORDS`` words go at once; a
    longer text goes by itself, in pieces from its own start, so that no sum depends on the texts beside it."""
    sums, ends, at = np.zeros((len(counts), WIDTH)), np.cumsum(counts), 0
    while at < len(counts):
        done = ends[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ends, done + WORDS, side="right")))
        full = at + np.flatnonzero(counts[at:to])
        for begin in range(done, ends[to - 1], WORDS):
            first = np.maximum(ends[full] - counts[full] - begin, 0)
            piece = table[rows[begin : min(begin + WORDS, ends[to - 1])]]
            sums[full] += np.add.reduceat(piece, first, axis=0, dtype=np.float64)
        at = to
    return sums


def _pooled_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in text_slices(batches, "text", 4 << 20):
            counts, rows = _rows(batch["text"])
            means = _sums(table, counts, rows) / np.maximum(counts, 1)[:, None]
            values = pa.FixedSizeListArray.from_arrays(pa.array(means.ravel().astype(np.float32)), WIDTH)
            yield pa.record_batch([batch["doc_id"], values.cast(pa.list_(pa.float32()))], ["doc_id", "features"])

    return run


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id``, ``features``: the mean vector of the words of each text; no words: zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_pooled_batches(shared), "doc_id long, features array<float>")


@dataclass(frozen=True)
class Network:
    """Two layers: tanh units, then one logistic output divided by a temperature."""

    centre: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, np.ndarray]
    biases: tuple[np.ndarray, np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.centre) / self.spread @ self.weights[0] + self.biases[0])
        return (hidden @ self.weights[1] + self.biases[1])[:, 0]

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """Adam on the cross entropy of the rows outside ``calibration``; the temperature is the one
    with the least cross entropy on those inside. One class only, or no rows, give its share everywhere."""
    train = ~calibration if (~calibration).any() else np.ones(len(y), bool)
    draw = np.random.default_rng(11)
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        zero = np.zeros((width, HIDDEN)), np.zeros((HIDDEN, 1))
        return Network(np.zeros(width), np.ones(width), zero, (np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])), 1.0)
    centre, spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    values = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    z, target = (x[train] - centre) / spread, y[train].astype(float)[:, None]
    for _ in range(EPOCHS):
        order = draw.permutation(len(z))
        for at in range(0, len(z), BATCH):
            pick = order[at : at + BATCH]
            hidden = np.tanh(z[pick] @ values[0] + values[1])
            out = 1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -50, 50)))
            wrong = (out - target[pick]) / len(pick)
            back = wrong @ values[2].T * (1 - hidden**2)
            slopes = [z[pick].T @ back, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            t += 1
            for k, slope in enumerate(slopes):
                slope = slope + DECAY * values[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                values[k] = values[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(centre, spread, (values[0], values[2]), (values[1], values[3]), 1.0)
    inside = calibration if calibration.any() else train
    logits, labels = net.logits(x[inside]), y[inside].astype(float)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    scaled = logits[None, :] / grid[:, None]
    loss = (np.logaddexp(0, scaled) - labels * scaled).mean(axis=1)
    return Network(centre, spread, net.weights, net.biases, float(grid[int(loss.argmin())]))


@in_short_batches
def score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.3) for every row of ``docs``.

    ``labels`` (``doc_id``, ``quality``) are learned from only where ``held_out``, a condition on
    ``doc_id`` (default: crc32 of the id modulo 5 is 0), does not hold; labels without quality are
    ignored, of several for one id the greatest counts. Word vectors come from all texts. The network is fitted on at most
    ``sample`` labelled rows, those with the least hash of their id; a quarter of them sets the temperature. Null and
    empty texts have zero vectors and are scored like others. Rows may repeat and ids may be null.
    """
    held = id_fold("doc_id", 5) == 0 if held_out is None else held_out
    features = stage(pooled(docs, word_vectors(docs)).withColumn("held_out", held), "pooled")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    learn = (
        features.where(~F.col("held_out")).join(marks, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("features", "quality", (F.xxhash64("doc_id", F.lit(1)) % 4 == 0).alias("calibration"))
    ).toPandas()
    x = np.stack(learn["features"].to_list()).astype(np.float64) if len(learn) else np.zeros((0, WIDTH))
    net = fit_network(x, learn["quality"].to_numpy(np.int64), learn["calibration"].to_numpy(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch["features"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                chance = net.chance(values.reshape(-1, WIDTH))
                predicted = pa.array((chance >= THRESHOLD).astype(np.int32))
                yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(chance), predicted], ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality, with all their columns. Rows that
    repeat an id stay if all of its texts do; rows without an id are kept."""
    key, scored = free_name(docs, "_bad"), score(docs, labels)
    bad = scored.where("predicted = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == F.col(key), "left_anti")
