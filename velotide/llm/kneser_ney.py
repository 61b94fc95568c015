"""Interpolated modified Kneser-Ney language model, counted in Spark and scored from mapped files.

Order 2: P(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) P(w) and P(w) = (n(w) - D(n(w))) / n + g / (V + 1),
where n(w) is the number of different words before w and g the mass that the discounts set free.
Every pair and every word is counted; nothing is pruned. The model is a set of files of sorted
64-bit hashes with their counts below the shared folder. Workers map them into memory, so that the
pages are shared by all workers of a machine and never become part of a heap.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import (
    encode_words,
    scramble,
    shared_uri,
    text_slices,
    word_hashes,
    write_shared,
)
from velotide.session import scratch_path

END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
START = np.uint64(xxhash.xxh64_intdigest(b" "))  # or has a space
SPREAD = 16  # the pairs of one first word go to so many buckets
PAIR = np.dtype("<u8")
ONE = np.dtype(
    [("hash", "<u8"), ("count", "<u8"), ("before", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]
)


@dataclass(frozen=True)
class Model:
    """Where the files are, and the few totals of the corpus."""

    path: str
    buckets: int
    tokens: int  # N, ends included
    words: int  # V, the end included
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts. In corpora so small that one of the
    counts is zero the discount is 0.5, 1 or 1.5; a discount stays within 0 and its count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    rules = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    found = (k - (k + 1) * y * more / n if n and more else k / 2 for k, n, more in rules)
    return tuple(min(max(d, 0.0), float(k)) for d, k in zip(found, (1, 2, 3), strict=True))


def _pair_bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    spread = scramble(first + (second % np.uint64(SPREAD)) * np.uint64(0x9E3779B97F4A7C15))
    return (spread % np.uint64(buckets)).astype(np.int64)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return scramble(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _token_pairs(texts: pa.Array):
    """Hashes of the distinct words, and for each text its tokens and what precedes each, as codes."""
    counts, codes, words = encode_words(texts)
    hashes = np.concatenate((word_hashes(words), [END, START]))
    ends = np.cumsum(counts + 1) - 1
    tokens = np.full(len(codes) + len(counts), len(words), np.int64)
    at = np.ones(len(tokens), bool)
    at[ends] = False
    tokens[at] = codes
    before = np.roll(tokens, 1)
    before[ends - counts] = len(words) + 1
    return hashes, counts + 1, tokens, before


def _sums(keys: np.ndarray, *columns: np.ndarray):
    """Sort by key and add up the columns of equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], *(np.add.reduceat(c[order], begin) for c in columns)


def _blobs(bucket: np.ndarray, buckets: int, *columns: np.ndarray):
    """Rows (bucket, one binary per column) of the columns dealt by ``bucket``."""
    order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), *(c[edges[b] : edges[b + 1]] for c in columns)


def _count_pairs(buckets: int):
    """Pairs of each piece of text, added up, as one row per bucket. The first words of a row are
    stored once with the length of their run, the second ones as places in a list of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            hashes, _, tokens, before = _token_pairs(batch["text"])
            pairs, counts = np.unique(before << 32 | tokens, return_counts=True)
            first, second = pairs >> 32, pairs & 0xFFFFFFFF
            bucket = _pair_bucket(hashes[first], hashes[second], buckets)
            rows = [[], [], [], [], [], []]
            for b, f, s, c in _blobs(bucket, buckets, first, second, counts):
                begin = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
                seen, place = np.unique(s, return_inverse=True)
                width = np.uint16 if len(seen) <= 65536 else np.uint32
                lengths = np.diff(np.concatenate((begin, [len(f)]))).astype(np.uint32)
                values = (hashes[f[begin]], lengths, hashes[seen], place.astype(width), c.astype(np.uint32))
                rows[0].append(b)
                for column, value in zip(rows[1:], values, strict=True):
                    column.append(value.tobytes())
            yield pa.record_batch(
                [pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])],
                ["bucket", "first", "runs", "seen", "place", "n"],
            )

    return run


COUNTED = "bucket int, first binary, runs binary, seen binary, place binary, n binary"


def _merge_pairs(uri: str, buckets: int):
    """Write the sorted pairs of a bucket; send on what they say about words."""

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, counts = [], [], []
        for batch in rows:
            for f, r, s, p, n in zip(*(batch[c].to_pylist() for c in ("first", "runs", "seen", "place", "n")), strict=True):
                firsts.append(np.repeat(np.frombuffer(f, "<u8"), np.frombuffer(r, "<u4")))
                counts.append(np.frombuffer(n, "<u4"))
                width = np.uint16 if len(p) == 2 * len(counts[-1]) else np.uint32
                seconds.append(np.frombuffer(s, "<u8")[np.frombuffer(p, width)])
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        keys = _pair_key(first, second)
        order = np.argsort(keys)
        keys, begin = keys[order], None
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, first, second = keys[begin], first[order][begin], second[order][begin]
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), begin)
        often = np.flatnonzero(total > 255)
        head = np.array([len(keys), len(often)], PAIR)
        parts = [head, keys, keys[often], total[often].astype(PAIR), np.minimum(total, 255).astype(np.uint8)]
        write_shared(f"{uri}/pairs-{key[0].as_py()}", parts)
        zero = np.zeros(len(total), np.int64)
        of_first = _sums(first, zero, zero, *((total == k).astype(np.int64) for k in (1, 2)), (total > 2).astype(np.int64))
        of_second = _sums(second, total, zero + 1, zero, zero, zero)
        words = _sums(*(np.concatenate(x) for x in zip(of_first, of_second, strict=True)))
        stats = [int((total == k).sum()) for k in (1, 2, 3, 4)] + [len(total)]
        out = [[], [], []]
        for b, *columns in _blobs((words[0] % np.uint64(buckets)).astype(np.int64), buckets, *words):
            table = np.zeros(len(columns[0]), ONE)
            for name, column in zip(ONE.names, columns, strict=True):
                table[name] = column
            out[0].append(b)
            out[1].append(table.tobytes())
            out[2].append(stats)
            stats = [0] * 5
        yield pa.record_batch(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))],
            ["bucket", "words", "stats"],
        )

    return run


def _merge_words(uri: str):
    """Write the sorted words of a bucket; send on totals."""

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, of_pairs = [], np.zeros(5, np.int64)
        for batch in rows:
            tables += [np.frombuffer(x, ONE) for x in batch["words"].to_pylist()]
            of_pairs += np.array(batch["stats"].to_pylist(), np.int64).reshape(-1, 5).sum(axis=0)
        table = np.concatenate(tables)
        merged = _sums(table["hash"], *(table[c].astype(np.int64) for c in ONE.names[1:]))
        table = np.zeros(len(merged[0]), ONE)
        for name, column in zip(ONE.names, merged, strict=True):
            table[name] = column
        write_shared(f"{uri}/words-{key[0].as_py()}", [table])
        before = merged[2]
        stats = [int(merged[1].sum()), int((merged[1] > 0).sum())]
        stats += [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum())]
        stats += of_pairs.tolist()
        yield pa.record_batch([pa.array([stats], pa.list_(pa.int64()))], ["stats"])

    return run


def fit(docs: DataFrame, bytes_per_bucket: int = 8 << 20) -> Model:
    """Count all pairs and words of all texts of ``docs`` (column ``text``; null: empty, which is
    still an end). The number of files follows the bytes of text; an empty table gives a model that
    knows nothing."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bytes_per_bucket))
    uri = shared_uri(scratch_path(spark, "llm-kneser-ney"))
    counted = docs.select("text").mapInArrow(_count_pairs(buckets), COUNTED)
    words = counted.groupBy("bucket").applyInArrow(
        _merge_pairs(uri, buckets), "bucket int, words binary, stats array<bigint>"
    )
    totals = words.groupBy("bucket").applyInArrow(_merge_words(uri), "stats array<bigint>")
    row = totals.agg(*(F.sum(F.col("stats")[i]) for i in range(12))).first()
    tokens, known, u1, u2, u3, u4, more, n1, n2, n3, n4, pairs = (x or 0 for x in row)
    of_pair, of_word = discounts(n1, n2, n3, n4), discounts(u1, u2, u3, u4)
    mass = (of_word[0] * u1 + of_word[1] * u2 + of_word[2] * more) / pairs if pairs else 1.0
    return Model(uri, buckets, tokens, known, pairs, of_pair, of_word, mass)


_FILES: dict[str, np.ndarray] = {}  # of this worker process


def _mapped(uri: str, dtype) -> np.ndarray | None:
    """A file of the model, mapped. From a store that cannot be mapped it is first copied into the
    worker's own temporary folder. None if the bucket has no file."""
    if uri not in _FILES:
        system, path = fs.FileSystem.from_uri(uri)
        if not system.get_file_info(path).is_file:
            _FILES[uri] = None
        else:
            if not isinstance(system, fs.LocalFileSystem):
                handle, local = tempfile.mkstemp()
                with system.open_input_stream(path) as source, os.fdopen(handle, "wb") as copy:
                    while block := source.read(1 << 22):
                        copy.write(block)
                path = local
            _FILES[uri] = np.memmap(path, dtype, mode="r")
    return _FILES[uri]


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return place, sorted_keys[place] == wanted


def _word_rows(model: Model, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), ONE)
    bucket = (hashes % np.uint64(model.buckets)).astype(np.int64)
    for b, places in _blobs(bucket, model.buckets, np.arange(len(hashes))):
        table = _mapped(f"{model.path}/words-{b}", ONE)
        if table is not None:
            places = places[np.argsort(hashes[places])]
            at, hit = _find(table["hash"], hashes[places])
            out[places[hit]] = table[at[hit]]
    return out


def _pair_counts(model: Model, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    keys = _pair_key(first, second)
    out = np.zeros(len(keys), np.int64)
    for b, places in _blobs(_pair_bucket(first, second, model.buckets), model.buckets, np.arange(len(keys))):
        raw = _mapped(f"{model.path}/pairs-{b}", np.uint8)
        if raw is not None:
            n, often = (int(x) for x in raw[:16].view(PAIR))
            numbers = raw[16 : 16 + 8 * (n + 2 * often)].view(PAIR)
            places = places[np.argsort(keys[places])]
            at, hit = _find(numbers[:n], keys[places])
            out[places[hit]] = raw[16 + 8 * (n + 2 * often) :][at[hit]]
            if often:
                at, hit = _find(numbers[n : n + often], keys[places])
                out[places[hit]] = numbers[n + often :][at[hit]]
    return out


def _discount(counts: np.ndarray, values: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *values))[np.minimum(counts, 3)]


def pair_probabilities(model: Model, hashes: np.ndarray, first: np.ndarray, second: np.ndarray):
    """P(second | first) for pairs of codes into ``hashes``, and the counts of all words."""
    rows = _word_rows(model, hashes)
    before = rows["before"].astype(np.int64)
    plain = model.word_mass / (model.words + 1)
    if model.pairs:
        plain = plain + (before - _discount(before, model.word_discounts)) / model.pairs
    plain = np.broadcast_to(plain, len(hashes))
    counts = _pair_counts(model, hashes[first], hashes[second])
    d1, d2, d3 = model.pair_discounts
    kinds = rows["n1"].astype(np.float64), rows["n2"].astype(np.float64), rows["n3"].astype(np.float64)
    # What follows a word was counted as often as the word itself; the start of a text has no count.
    follows = np.where(hashes == START, rows_of_end(model), rows["count"]).astype(np.float64)
    seen = follows > 0
    safe = np.where(seen, follows, 1.0)
    freed = np.where(seen, (d1 * kinds[0] + d2 * kinds[1] + d3 * kinds[2]) / safe, 1.0)
    high = (counts - _discount(counts, model.pair_discounts)) / safe[first]
    return high + freed[first] * plain[second], rows["count"].astype(np.int64)


def rows_of_end(model: Model) -> int:
    """Texts that were counted: each has one end, and one start."""
    return int(_word_rows(model, np.array([END]))["count"][0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are left out) with ``n_tokens``,
    ``n_known``, ``base_score`` (log10 probability of single tokens with 0.1 added to their counts),
    ``score`` (log10 probability under the model) and ``perplexity`` per token. A null text is
    empty: its one token is the end. Repeated rows give repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            hashes, sizes, tokens, before = _token_pairs(batch["text"])
            pairs, where = np.unique(before << 32 | tokens, return_inverse=True)
            chance, counts = pair_probabilities(model, hashes, pairs >> 32, pairs & 0xFFFFFFFF)
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            begin = np.cumsum(sizes) - sizes
            scores = np.add.reduceat(np.log10(chance)[where], begin)
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({
                    "doc_id": batch["doc_id"].to_pandas(integer_object_nulls=True),
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat((counts[tokens] > 0).astype(np.int64), begin),
                    "base_score": np.add.reduceat(base[tokens], begin),
                    "score": scores,
                    "perplexity": 10.0 ** (-scores / sizes),
                }),
                schema=SCORED, preserve_index=False,
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    )


SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


def fit_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows that are not held out, score all rows."""
    model = fit(docs.where(~held_out))
    scored = score(docs, model)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
