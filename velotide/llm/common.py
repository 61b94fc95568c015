"""What the operators share: words of a batch of texts, folds, stage tables, files in the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.session import scratch_path

# A word is a run of anything but ASCII white space, as in `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = 1_000  # that a worker gets at once: its memory, and that of the sender, go by the texts of a batch


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files. A lost executor then costs a
    re-read, and later passes read only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_and_release(df: DataFrame, name: str) -> DataFrame:
    """``stage``, and then a collection of the driver's garbage: Spark deletes the shuffle files of plans that
    nobody holds any more only then, and a long chain of stages would keep them all on disk."""
    written = stage(df, name)
    del df
    gc.collect()
    written.sparkSession.sparkContext._jvm.System.gc()
    return written


def in_short_batches(operator: Callable) -> Callable:
    """``operator``, which takes a frame first, run with at most ``BATCH_ROWS`` rows in a batch for Python. It counts for the
    passes that run before the operator returns; the session's own number is put back then."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        if 0 < int(before) <= BATCH_ROWS:
            return operator(docs, *args, **kwargs)
        conf.set(name, str(BATCH_ROWS))
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(name, before)

    return run


def id_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a row without an id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % folds


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the only element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of a piece have ``most_bytes`` or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes.astype(np.int64)), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def encode_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of every text (null: none): their number per text, a code for each word in order, and
    the distinct words the codes stand for. A-Z become lower case if ``lower``."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    words = flat.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:  # leading and trailing white space
        real = codes != blank
        owner = np.repeat(np.arange(len(counts)), counts)
        counts, codes = np.bincount(owner[real], minlength=len(counts)), codes[real]
    return counts, codes, words


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words.to_pylist()), np.uint64, len(words))


def scramble(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(counts: np.ndarray, codes: np.ndarray, hashes: np.ndarray, size: int):
    """One 64-bit hash for every window of ``size`` words inside a text: the text it belongs to,
    the position of its first word among ``codes``, and the hash. A text of fewer words has none."""
    n = len(codes) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    mixed = np.zeros(len(inside), np.uint64)
    for k in range(size):
        mixed = scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[codes[inside + k]])
    return owner[inside], inside, mixed


def all_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per text, and of every text its shingle hashes; one of fewer than ``size`` words, but with
    any, has one shingle of them all."""
    counts, codes, words = encode_words(texts)
    hashes = word_hashes(words)
    owner, _, mixed = shingle_hashes(counts, codes, hashes, size)
    sizes = np.bincount(owner, minlength=len(counts))
    parts, at, word_at = [], 0, 0
    for n, many in zip(counts, sizes, strict=True):
        if 0 < n < size:
            whole = np.zeros(1, np.uint64)
            for code in codes[word_at : word_at + n]:
                whole = scramble(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[code])
            parts.append(whole)
        else:
            parts.append(mixed[at : at + many])
        at, word_at = at + many, word_at + n
    return counts, parts


def write_shared(uri: str, parts: list[np.ndarray]) -> None:
    """Write a file below the shared folder under its final name only once it is complete, so that
    a retried or speculative task leaves one whole file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial) as out:
        for part in parts:
            out.write(np.ascontiguousarray(part).tobytes())
    system.move(partial, path)


def shared_uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"
