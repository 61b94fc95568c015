"""Shared lines: against a plain version, over batches and fanouts, with odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from velotide.llm import line_runs

DOCS = "doc_id long, text string"


def plain(rows, min_length=20, min_documents=3):
    """doc_id, kept text, lines and dropped lines of every row, by dictionaries."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    texts = [(-1 if i is None else i, t or "") for i, t in rows]
    holders = {}
    for r, (i, t) in enumerate(texts):
        for k in {key(line) for line in t.split("\n")}:
            if len(k) >= min_length:
                holders.setdefault(k, []).append((i, r))
    keeper = {k: max(i for i, _ in held) for k, held in holders.items() if len(held) >= min_documents}
    out = []
    for (i, t), (doc_id, _) in zip(texts, rows, strict=True):
        lines = t.split("\n")
        kept = [line for line in lines if keeper.get(key(line), i) == i]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def texts(n, seed):
    draw = np.random.default_rng(seed)
    lines = [f"this is the shared line with number {k}" for k in range(12)]
    lines += ["short", "", "  ", "Ünïcode LINE that is long enough ÄÖ", "x" * 19, "y" * 20]
    made = []
    for i in range(n):
        own = [f"a line that stands in document {i} alone, {j}" for j in range(2)]
        chosen = [lines[int(k)] for k in draw.integers(0, len(lines), int(draw.integers(0, 9)))]
        chosen = [draw.choice([c, c.upper() if c.isascii() else c, f" \t{c}\r"]) for c in chosen]
        mixed = own + chosen
        draw.shuffle(mixed)
        made.append((int(draw.integers(0, n)) if draw.random() < 0.3 else i, "\n".join(mixed)))
    return made


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (5, 2)])
def test_equals_plain_version(spark, batches, fanout):
    rows = [*texts(60, 7), (None, "this is the shared line with number 3"), (None, "y" * 20), (3, None), (4, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(line_runs.drop_shared_lines(df, batches=batches, fanout=fanout)) == plain(rows)


def test_only_rows_without_an_id(spark):
    rows = [(None, "y" * 20 + f"\nown {k}") for k in range(4)]
    assert got(line_runs.drop_shared_lines(spark.createDataFrame(rows, DOCS))) == plain(rows)


def test_odd_rows(spark):
    """Repeated rows, a long text of one line and of many equal lines, clashing columns, an empty table."""
    many = "\n".join(["the same line, again and again"] * 20_000)
    rows = [(1, many), (2, many), (2, many), (3, "word " * 50_000), (9, "the same line, again and again\nlast")]
    df = spark.createDataFrame(rows, DOCS).selectExpr(
        "*", *(f"1 AS {c}" for c in "h1 h2 t1 t2 n keeper lead place batch gone n_lines line".split())
    )
    assert got(line_runs.drop_shared_lines(df)) == plain(rows)
    assert line_runs.drop_shared_lines(df.limit(0)).collect() == []


def test_batches_meet_runs_without_moving_them(spark):
    """A batch is merge-joined to the bucketed runs: the only exchange is that of its own keys."""
    lines = spark.range(400).select(
        (F.col("id") % 90).alias("h1"), (F.col("id") % 90 * 3).alias("h2"), F.col("id").alias("doc_id"), F.lit(1).alias("lead")
    )
    runs = line_runs.LineRuns(spark, fanout=9)
    runs.add(lines.filter("doc_id >= 200"))
    runs.add(lines.filter("doc_id BETWEEN 100 AND 199"))
    merged = runs.merged(lines.filter("doc_id < 100"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan
    assert merged.filter("keeper IS NOT NULL").count() == 0  # all keys were known
    counted = {r.h1: (r.n, r.keeper) for r in runs.counted().collect()}
    want = {k: (len([i for i in range(100, 400) if i % 90 == k]), max(i for i in range(100, 400) if i % 90 == k)) for k in range(90)}
    assert counted == want


def test_compaction_bounds_the_runs(spark):
    lines = spark.range(64).select(
        (F.col("id") % 7).alias("h1"), F.lit(0).cast("long").alias("h2"), F.col("id").alias("doc_id"), F.lit(1).alias("lead")
    )
    runs = line_runs.LineRuns(spark, fanout=2)
    for k in range(7, -1, -1):
        runs.add(lines.filter(F.col("doc_id").between(8 * k, 8 * k + 7)))
    assert [len(level) for level in runs.levels] == [0, 0, 0, 1]
    assert {(r.h1, r.n, r.keeper) for r in runs.counted().collect()} == {
        (k, len(range(k, 64, 7)), max(range(k, 64, 7))) for k in range(7)
    }


def test_digest_of_the_query(spark):
    digest = hashlib.sha256("".encode()).hexdigest()
    df = line_runs.drop_shared_lines(spark.createDataFrame([(1, None)], DOCS))
    assert df.select("n_lines", "n_dropped", F.sha2("text", 256)).first() == (1, 0, digest)
