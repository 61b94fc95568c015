"""Lines that many documents share, found with levelled sorted runs of line hashes.

A run is a table of line keys in hash buckets, sorted within each, with the documents counted so far and
the keeper. Batches come in from the largest ids to the smallest. A batch folds its lines to one row a
key and merge-joins them to all runs, bucket by bucket, without moving a run: a key that no run holds
(the anti-join) is the batch's own, and its largest id is the keeper; of a known key only the count goes
on. The batch's keys become a run of the first level, and a level with ``FANOUT`` runs is compacted into
one of the next, so that a batch meets a number of runs that grows with the logarithm of the batches.

Built-in functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.llm.common import let, stage
from velotide.session import scratch_path

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
BATCHES = 4
FANOUT = 3

RUN = "h1 long, h2 long, n long, keeper long"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; a text of ASCII alone takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class LineRuns:
    """The runs of all batches so far. ``levels[k]`` lists table and path of each run of level k.

    Batches read runs as bucketed tables, without an exchange. Compaction reads their files: the planner
    takes a union of bucketed scans for dealt by key, but column batches are not joined by bucket.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, lines: DataFrame) -> None:
        """``lines``: h1, h2, doc_id, lead (1 where a line is the first of its key in its document). No
        earlier batch may have a smaller id than a later one."""
        self._put(self.merged(lines), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def merged(self, lines: DataFrame) -> DataFrame:
        """One row for each key of the batch: h1, h2, n, and the keeper if no run holds the key."""
        own = lines.groupBy("h1", "h2").agg(F.sum("lead").alias("n"), F.max("doc_id").alias("keeper"))
        known = F.lit(False)
        for k, run in enumerate(self.tables()):
            own = own.join(run.select("h1", "h2", F.lit(True).alias(f"in_{k}")).hint("merge"), ["h1", "h2"], "left")
            known = known | F.coalesce(f"in_{k}", F.lit(False))
        return own.select("h1", "h2", "n", F.when(~known, F.col("keeper")).alias("keeper"))

    def compact(self, level: int) -> None:
        """One run of the next level from all runs of this one."""
        runs, self.levels[level] = self.levels[level], []
        self._put(self._folded(runs), level + 1)
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")

    def counted(self) -> DataFrame:
        """All keys with their documents and keeper."""
        return self._folded([run for level in self.levels for run in level])

    def _folded(self, runs: list[tuple[str, str]]) -> DataFrame:
        rows = self.spark.read.schema(RUN).parquet(*(path for _, path in runs))
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        dealt = rows.repartition(self.buckets, "h1", "h2")  # no exchange where the rows lie so already
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.levels[level].append((name, path))


def _keyed(docs: DataFrame, min_length: int) -> DataFrame:
    """Every row of ``docs`` with its 128-bit row key and its lines: key hash, place, first of its key."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda line: ascii_lower(F.btrim(line, F.lit(SPACE))))
    hashed = F.transform(
        lines,
        lambda key, place: F.when(
            F.length(key) >= min_length,
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), place.alias("place")),
        ),
    )

    def marked(found: Column) -> Column:
        def mark(line: Column, k: Column) -> Column:
            before = F.get(found, k - 1)
            twin = F.coalesce((before["h1"] == line["h1"]) & (before["h2"] == line["h2"]), F.lit(False))
            return F.struct(line["h1"].alias("h1"), line["h2"].alias("h2"), line["place"].alias("place"),
                            F.when(twin, 0).otherwise(1).alias("lead"))

        return F.transform(found, mark)

    found = F.sort_array(F.filter(hashed, lambda line: line.isNotNull()))
    return rows.select("doc_id", *_row_key(), F.inline(let(found, marked)))


def _row_key() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias("t1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("t2")


def _with_batch(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """Batch 0 has the largest ids; rows without an id are in the last one."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10_000)).first()[0] if shares else []
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + F.when(F.col("doc_id") >= cut, 0).otherwise(1)
    return lines.withColumn("batch", batch)


def drop_shared_lines(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are left out) as doc_id, text of the lines
    that stay, n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of ``min_length``
    code points found in ``min_documents`` rows lose all their lines but those of the largest id that holds
    them. Every row is a document: rows that repeat an id count one by one, and all rows of the largest id
    keep the line. No id is less than any id. A null text is an empty one, with one empty line. Lines of
    Windows ends keep their carriage return. An empty table gives an empty table.

    Lines are hashed once, to two 64-bit numbers, and written by batch; only hashes and places are moved.
    A key that a third of all documents hold is folded in every task before it is moved, and its lines
    meet a table with one row a key, in a join that is split where it is skewed.
    """
    spark = docs.sparkSession
    found = _with_batch(_keyed(docs, min_length), docs, batches)
    path = scratch_path(spark, "llm-lines")
    found.write.partitionBy("batch").parquet(path)
    schema = found.schema
    lines = spark.read.schema(schema).parquet(path)

    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select("h1", "h2", "doc_id", "lead"))
    shared = stage(runs.counted().filter(F.col("n") >= min_documents).drop("n"), "shared-lines")

    gone = (
        lines.join(shared, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("t1", "t2")
        .agg(F.collect_set("place").alias("gone"))
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", *_row_key()).join(gone, ["t1", "t2"], "left")
    split = F.split("text", "\n", -1)
    stay = let(
        split,
        lambda parts: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda k: F.get(parts, k)),
            "\n",
        ),
    )
    return rows.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(stay).alias("text"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


DROP_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT r, doc_id, p, parts[p] AS line,
         translate(trim(parts[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS p FROM texts)),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_LENGTH}
  GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
judged AS (
  SELECT r, l.doc_id, p, line, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone
  FROM lines l LEFT JOIN shared s ON s.key = l.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r"""
