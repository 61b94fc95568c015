"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 32.0  # a larger mean is split into equal pieces, each with a uniform of its own
STEPS = 128  # beyond it the distribution function of a piece is 1 in double precision
MOST_SOURCES = 10_000


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of ``key``."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["c"])


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    rest: float = 1.0,
    seed: str = "mix",
    scale: float = 1.0,
) -> DataFrame:
    """Repeat every document so that the sources reach their target shares of bytes, in global random order.

    ``weights`` gives the share of a source, up to a common factor; all other sources, and rows
    without a source, are one pool with the share ``rest``. A document of a source gets the mean
    repetition rate scale * (bytes of all) * share / (bytes of the source), the size of a row being
    the bytes of its text and 1. Its number of copies is the inverse of the Poisson distribution at
    a uniform hashed from ``seed`` and its id, so that it depends neither on partitions nor on other
    rows; rows without an id are told apart by their text. Repeated rows are repeated alike. All
    input columns are kept; ``copy`` (from 0), ``copies`` and ``shuffle_key`` are added and take the
    place of input columns of these names. The result is ordered by ``shuffle_key``, a hash of id and copy.

    The totals per pool are one aggregation with as many rows as ``weights`` has entries and one
    more, so they are broadcast; no document is shuffled before the final ordering.
    """
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources can have a weight of their own")
    if any(w < 0 for w in (*weights.values(), rest)) or not sum(weights.values()) + rest:
        raise ValueError("weights must not be negative, nor all zero")
    names = sorted(weights)
    pool = F.when(F.col("row.source").isin(names), F.col("row.source")) if names else F.lit(None).cast("string")
    rows = docs.select(F.struct("*").alias("row")).withColumn("pool", pool)
    rows = rows.withColumn("size", F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long") + 1)
    totals = rows.groupBy("pool").agg(F.sum("size").alias("bytes"))
    share = F.lit(float(rest))
    for name in names:
        share = F.when(F.col("pool") == name, F.lit(float(weights[name]))).otherwise(share)
    whole = float(sum(weights[n] for n in names) + rest)
    everything = totals.agg(F.sum("bytes").alias("all"))
    rates = (
        totals.join(F.broadcast(everything))
        .withColumn("mean", share * F.lit(scale) * F.col("all") / F.lit(whole) / F.col("bytes"))
        .withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("mean") / PIECE).cast("int")))
        .select(F.col("pool").alias("p"), "pieces", _distribution(F.col("mean") / F.col("pieces")).alias("below"))
    )
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("row.text", F.lit("")).cast("binary"))))

    def copies_of(piece: Column) -> Column:
        u = uniform(F.concat(F.lit(f"{seed}:"), piece.cast("string"), F.lit(":"), F.col("name")))
        return F.size(F.filter("below", lambda c: c <= u))

    counted = (
        rows.withColumn("name", name)
        .join(F.broadcast(rates), F.col("pool").eqNullSafe(F.col("p")))
        .withColumn("copies", F.aggregate(F.sequence(F.lit(1), F.col("pieces")), F.lit(0), lambda n, k: n + copies_of(k)))
        .where("copies > 0")
    )
    order = F.md5(F.concat(F.lit(f"{seed}:order:"), F.col("copy").cast("string"), F.lit(":"), F.col("name")).cast("binary"))
    repeated = counted.select(
        "row", "name", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    ).withColumn("shuffle_key", order)
    own = ("copy", "copies", "shuffle_key")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own]
    return repeated.orderBy("shuffle_key").select(*kept, *own)


def mix_sql(weights: Mapping[str, float], rest: float, seed: str) -> str:
    """The same in DuckDB SQL over ``documents``."""
    names = sorted(weights)
    listed = ", ".join(f"'{n}'" for n in names) or "NULL"
    share = " ".join(f"WHEN pool = '{n}' THEN {float(weights[n])!r}::DOUBLE" for n in names)
    whole = float(sum(weights[n] for n in names) + rest)
    return f"""
WITH RECURSIVE docs AS (
  SELECT *, CASE WHEN source IN ({listed}) THEN source END AS pool, coalesce(strlen(text), 0) + 1 AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS name
  FROM documents),
totals AS (SELECT pool, CAST(sum(size) AS BIGINT) AS bytes FROM docs GROUP BY pool),
means AS (
  SELECT pool, (CASE {share} ELSE {float(rest)!r}::DOUBLE END) * 1.0::DOUBLE
         * CAST((SELECT CAST(sum(bytes) AS BIGINT) FROM totals) AS DOUBLE) / {whole!r}::DOUBLE / CAST(bytes AS DOUBLE) AS mean
  FROM totals),
pieces AS (SELECT pool, greatest(1, CAST(ceil(mean / {PIECE!r}::DOUBLE) AS INTEGER)) AS pieces, mean FROM means),
steps AS (
  SELECT pool, pieces, mean / pieces AS m, 0 AS k, exp(-(mean / pieces)) AS p, exp(-(mean / pieces)) AS c FROM pieces
  UNION ALL SELECT pool, pieces, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM steps WHERE k < {STEPS}),
uniforms AS (
  SELECT name, pool, ('0x' || substr(md5('{seed}:' || piece || ':' || name), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u
  FROM (SELECT DISTINCT name, pool FROM docs) JOIN (SELECT pool AS p, unnest(range(1, pieces + 1)) AS piece FROM pieces)
    ON pool IS NOT DISTINCT FROM p),
counted AS (
  SELECT u.name, u.pool, CAST(count(*) AS INTEGER) AS copies
  FROM uniforms u JOIN steps s ON u.pool IS NOT DISTINCT FROM s.pool AND s.c <= u.u GROUP BY u.name, u.pool)
SELECT doc_id, text, lang, source, n_chars, copy, copies, md5('{seed}:order:' || copy || ':' || name) AS shuffle_key
FROM (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.name, c.copies,
             CAST(unnest(range(0, c.copies)) AS INTEGER) AS copy
      FROM docs d JOIN counted c ON d.name = c.name AND d.pool IS NOT DISTINCT FROM c.pool)"""
