"""Sums that a least-squares fit needs, per station and cutoff, without a station's history in one place.

All stations share the design row ``x`` of an hour, so its outer product is summed once for all of them, over
hours. A station then needs the sums of ``x`` times its targets, and the outer products of the hours
in which it was closed, which come off again. Rows fall into the bucket of the first cutoff that sees them;
the sums up to a bucket are those of its cutoff. An hour of an idle run becomes closed at the cutoff by
which the run has lasted long enough to tell; its targets are 0, so that nothing else changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.functions.columns import hours, naive
from velotide.operators.grid import with_idle_runs
from velotide.session import materialize
from velotide.settings import TARGETS


@dataclass(frozen=True)
class SharedSums:
    """Of all hours, for each cutoff: outer products [cutoff, k, k] and hours [cutoff]."""

    gram: np.ndarray
    n: np.ndarray


def bucket_of(ts: Column, cutoffs: list) -> Column:
    """Index of the first cutoff after ``ts``; their number if none is."""
    return sum((F.when(ts >= naive(c), 1).otherwise(0) for c in cutoffs), F.lit(0))


def _products(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j, value: sums of the products of places i <= j of ``x``."""
    k = F.size("x")
    firsts = rows.select(*by, "x", F.explode(F.sequence(F.lit(0), k - 1)).alias("i"))
    pairs = firsts.select(*by, "x", "i", F.explode(F.sequence(F.col("i"), k - 1)).alias("j"))
    value = F.get("x", F.col("i")) * F.get("x", F.col("j"))
    return pairs.groupBy(*by, "i", "j").agg(F.sum(value).alias("value"))


def _matrices(rows: pd.DataFrame, cutoffs: int, k: int) -> np.ndarray:
    """Symmetric matrices up to each cutoff from rows (bucket, i, j, value)."""
    out = np.zeros((cutoffs, k, k))
    known = rows[rows["bucket"] < cutoffs]
    at = tuple(known[c].to_numpy(dtype=np.int64) for c in ("bucket", "i", "j"))
    out[at] = known["value"].to_numpy()
    out[at[0], at[2], at[1]] = known["value"].to_numpy()
    return out.cumsum(axis=0)


def shared_sums(design: DataFrame, cutoffs: list, k: int) -> SharedSums:
    """Sums over the hours of ``design`` (ts, x), one row an hour. What comes to the driver is a matrix a cutoff."""
    rows = design.withColumn("bucket", bucket_of(F.col("ts"), cutoffs)).filter(F.col("bucket") < len(cutoffs))
    gram = _matrices(_products(rows, ["bucket"]).toPandas(), len(cutoffs), k)
    counted = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    return SharedSums(gram, np.cumsum([counted.get(b, 0) for b in range(len(cutoffs))]))


# Places of what is not a product of two columns: hours, closed hours, and the largest value of a target.
HOURS, CLOSED, LARGEST = -1, -2, -3


def station_sums(hourly: DataFrame, design: DataFrame, cutoffs: list, k: int, min_hours: int) -> DataFrame:
    """station_id, bucket, i, j, value. Places below ``k`` are columns of the design row, then come the targets: sums
    of products (i, k + t) and squares (k + t, k + t). Products i <= j < k are those of closed hours, in the bucket
    from which on they are known to be closed. (HOURS, 0), (CLOSED, 0) and (LARGEST, t): see there.

    All are aggregations in the JVM with partial sums in every task. ``design`` has a row an hour, of k numbers,
    whatever the number of stations, and is sent to all tasks. A closed hour costs k * k / 2 products.
    """
    last = naive(max(cutoffs))
    runs = with_idle_runs(hourly.select("station_id", "ts", *TARGETS)).filter(F.col("ts") < last)
    rows = materialize(runs.withColumn("bucket", bucket_of(F.col("ts"), cutoffs))).join(F.broadcast(design), "ts")
    by, y = ["station_id", "bucket"], [F.col(t).cast("double") for t in TARGETS]

    def listed(sums: DataFrame, entries: list[tuple[Column, Column, str]]) -> DataFrame:
        parts = [F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.col(c).cast("double").alias("value"))
                 for i, j, c in entries]
        return sums.select(*by, F.inline(F.array(*parts)))

    place = rows.select(*by, *TARGETS, F.posexplode("x").alias("i", "v"))
    products = place.groupBy(*by, "i").agg(*[F.sum(F.col("v") * v).alias(f"s{t}") for t, v in enumerate(y)])
    squares = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(v * v).alias(f"s{t}") for t, v in enumerate(y)],
        *[F.max(v).alias(f"m{t}") for t, v in enumerate(y)],
    )
    targets = range(len(TARGETS))
    first = listed(products, [(F.col("i"), F.lit(k + t), f"s{t}") for t in targets])
    second = listed(
        squares,
        [(F.lit(HOURS), F.lit(0), "n")]
        + [(F.lit(k + t), F.lit(k + t), f"s{t}") for t in targets]
        + [(F.lit(LARGEST), F.lit(t), f"m{t}") for t in targets],
    )
    long_enough = (F.col("run_end") + hours(1) - F.col("run_start")) >= hours(min_hours)
    told = F.col("run_start") + hours(min_hours)
    known = sum((F.when(naive(c) < told, 1).otherwise(0) for c in cutoffs), F.lit(0))
    closed = rows.filter(long_enough).withColumn("bucket", F.greatest("bucket", known))
    closed = closed.filter(F.col("bucket") < len(cutoffs))
    counts = listed(closed.groupBy(*by).agg(F.count("*").alias("n")), [(F.lit(CLOSED), F.lit(0), "n")])
    return first.unionByName(second).unionByName(_products(closed, by)).unionByName(counts)


@dataclass
class Sums:
    """What one fit takes: outer products, per target sums with it, of squares and the largest; hours."""

    gram: np.ndarray
    by_target: np.ndarray  # [k, target]
    squares: np.ndarray
    largest: np.ndarray
    n: float


def sums_at(shared: SharedSums, rows: pd.DataFrame, k: int) -> list[Sums]:
    """The sums of one station, rows (bucket, i, j, value), at every cutoff. A station that lacks hours of the grid
    is an error."""
    cutoffs = len(shared.n)
    i, j, b = (rows[c].to_numpy(dtype=np.int64) for c in ("i", "j", "bucket"))
    value = rows["value"].to_numpy()

    def table(places: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((cutoffs, width))
        out[b[places], column[places]] = value[places]
        return out

    n = table(i == HOURS, j, 1)[:, 0].cumsum() if len(rows) else np.zeros(cutoffs)
    if (n != shared.n).any():
        raise ValueError(f"station {rows['station_id'].iloc[0]} lacks hours of the grid before a cutoff")
    many = len(TARGETS)
    x = np.zeros((cutoffs, k, many))
    mixed = (i >= 0) & (i < k) & (j >= k)
    x[b[mixed], i[mixed], j[mixed] - k] = value[mixed]
    squares = table(i >= k, i - k, many).cumsum(axis=0)
    largest = np.maximum.accumulate(table(i == LARGEST, j, many), axis=0)
    n = n - table(i == CLOSED, j, 1)[:, 0].cumsum()
    off = _matrices(rows[(i >= 0) & (j < k)], cutoffs, k)
    x = x.cumsum(axis=0)
    return [Sums(shared.gram[c] - off[c], x[c], squares[c], largest[c], n[c]) for c in range(cutoffs)]


def ridge(sums: Sums, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual deviation per target. Columns are brought to one scale before they are
    penalized alike; the intercept, which comes first, is not penalized."""
    scale = np.maximum(np.sqrt(np.maximum(np.diag(sums.gram), 0) / sums.n), 1e-9)
    gram, moments = sums.gram / np.outer(scale, scale), sums.by_target / scale[:, None]
    weights = np.full(len(scale), penalty)
    weights[0] = 0.0
    beta = np.linalg.solve(gram + np.diag(weights), moments)
    return beta / scale[:, None], np.sqrt(np.maximum(residual(sums, beta / scale[:, None]), 0) / sums.n)


def residual(sums: Sums, beta: np.ndarray) -> np.ndarray:
    """Sum of squared errors per target."""
    return sums.squares - 2 * (beta * sums.by_target).sum(axis=0) + (beta * (sums.gram @ beta)).sum(axis=0)


def grid_bounds(hourly: DataFrame) -> tuple[datetime, datetime]:
    low, high = hourly.agg(F.min("ts"), F.max("ts")).first()
    return low, high


def sorted_cutoffs(week_starts: list[date]) -> list[date]:
    return sorted(set(week_starts))


def moments_table(hourly: DataFrame, design: DataFrame, cutoffs: list, k: int, min_hours: int) -> DataFrame:
    """The sums at every cutoff as rows: station_id, cutoff, n, i, j, value for places i <= j of the design row and,
    behind them, the targets (their squares, and their sums with the row)."""
    cutoffs = sorted_cutoffs(cutoffs)
    shared = shared_sums(design, cutoffs, k)

    def entries(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cutoff, sums in zip(cutoffs, sums_at(shared, rows, k), strict=True):
            head = (rows["station_id"].iloc[0], pd.Timestamp(cutoff), float(sums.n))
            out += [(*head, i, j, sums.gram[i, j]) for i in range(k) for j in range(i, k)]
            for t in range(len(TARGETS)):
                out += [(*head, i, k + t, sums.by_target[i, t]) for i in range(k)]
                out.append((*head, k + t, k + t, sums.squares[t]))
        return pd.DataFrame(out, columns=["station_id", "cutoff", "n", "i", "j", "value"])

    schema = "station_id string, cutoff timestamp_ntz, n double, i int, j int, value double"
    return station_sums(hourly, design, cutoffs, k, min_hours).groupBy("station_id").applyInPandas(entries, schema)


def ridge_table(hourly: DataFrame, design: DataFrame, cutoffs: list, k: int, min_hours: int, penalty: float) -> DataFrame:
    """Ridge coefficients and noise of every station, cutoff and target, from the sums alone."""
    cutoffs = sorted_cutoffs(cutoffs)
    shared = shared_sums(design, cutoffs, k)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cutoff, sums in zip(cutoffs, sums_at(shared, rows, k), strict=True):
            beta, noise = ridge(sums, penalty)
            for i, t in enumerate(TARGETS):
                out.append((rows["station_id"].iloc[0], pd.Timestamp(cutoff), t, beta[:, i], noise[i]))
        return pd.DataFrame(out, columns=["station_id", "cutoff", "target", "beta", "noise"])

    schema = "station_id string, cutoff timestamp_ntz, target string, beta array<double>, noise double"
    return station_sums(hourly, design, cutoffs, k, min_hours).groupBy("station_id").applyInPandas(solve, schema)
