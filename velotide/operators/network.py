"""A network across stations: a learned vector per station, two layers, 48 masked outputs for a station-day.

The models of all test weeks and losses are trained side by side over one table of station-days, so that the
number of jobs is the number of epochs, whatever the number of weeks. An epoch is a pass in which every
partition adds up the gradients of its rows for all models, and a shuffle that adds up partitions in
blocks of parameters; the driver holds parameters only. What differs between cutoffs is kept so that each can
read it off: an hour carries the time from which on it is known to be closed, and the moments of the
weather are running sums by day.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velotide.functions.columns import elapsed_seconds, hours, naive
from velotide.operators.features import DAY_DEMAND, HOURLY_DEMAND, HOURLY_WEATHER, build_feature_table
from velotide.operators.global_model import LOSSES, VALIDATION_DAYS
from velotide.operators.grid import with_idle_runs
from velotide.session import materialize
from velotide.settings import CLOSED_MIN_HOURS, TARGETS

OUTPUTS = 24 * len(TARGETS)
WEATHER = 24 * len(HOURLY_WEATHER)
HIDDEN, VECTOR = 64, 8
EPOCHS, PATIENCE, RATE, DECAY = 150, 40, 0.01, 1e-4
BLOCK = 1 << 14  # parameters of one row of a gradient
NEVER = 1 << 40  # in hours: not known to be closed at any time


def station_days(hourly: DataFrame, weather: DataFrame, calendar: DataFrame, min_hours: int = CLOSED_MIN_HOURS) -> DataFrame:
    """One row per station and day with all inputs: station_id, day (since 1970), inputs (logs of demand, then the
    calendar of the day), weather (24 hours of three columns, as they are), y (24 hours of each target), and for the day
    and those one and seven days before, the hour since 1970 from which on each hour is known to be closed."""
    runs = with_idle_runs(hourly.select("station_id", "ts", *TARGETS))
    whole = (F.col("run_end") + hours(1) - F.col("run_start")) >= hours(min_hours)
    since = (elapsed_seconds(naive("1970-01-01"), F.col("run_start")) / 3600).cast("long") + min_hours
    told = runs.withColumn("told", F.when(whole, since).otherwise(F.lit(NEVER))).drop("run_start", "run_end")
    table = build_feature_table(told, weather, calendar)
    turn = F.col("month") * (2 * math.pi / 12)
    of_day = F.array(
        *[F.log1p(c) for c in DAY_DEMAND],
        *[(F.col("dow") == d).cast("double") for d in range(7)],
        F.sin(turn), F.cos(turn), F.col("is_holiday").cast("double"), F.col("is_semester").cast("double"),
    )
    hour = F.struct(
        F.hour("ts").alias("hour"),
        F.array(*[F.log1p(c) for c in HOURLY_DEMAND]).alias("demand"),
        F.array(*[F.col(c).cast("double") for c in HOURLY_WEATHER]).alias("weather"),
        of_day.alias("day"),
        *[F.col(t).cast("double").alias(t) for t in TARGETS],
        "told",
    )
    grouped = table.groupBy("station_id", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.sort_array(F.collect_list(hour)).alias("h")  # 24 rows
    )
    checked = F.when(F.size("h") == 24, F.col("h")).otherwise(
        F.raise_error(F.lit("this day of a station lacks some of its 24 hourly rows"))
    )

    def series(name: str):
        return F.transform("h", lambda h: h[name])

    days = grouped.withColumn("h", checked).select(
        "station_id",
        "day",
        F.concat(F.flatten(series("demand")), F.col("h")[0]["day"]).alias("inputs"),
        F.flatten(series("weather")).alias("weather"),
        F.concat(*[series(t) for t in TARGETS]).alias("y"),
        series("told").alias("told"),
    )
    by_day = Window.partitionBy("station_id").orderBy("day")
    lagged = days.withColumns({"told_1": F.lag("told", 1).over(by_day), "told_7": F.lag("told", 7).over(by_day)})
    known = F.forall("inputs", lambda v: v.isNotNull()) & F.forall("weather", lambda v: v.isNotNull())
    return lagged.filter(known & F.col("told_7").isNotNull())


@dataclass
class Cutoff:
    """What one test week reads off the running sums: sizes, moments of the weather and the mean of the targets."""

    week: date
    day: int
    first_validation: int
    train_samples: int
    val_samples: int
    mean: np.ndarray
    deviation: np.ndarray
    level: np.ndarray  # mean of every output


def cutoff_sums(days: DataFrame) -> DataFrame:
    """Per day: station-days, and sums and squares of the weather and of the targets."""
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(HOURLY_WEATHER):
        values = [F.get("weather", F.lit(k)) for k in range(i, WEATHER, len(HOURLY_WEATHER))]
        parts.append(F.sum(sum(values, F.lit(0.0))).alias(c))
        parts.append(F.sum(sum((v * v for v in values), F.lit(0.0))).alias(f"{c}_squares"))
    parts.append(F.array(*[F.sum(F.get("y", F.lit(k))) for k in range(OUTPUTS)]).alias("y"))
    return days.groupBy("day").agg(*parts)


def read_cutoffs(days: DataFrame, week_starts: list[date], val_days: int) -> list[Cutoff]:
    """The sums of every cutoff; to the driver comes one row a day."""
    daily = cutoff_sums(days).orderBy("day").toPandas()
    out = []
    for week in sorted(set(week_starts)):
        day = (week - date(1970, 1, 1)).days
        train = daily[daily["day"] < day - val_days]
        held = daily[(daily["day"] >= day - val_days) & (daily["day"] < day)]
        if not len(train):
            raise ValueError(f"no complete station-day to learn from before {week}")
        n = 24.0 * train["n"].sum()
        mean = np.array([train[c].sum() / n for c in HOURLY_WEATHER])
        squares = np.array([train[f"{c}_squares"].sum() for c in HOURLY_WEATHER])
        deviation = np.sqrt(np.maximum(squares - n * mean**2, 0) / max(n - 1, 1))
        deviation[deviation < 1e-9] = 1.0
        level = np.stack(train["y"].to_list()).sum(axis=0) / train["n"].sum()
        out.append(Cutoff(week, day, day - val_days, int(train["n"].sum()), int(held["n"].sum()), mean, deviation, level))
    return out


@dataclass(frozen=True)
class Shape:
    stations: int
    inputs: int
    hidden: int = HIDDEN
    vector: int = VECTOR

    def sizes(self) -> list[tuple[int, ...]]:
        return [(self.stations, self.vector), (self.inputs + self.vector, self.hidden), (self.hidden,),
                (self.hidden, OUTPUTS), (OUTPUTS,)]

    @property
    def count(self) -> int:
        return sum(math.prod(s) for s in self.sizes())

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        parts, at = [], 0
        for size in self.sizes():
            parts.append(flat[at : at + math.prod(size)].reshape(size))
            at += math.prod(size)
        return parts

    def start(self, level: np.ndarray, seed: int) -> np.ndarray:
        draw = np.random.default_rng(seed)
        vectors, first, bias, second, last = self.split(np.zeros(self.count))
        vectors[:] = draw.normal(0, 1, vectors.shape)
        first[:] = draw.normal(0, 1 / math.sqrt(len(first)), first.shape)
        second[:] = draw.normal(0, 0.3 / math.sqrt(len(second)), second.shape)
        last[:] = np.log(np.expm1(np.maximum(level, 0.01)))  # the mean comes out without any input
        return np.concatenate([p.ravel() for p in (vectors, first, bias, second, last)])


def forward(shape: Shape, flat: np.ndarray, station: np.ndarray, x: np.ndarray):
    vectors, first, bias, second, last = shape.split(flat)
    joined = np.hstack([x, vectors[station]])
    hidden = np.tanh(joined @ first + bias)
    raw = hidden @ second + last
    return joined, hidden, raw, np.logaddexp(0.0, raw)


def gradient(shape: Shape, flat: np.ndarray, loss: str, station: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
    """Sums over rows: gradient of the masked loss, the loss, and the hours that count. Closed hours have none."""
    _, first, _, second, _ = shape.split(flat)
    joined, hidden, raw, rate = forward(shape, flat, station, x)
    if loss == "poisson":
        rate = rate + 1e-9
        value, slope = rate - y * np.log(rate), 1 - y / rate
    else:
        value, slope = np.abs(rate - y), np.sign(rate - y)
    out = slope * mask / (1 + np.exp(-np.clip(raw, -500, 500)))
    back = (out @ second.T) * (1 - hidden**2)
    vectors = np.zeros((shape.stations, shape.vector))
    np.add.at(vectors, station, back @ first[shape.inputs :].T)
    parts = [vectors, joined.T @ back, back.sum(axis=0), hidden.T @ out, out.sum(axis=0)]
    return np.concatenate([p.ravel() for p in parts]), float((value * mask).sum()), float(mask.sum())


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {"station": batch["station"].to_numpy(zero_copy_only=False), "day": batch["day"].to_numpy(zero_copy_only=False)}
    for name in ("inputs", "weather", "y", "told", "told_1", "told_7"):
        out[name] = batch[name].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return out


def _inputs(rows: dict[str, np.ndarray], cutoff: Cutoff, hour: np.ndarray) -> np.ndarray:
    """Inputs as known at ``hour`` (one number, or one for each row)."""
    scaled = (rows["weather"].reshape(len(hour), 24, -1) - cutoff.mean) / cutoff.deviation
    closed = [(rows[c] <= hour[:, None]).mean(axis=1, keepdims=True) for c in ("told_1", "told_7")]
    return np.hstack([rows["inputs"], scaled.reshape(len(hour), -1), *closed])


@dataclass
class Model:
    """One week and loss in training."""

    cutoff: Cutoff
    loss: str
    flat: np.ndarray
    best: np.ndarray = None
    val_mae: float = math.inf
    since: int = 0
    moments: list[np.ndarray] = field(default_factory=list)

    def step(self, gradient: np.ndarray, epoch: int) -> None:
        """One step of Adam."""
        if not self.moments:
            self.moments = [np.zeros_like(self.flat), np.zeros_like(self.flat)]
        first, second = self.moments
        gradient = gradient + DECAY * self.flat
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        self.flat = self.flat - RATE * (first / (1 - 0.9 ** (epoch + 1))) / (
            np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8
        )


PARTS = "model int, block int, sums array<double>"


def _partials(shape: Shape, models) -> object:
    """A task's sums for all models: gradients in blocks, and in block -1 the loss, hours, validation error and hours."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        sums = [np.zeros(shape.count) for _ in known]
        scores = np.zeros((len(known), 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, week, taken = _columns(batch), None, None
            for m, (cutoff, loss, flat) in enumerate(known):
                if cutoff.week != week:
                    week, before = cutoff.week, rows["day"] < cutoff.day
                    taken = {c: v[before] for c, v in rows.items()}
                    hour = np.full(int(before.sum()), cutoff.day * 24)
                    x = _inputs(taken, cutoff, hour) if len(hour) else None
                    mask = np.tile((taken["told"] > cutoff.day * 24).astype(float), len(TARGETS))
                    train = taken["day"] < cutoff.first_validation
                if x is None:
                    continue
                part, value, weight = gradient(
                    shape, flat, loss, taken["station"][train], x[train], taken["y"][train], mask[train]
                )
                sums[m] += part
                rate = forward(shape, flat, taken["station"][~train], x[~train])[3]
                wrong = np.abs(rate - taken["y"][~train]) * mask[~train]
                scores[m] += (value, weight, wrong.sum(), mask[~train].sum())
        for m in range(len(known)):
            blocks = [sums[m][b : b + BLOCK] for b in range(0, shape.count, BLOCK)]
            yield _parts_batch([m] * (len(blocks) + 1), [-1, *range(len(blocks))], [scores[m], *blocks])

    return add_up


def _parts_batch(models: list[int], blocks: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    lists = pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(models, pa.int32()), pa.array(blocks, pa.int32()), lists], ["model", "block", "sums"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal (model, block)."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for m, b, part in zip(batch["model"].to_pylist(), batch["block"].to_pylist(), batch["sums"], strict=True):
            values = part.values.to_numpy()
            held[m, b] = held[m, b] + values if (m, b) in held else values.copy()
    for (m, b), values in sorted(held.items()):
        yield _parts_batch([m], [b], [values])


def epoch_sums(days: DataFrame, shape: Shape, models: list[Model]) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of all models and (loss, hours, validation error, validation hours) of each, in one job."""
    context = days.sparkSession.sparkContext
    sent = context.broadcast([(m.cutoff, m.loss, m.flat) for m in models])
    rows = days.mapInArrow(_partials(shape, sent), PARTS).repartition("model", "block").mapInArrow(_totals, PARTS).collect()
    sent.destroy()
    gradients, scores = [np.zeros(shape.count) for _ in models], np.zeros((len(models), 4))
    for r in rows:
        if r["block"] < 0:
            scores[r["model"]] = r["sums"]
        else:
            gradients[r["model"]][r["block"] * BLOCK : r["block"] * BLOCK + len(r["sums"])] = r["sums"]
    return gradients, scores


def train(days: DataFrame, cutoffs: list[Cutoff], stations: int, losses=LOSSES, epochs: int = EPOCHS, seed: int = 1) -> tuple[Shape, list[Model]]:
    """All models after training; each keeps the parameters of its least validation error."""
    width = len(days.select("inputs").first()["inputs"]) + WEATHER + 2
    shape = Shape(stations, width)
    models = [Model(c, loss, shape.start(c.level, seed)) for c in cutoffs for loss in losses]
    running = models
    for epoch in range(epochs + 1):
        gradients, scores = epoch_sums(days, shape, running)
        for model, part, (_, weight, wrong, held) in zip(running, gradients, scores, strict=True):
            error = wrong / held if held else math.inf
            model.since = 0 if error < model.val_mae or model.best is None else model.since + 1
            if not model.since:
                model.best, model.val_mae = model.flat, error
            model.step(part / max(weight, 1.0), epoch)
        running = [m for m in running if m.since < PATIENCE]
        if not running:
            break
    return shape, models


def chosen(models: list[Model]) -> list[Model]:
    """Of each week the model of least validation error, the first loss by name on ties."""
    weeks = sorted({m.cutoff.week for m in models})
    return [min((m for m in models if m.cutoff.week == w), key=lambda m: (m.val_mae, m.loss)) for w in weeks]


FORECASTS = "test_week timestamp_ntz, station_id string, ts timestamp_ntz, departures double, arrivals double"


def _predictor(shape: Shape, models) -> object:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, names = _columns(batch), batch["station_id"]
            for cutoff, flat in models.value:
                due = np.flatnonzero((rows["day"] >= cutoff.day) & (rows["day"] < cutoff.day + 7))
                if not len(due):
                    continue
                part = {c: v[due] for c, v in rows.items()}
                x = _inputs(part, cutoff, part["day"] * 24)  # closures as known at the day's midnight
                rate = forward(shape, flat, part["station"], x)[3]
                start = np.repeat(part["day"].astype("datetime64[D]").astype("datetime64[us]"), 24)
                ts = start + np.tile(np.arange(24), len(due)) * np.timedelta64(3_600_000_000, "us")
                week = np.full(len(ts), np.datetime64(cutoff.week, "us"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(week), names.take(pa.array(np.repeat(due, 24))), pa.array(ts),
                     *(pa.array(rate[:, 24 * t : 24 * t + 24].ravel()) for t in range(len(TARGETS)))],
                    ["test_week", "station_id", "ts", *TARGETS],
                )

    return predict


def network_forecasts(
    hourly: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    week_starts: list[date],
    val_days: int = VALIDATION_DAYS,
    min_hours: int = CLOSED_MIN_HOURS,
    losses: tuple[str, ...] = LOSSES,
    epochs: int = EPOCHS,
) -> tuple[DataFrame, DataFrame]:
    """Wide forecasts of all test weeks (test_week, station_id, ts, targets) and the log of fits, as
    ``global_forecasts`` gives them. Station-days with a missing input neither train nor are forecast.

    The driver and every task hold the parameters of all models: a vector a station, and some 20,000 numbers.
    """
    days = station_days(hourly, weather, calendar, min_hours)
    names = [r[0] for r in hourly.select("station_id").distinct().orderBy("station_id").collect()]
    index = hourly.sparkSession.createDataFrame(list(enumerate(names)), "station int, station_id string")
    days = materialize(days.join(F.broadcast(index), "station_id"))
    cutoffs = read_cutoffs(days, week_starts, val_days)
    shape, models = train(days, cutoffs, len(names), losses, epochs)
    kept = chosen(models)
    sent = days.sparkSession.sparkContext.broadcast([(m.cutoff, m.best) for m in kept])
    wide = materialize(days.mapInArrow(_predictor(shape, sent), FORECASTS))
    log = [
        (
            str(m.cutoff.week), m.cutoff.train_samples, m.cutoff.val_samples, m.loss,
            [(o.loss, float(o.val_mae)) for o in models if o.cutoff.week == m.cutoff.week],
        )
        for m in kept
    ]
    schema = (
        "cutoff string, train_samples long, val_samples long, chosen_loss string, "
        "runs array<struct<loss string, val_mae double>>"
    )
    return wide, days.sparkSession.createDataFrame(log, schema)
