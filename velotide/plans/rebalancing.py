"""Stations that reliably drain or fill on weekday mornings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotide.functions import metrics as M

# Thresholds set before looking at results.
DRAIN_BELOW = -5.0
FILL_ABOVE = 5.0
CONSISTENT_SHARE = 0.8
MIN_DAYS = 20
LABELS = (("drains", -1), ("fills", 1))


def classify(
    flows: DataFrame,
    drain_below: float = DRAIN_BELOW,
    fill_above: float = FILL_ABOVE,
    min_days: int = MIN_DAYS,
    share: float = CONSISTENT_SHARE,
) -> DataFrame:
    """Per station: how often its mornings drain or fill by forecast and in fact, and a label."""

    def part(c: str, test: Column) -> Column:
        return F.avg(test.cast("int")).alias(c)

    table = flows.groupBy("station_id").agg(
        F.count("*").alias("days"),
        part("forecast_drain_share", F.col("forecast") < drain_below),
        part("forecast_fill_share", F.col("forecast") > fill_above),
        part("actual_drain_share", F.col("actual") < drain_below),
        part("actual_fill_share", F.col("actual") > fill_above),
        F.median("forecast").alias("median_forecast"),
        F.median("actual").alias("median_actual"),
    )
    label = (
        F.when(F.col("days") < min_days, "too few days")
        .when(F.col("forecast_fill_share") >= share, "fills")
        .when(F.col("forecast_drain_share") >= share, "drains")
        .otherwise("mixed")
    )
    return table.withColumn("label", label)


def summarize(flows: DataFrame, table: DataFrame, drain_below: float = DRAIN_BELOW) -> DataFrame:
    """One row per label: stations, bikes moved on a median morning, and how often it came true.

    Both labels use the size of the drain threshold. Rates of a label without stations are NULL.
    """
    labels = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("sign")) for n, s in LABELS])
    wanted = flows.sparkSession.range(1).select(F.inline(labels))
    per_label = table.groupBy("label").agg(
        F.count("*").alias("stations"),
        F.sum("median_forecast").alias("forecast"),
        F.sum("median_actual").alias("actual"),
    )
    moved = flows.join(table.select("station_id", "label"), "station_id").join(wanted, "label")
    toward = F.col("actual") * F.col("sign")
    hits = moved.groupBy("label").agg(
        F.avg((toward > 0).cast("int")).alias("hit_rate"),
        F.avg((toward > abs(drain_below)).cast("int")).alias("hit_rate_threshold"),
    )
    weekdays = flows.agg(F.count_distinct("date")).scalar()
    zero = F.lit(0.0)
    return (
        wanted.join(per_label, "label", "left")
        .join(hits, "label", "left")
        .select(
            "label",
            weekdays.alias("weekdays"),
            F.coalesce("stations", F.lit(0)).alias("stations"),
            (F.col("sign") * F.coalesce("forecast", zero)).alias("bikes_forecast"),
            (F.col("sign") * F.coalesce("actual", zero)).alias("bikes_actual"),
            "hit_rate",
            "hit_rate_threshold",
        )
    )


def flagged_by_both(table: DataFrame, reference: DataFrame) -> DataFrame:
    """Per label: stations that the model and the reference model both flag, of the model's."""
    mine = table.filter(F.col("label").isin(*[n for n, _ in LABELS])).select("station_id", "label")
    theirs = reference.select("station_id", "label", F.lit(1).alias("shared"))
    return (
        mine.join(theirs, ["station_id", "label"], "left")
        .groupBy("label")
        .agg(F.count("shared").alias("shared"), F.count("*").alias("stations"))
    )


def pooled_skill(preds: DataFrame, model: str, reference: str) -> DataFrame:
    """One row: MAE of both models over all rows, and the skill of the first."""
    miss = F.abs(F.col("y") - F.col("yhat"))
    errors = preds.agg(
        F.avg(F.when(F.col("model") == model, miss)).alias("model_mae"),
        F.avg(F.when(F.col("model") == reference, miss)).alias("reference_mae"),
    )
    return errors.withColumn("skill", M.skill(F.col("model_mae"), F.col("reference_mae")))


def ranked_list(table: DataFrame, stations: DataFrame, label: str) -> DataFrame:
    """Stations of one label by median forecast, the strongest first; an unknown name is the ID."""
    names = stations.select(F.col("canonical_id").alias("station_id"), "name")
    side = "drain" if label == "drains" else "fill"
    strongest = F.asc("median_forecast") if label == "drains" else F.desc("median_forecast")
    return (
        table.filter(F.col("label") == label)
        .join(names, "station_id", "left")
        .select(
            "station_id",
            F.coalesce("name", "station_id").alias("name"),
            "days",
            F.col(f"forecast_{side}_share").alias("forecast_share"),
            F.col(f"actual_{side}_share").alias("actual_share"),
            "median_forecast",
            "median_actual",
        )
        .orderBy(strongest, "station_id")
    )
