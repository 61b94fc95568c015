"""The stages from raw files to reports, each reading and writing tables below one root folder.

    python -m velotide ingest   --root R --csv 'raw/*.csv' --legacy 'old/*.csv' --zips 'zip/*.zip'
    python -m velotide stations --root R
    python -m velotide hourly   --root R
    python -m velotide weather  --root R --source forecast --json forecast.json
    python -m velotide features --root R
    python -m velotide backtest --root R [--models ...] [--levels ...] [--weather actual]
    python -m velotide report   --root R
    python -m velotide rebalancing --root R --model global
    python -m velotide snapshot --root R
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.operators import calendar as CA
from velotide.operators import cleaning as C
from velotide.operators import features as FE
from velotide.operators import forecast as FC
from velotide.operators import global_model as GM
from velotide.operators import grid as G
from velotide.operators import regression as RG
from velotide.operators import stations as S
from velotide.operators import weather as W
from velotide.plans import analysis as A
from velotide.plans import rebalancing as K
from velotide.plans import report as R
from velotide.session import written
from velotide.settings import (
    AVERAGE,
    CLOSED_MIN_HOURS,
    NAIVE,
    RANK_END,
    RANK_START,
    TEST_WEEKS,
    TOP_STATIONS,
)
from velotide.sources import stores as ST
from velotide.sources import trip_files as TF

ADDITIVE, GLOBAL = "additive", "global"
MODELS = (NAIVE, AVERAGE, ADDITIVE, GLOBAL)
LEVELS = ("stations", "system")
# The global model learns across stations; the system total is a single series.
STATION_ONLY = (GLOBAL,)


@dataclass
class Project:
    """A root folder and the parameters of a run."""

    spark: SparkSession
    root: str
    test_weeks: tuple = TEST_WEEKS
    rank: tuple = (RANK_START, RANK_END)
    top_n: int = TOP_STATIONS
    min_hours: int = CLOSED_MIN_HOURS
    val_days: int = GM.VALIDATION_DAYS
    yearly: bool = True

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))


def raw_trips(project: Project, csv=None, legacy=None, zips=None) -> DataFrame:
    """Typed rows of all given files with the month in their names, not yet cleaned."""
    parts = [C.unify_names(TF.read_raw_csv(project.spark, p)) for p in (csv, legacy) if p]
    if zips:
        text = TF.unzip_trips(TF.read_archives(project.spark, zips))
        order = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("row_order").alias("row"))
        parts.append(text.withColumn("row_order", order))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return C.to_types(rows).withColumn("month", TF.month_of_trip_file(F.col("source_file")))


def ingest(project: Project, csv=None, legacy=None, zips=None) -> DataFrame:
    """Clean the months that are new. The log is small: its new version is brought to the driver
    before it replaces the one that it was computed from."""
    rows = written(raw_trips(project, csv, legacy, zips), "raw-trips")
    files = rows.select("source_file", "month").distinct()
    catalog = files.groupBy("month").agg(
        F.min("source_file").alias("key"), F.max("source_file").alias("other"), F.count("*").alias("files")
    )
    TF.require_one_file_per_month(catalog)
    old = ST.read_if_present(project.spark, project.path("cleaning_log"))
    log = ST.ingest_new_months(rows, project.path("trips"), old)
    rows_per_month = project.spark.createDataFrame(log.collect(), log.schema)
    project.write(rows_per_month, "cleaning_log")
    return rows_per_month


def trips(project: Project) -> DataFrame:
    return C.distinct_trips(TF.read_trips(project.spark, project.path("trips")))


def data_range(project: Project) -> tuple[datetime, datetime]:
    return TF.require_range(project.read("cleaning_log").select("month"))


def build_stations(project: Project) -> None:
    """Distinct trips, then who is who: statistics, merges, crosswalk, ranking and reports."""
    project.write(trips(project), "distinct_trips")
    rides = project.read("distinct_trips")
    project.write(S.station_stats(rides), "station_stats")
    stats = project.read("station_stats")
    project.write(S.find_merges(stats), "merges")
    merges = project.read("merges")
    project.write(S.build_crosswalk(stats, merges), "crosswalk")
    crosswalk = project.read("crosswalk")
    ranks = S.rank_stations(rides, crosswalk, *project.rank)
    project.write(S.canonical_stations(stats, crosswalk, ranks, project.top_n), "stations")
    top = project.read("stations").filter("is_top")
    ST.write_csv(top, project.path("top_stations_csv"))
    ids = top.select(F.col("canonical_id").alias("station_id"))
    project.write(S.neighbor_changes(stats, ids), "neighbor_changes")


def build_hourly(project: Project) -> None:
    start, end = data_range(project)
    rides, crosswalk = project.read("distinct_trips"), project.read("crosswalk")
    top = project.read("stations").filter("is_top")
    ids = top.select(F.col("canonical_id").alias("station_id"))
    counts = G.hourly_counts(rides, ids, start, end, crosswalk, selective=True)
    project.write(G.flag_in_service(counts, project.min_hours), "hourly")
    project.write(G.system_counts(rides, start, end), "hourly_system")
    spine = G.hour_spine(project.spark, start, end)
    project.write(CA.calendar_features(spine), "calendar")


def build_weather(project: Project, source: str, json: str) -> None:
    """The local hourly grid of one weather source (``forecast`` or ``actual``)."""
    start, end = data_range(project)
    rows = W.payload_rows(W.read_payload(project.spark, json))
    project.write(W.require_no_gaps(W.to_local_grid(rows, start, end)), f"weather_{source}")


def build_features(project: Project) -> None:
    weather, calendar = project.read("weather_forecast"), project.read("calendar")
    for name, out in (("hourly", "features_stations"), ("hourly_system", "features_system")):
        hourly = G.require_complete_grid(project.read(name))
        project.write(FE.build_feature_table(hourly, weather, calendar), out)


def predict(project: Project, level: str, model: str, weather_source: str = "forecast") -> DataFrame:
    """Long predictions of one model for all test weeks. Every hour of the weeks must have its one
    forecast, whatever the model; it is an error if one is missing."""
    weeks = list(project.test_weeks)
    hourly, preds = _predictions(project, level, model, weather_source, weeks)
    return FC.require_forecasts(hourly, written(preds, "predictions"), weeks)


def _predictions(project: Project, level: str, model: str, weather_source: str, weeks: list):
    if level == "system":
        hourly = project.read("hourly_system").withColumn("in_service", F.lit(True))
        min_hours = None
    else:
        hourly, min_hours = project.read("hourly"), project.min_hours
    if model in (NAIVE, AVERAGE):
        both = FC.backtest_baselines(hourly, weeks, min_hours=min_hours)
        return hourly, both.filter(F.col("model") == model)
    weather, calendar = project.read(f"weather_{weather_source}"), project.read("calendar")
    fit_hours = min_hours or 10**6
    if model == ADDITIVE:
        regressors = RG.require_horizon(FE.regressor_frame(calendar, weather), weeks)
        names = CA.holidays(CA.years_of(calendar))
        wide = RG.additive_forecasts(
            hourly, regressors, names, weeks, fit_hours, yearly=project.yearly
        )
    elif model == GLOBAL and level == "stations":
        wide, log = GM.global_forecasts(hourly, weather, calendar, weeks, project.val_days, fit_hours)
        ST.write_fit_log(log, project.path("fit_log_global"))
    else:
        raise ValueError(f"no model {model} for {level}; choose from {MODELS}")
    return hourly, FC.attach_actuals(hourly, wide, model, weeks)


def backtest(project: Project, models=MODELS, levels=LEVELS, weather_source: str = "forecast") -> None:
    """Store the predictions of every model and level. With actual weather they are kept apart,
    for the sensitivity table only."""
    folder = "predictions" if weather_source == "forecast" else "sensitivity"
    for level in levels:
        for model in models:
            if level == "system" and model in STATION_ONLY:
                continue
            preds = predict(project, level, model, weather_source)
            project.write(preds, f"{folder}/{level}/{model}")


def load_level(project: Project, level: str) -> DataFrame:
    """Scored rows of every model of a level."""
    rows = ST.load_predictions(project.spark, project.path(f"predictions/{level}/*"))
    return M.require_complete(rows, "y", "yhat")


def enriched(project: Project, level: str = "stations") -> DataFrame:
    return A.enrich(
        load_level(project, level), project.read("weather_actual"), project.read("calendar")
    )


def report(project: Project) -> dict[str, DataFrame]:
    """All report tables; each is also stored below ``report``."""
    rows = enriched(project)
    system = load_level(project, "system")
    R.require_identical_rows(rows)
    R.require_identical_rows(system)
    models = [r["model"] for r in rows.select("model").distinct().orderBy(*R.order_models()).collect()]
    tables = {
        "stations": R.scored_table(rows, ["target"]),
        "system": R.scored_table(system, ["target"]),
        "station_skill": R.station_skill_summary(rows),
        "mae_by_hour": R.mae_by_hour(rows, models),
        "worst_days": A.daily_errors(rows, project.read("weather_actual")),
        "station_scores": A.station_scores(rows, project.read("stations"), models),
    }
    for by in ("test_week", "season", "day_type", "weather", "hour_band"):
        tables[f"mae_by_{by}"] = R.wide_mae(rows, by, models)
    if "yhat_lower" in rows.columns:
        tables["intervals"] = R.interval_report(rows)
    rerun = ST.read_if_present(project.spark, project.path("sensitivity/stations/*"))
    if rerun is not None:
        tables["weather_sensitivity"] = R.weather_sensitivity(rows, rerun)
    for name, table in tables.items():
        project.write(table, f"report/{name}")
    return tables


def rebalancing(project: Project, model: str = GLOBAL, reference: str = AVERAGE) -> DataFrame:
    """Drain and fill labels of the model's forecasts, with names, as a table and as CSV."""
    rows = enriched(project)
    flows = A.morning_net_flow(rows, model)
    table = K.classify(flows)
    other = K.classify(A.morning_net_flow(rows, reference))
    names = project.read("stations").select(F.col("canonical_id").alias("station_id"), "name")
    project.write(K.summarize(flows, table), "report/rebalancing_summary")
    project.write(K.flagged_by_both(table, other), "report/rebalancing_shared")
    project.write(K.pooled_skill(rows, model, reference), "report/rebalancing_skill")
    named = table.join(names, "station_id", "left")
    ST.write_csv(named, project.path("report/rebalancing_stations_csv"))
    return named


def snapshot(project: Project) -> None:
    for level in LEVELS:
        ST.write_snapshot(enriched(project, level), project.path(f"snapshot/{level}"))
    project.write(ST.top_station_dimension(project.read("stations")), "snapshot/stations_info")


def parse_weeks(text: str) -> tuple:
    return tuple(date.fromisoformat(w) for w in text.split(","))
