from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from helpers import frame, rows_by
from pyspark.sql import functions as F

from velotide.functions import metrics as M
from velotide.plans import analysis as A
from velotide.plans import dashboard as D
from velotide.plans import explore as X
from velotide.plans import rebalancing as K
from velotide.plans import report as R

SCHEMA = ("model string, test_week timestamp_ntz, station_id string, ts timestamp_ntz, target string, "
          "y double, yhat double, yhat_lower double, yhat_upper double, is_holiday boolean, "
          "date date, hour int, season string, hour_band string, weather string, holiday_name string")  # fmt: skip
MON = datetime(2025, 1, 13)


def row(model, day, hour, target, y, yhat, station="A", **more):
    return {"model": model, "test_week": MON, "station_id": station, "ts": day + timedelta(hours=hour),
            "target": target, "y": float(y), "yhat": float(yhat), "is_holiday": False, "date": day.date(),
            "hour": hour, "season": "winter", "hour_band": "night 0-5", **more}


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 1.0)], "y double, yhat double")
    got = df.agg(M.mae(), M.rmse(), M.wape(), M.bias()).first()
    assert got[0] == pytest.approx(4 / 3) and got[1] == pytest.approx((10 / 3) ** 0.5)
    assert got[2] == pytest.approx(4 / 6) and got[3] == pytest.approx(-2 / 3)
    zero = spark.createDataFrame([(0.0, 1.0)], "y double, yhat double").agg(M.wape()).first()[0]
    assert zero is None
    pair = spark.range(1).select(M.skill(F.lit(0.5), F.lit(2.0)), M.skill(F.lit(0.5), F.lit(0.0))).first()
    assert tuple(pair) == (0.75, None)
    bounds = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (3.0, 1.0, 2.0), (0.0, 1.0, 2.0)],
                                   "y double, yhat_lower double, yhat_upper double")
    assert bounds.agg(M.coverage()).first()[0] == 0.5
    nan = spark.createDataFrame([(1.0, float("nan")), (None, 1.0), (1.0, 1.0)], "y double, yhat double")
    with pytest.raises(ValueError, match="2 rows"):
        M.require_complete(nan, "y", "yhat")


def test_models_must_be_scored_on_the_same_rows(spark):
    full = [row("seasonal_naive", MON, h, "arrivals", 1, 1) for h in range(4)]
    same = [{**r, "model": "other"} for r in full]
    assert R.require_identical_rows(frame(spark, full + same, SCHEMA))
    extra = [row("other", MON, 9, "arrivals", 1, 1)]
    with pytest.raises(ValueError, match="different rows.*1 extra, 2 missing"):
        R.require_identical_rows(frame(spark, full + same[:2] + extra, SCHEMA))


def test_skill_is_against_the_same_group_and_groups_need_baselines(spark):
    rows = []
    for target, naive, average, other in (("arrivals", 2, 1, 0.5), ("departures", 4, 8, 2)):
        for model, miss in (("seasonal_naive", naive), ("historical_average", average), ("alpha", other)):
            rows.append(row(model, MON, 8, target, 10, 10 + miss))
    rows.append(row("alpha", MON, 8, "lonely", 1, 1))
    got = R.scored_table(frame(spark, rows, SCHEMA), ["target"]).collect()
    assert [(r["target"], r["model"]) for r in got[:3]] == [
        ("arrivals", "seasonal_naive"), ("arrivals", "alpha"), ("arrivals", "historical_average")]
    assert len(got) == 6
    assert (got[1]["skill"], got[1]["skill_vs_hist_avg"]) == (0.75, 0.5)
    assert (got[4]["skill"], got[4]["skill_vs_hist_avg"]) == (0.5, 0.75)


def test_interval_report_lists_only_models_with_intervals(spark):
    bounds = {"yhat_lower": 0.0, "yhat_upper": 2.0}
    rows = [row("seasonal_naive", MON, h, "departures", y, 1) for h, y in enumerate((0, 2, 5, 1))]
    rows += [{**r, "model": "fan", **bounds} for r in rows]
    got = rows_by(R.interval_report(frame(spark, rows, SCHEMA)), "model", "group")
    assert set(k[0] for k in got) == {"fan"}
    whole = got[("fan", "all")]
    assert (whole["coverage"], whole["mean_width"], whole["n"]) == (0.75, 2.0, 4)
    assert set(k[1] for k in got) == {"all", "target: departures", "season: winter", "hours: night 0-5"}


def test_groups_follow_week_season_rain_and_bands(spark):
    rows = [row("m", datetime(2025, 3, 1), h, "arrivals", 1, 1) for h in (0, 6, 10, 16, 20)]
    rows.append(row("m", datetime(2025, 3, 3), 5, "arrivals", 1, 1))
    w = spark.createDataFrame([(datetime(2025, 3, 1, 1), 0.6), (datetime(2025, 3, 1, 9), 0.4)],
                              "ts timestamp_ntz, precip_mm double")
    got = rows_by(R.add_groups(frame(spark, rows, SCHEMA).drop("season", "hour_band", "weather"), w), "ts")
    saturday = got[datetime(2025, 3, 1, 0)]
    assert (saturday["day_type"], saturday["season"], saturday["weather"]) == ("weekend", "winter", "rainy")
    assert [got[datetime(2025, 3, 1, h)]["hour_band"].split()[0] for h in (0, 6, 10, 16, 20)] == [
        "night", "am", "midday", "pm", "evening"]
    assert got[datetime(2025, 3, 3, 5)]["weather"] is None


def test_morning_flow_is_signed_and_needs_whole_working_mornings(spark):
    rows = []
    for h in (7, 8, 9):
        for target, y, yhat in (("arrivals", 1, 2), ("departures", 5, 6)):
            rows.append(row("m", MON, h, target, y, yhat))
            rows.append(row("m", MON + timedelta(days=5), h, target, y, yhat))
            rows.append(row("m", MON + timedelta(days=1), h, target, y, yhat, is_holiday=True))
            if h < 9:
                rows.append(row("m", MON + timedelta(days=2), h, target, y, yhat))
    got = A.morning_net_flow(frame(spark, rows, SCHEMA), "m").collect()
    assert [(r["date"], r["forecast"], r["actual"]) for r in got] == [(MON.date(), -12.0, -12.0)]


def test_net_flow_does_not_depend_on_the_order_of_rows(spark):
    """0.1 + 0.2 + 0.7 is 1 as doubles, and less in the other order: a threshold of 1 would see both."""
    values = [("arrivals", h, v) for h, v in ((7, 0.1), (8, 0.2), (9, 0.7))]
    values += [("departures", h, 0.0) for h in (7, 8, 9)]
    found = set()
    for order in (values, values[::-1], values[1:] + values[:1]):
        rows = [row("m", MON, h, target, v, v) for target, h, v in order]
        found.add(A.morning_net_flow(frame(spark, rows, SCHEMA).coalesce(1), "m").first()["forecast"])
    assert found == {1.0}


def test_station_scores_and_bias(spark):
    rows = [row("historical_average", MON, 8, "arrivals", 4, 2), row("best", MON, 8, "arrivals", 4, 5)]
    info = spark.createDataFrame([("A", "Alder", 10)], "canonical_id string, name string, rank_volume long")
    preds = frame(spark, rows, SCHEMA)
    got = A.station_scores(preds, info, ["historical_average", "best"]).first()
    assert (got["skill_best"], got["mean_actual"], got["name"]) == (0.5, 4.0, "Alder")
    assert A.bias_by_hour(preds, ["best"]).first()["best"] == 1.0


def test_average_ranks_share_ties(spark):
    rows = [("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)]
    df = spark.createDataFrame(rows, "station_id string, skill_m double").withColumns(
        {"mae_m": F.col("skill_m"), "mean_actual": F.lit(1.0), "name": F.col("station_id")}
    )
    got = rows_by(A.relative_errors(df, "m"), "station_id")
    assert [got[s]["skill_rank"] for s in "abcd"] == [1.0, 2.5, 2.5, 4.0]
    assert [got[s]["relative_error_rank"] for s in "abcd"] == [4.0, 2.5, 2.5, 1.0]


def test_ranks_across_many_ranges(spark):
    values = [None if i % 13 == 0 else float(i * 37 % 101) for i in range(400)]
    rows = [(f"s{i}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "station_id string, skill_m double").withColumns(
        {"mae_m": F.col("skill_m"), "mean_actual": F.lit(1.0), "name": F.col("station_id")}
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = rows_by(A.relative_errors(df, "m"), "station_id")
    finally:
        spark.conf.unset(coalesce)
    want = pd.Series(values, dtype="float64")
    for column, rank in (("skill_rank", want.rank()), ("relative_error_rank", want.rank(ascending=False))):
        assert [got[f"s{i}"][column] for i in range(400)] == [None if pd.isna(r) else r for r in rank]


@pytest.fixture(scope="module")
def flows(spark):
    rows = []
    for station, n, forecast, actual in (
        ("DRAIN", 25, lambda i: -10.0, lambda i: -8.0 if i < 20 else 2.0),
        ("FILL", 25, lambda i: 12.0, lambda i: 14.0),
        ("MIXED", 25, lambda i: -6.0 if i < 19 else 1.0, lambda i: -6.0),
        ("SHORT", 10, lambda i: -10.0, lambda i: -10.0),
    ):
        rows += [(station, MON.date() + timedelta(days=i), forecast(i), actual(i)) for i in range(n)]
    return spark.createDataFrame(rows, "station_id string, date date, forecast double, actual double")


def test_labels_and_summary(spark, flows):
    table = K.classify(flows)
    labels = {k: r["label"] for k, r in rows_by(table, "station_id").items()}
    assert labels == {"DRAIN": "drains", "FILL": "fills", "MIXED": "mixed", "SHORT": "too few days"}
    got = rows_by(K.summarize(flows, table), "label")
    drains, fills = got["drains"], got["fills"]
    assert (drains["stations"], drains["bikes_forecast"], drains["bikes_actual"]) == (1, 10.0, 8.0)
    assert drains["hit_rate"] == pytest.approx(0.8) and drains["weekdays"] == 25
    assert (fills["bikes_forecast"], fills["hit_rate"]) == (12.0, 1.0)
    none = K.summarize(flows.filter("station_id = 'MIXED'"), table.filter("station_id = 'MIXED'"))
    assert {(r["stations"], r["hit_rate"]) for r in none.collect()} == {(0, None)}
    names = spark.createDataFrame([("FILL", "Fir")], "canonical_id string, name string")
    assert K.ranked_list(table, names, "drains").first()["name"] == "DRAIN"


def test_dashboard_tables(spark):
    rows = []
    for model, miss in (("seasonal_naive", 2), ("historical_average", 1), ("best", 0.5)):
        for h in (7, 8, 9):
            for target, y in (("arrivals", 10), ("departures", 4)):
                rows.append(row(model, MON, h, target, y, y + miss))
    preds = frame(spark, rows, SCHEMA)
    flow = D.window_net_flow(preds, "best", MON.date())
    assert tuple(flow.first()) == ("A", 18.0, 18.0)
    partial = preds.filter("NOT (hour = 9 AND target = 'arrivals')")
    assert D.window_net_flow(partial, "best", MON.date()).count() == 0
    got = D.comparison_table(preds).collect()
    assert [r["model"] for r in got] == ["seasonal_naive", "best", "historical_average"]
    assert (got[1]["skill"], got[1]["skill_vs_hist_avg"]) == (0.75, 0.5)
    assert D.week_of(preds, MON.date()).first()[0] == MON
    assert [r[0] for r in D.backtest_days(preds).collect()] == [MON.date()]


def test_rebalancing_list_drops_the_wrong_sign_after_the_limit(spark):
    rows = [(f"s{i}", float(v), 0.0) for i, v in enumerate((-3, -1, 2, 4, 6))]
    flow = spark.createDataFrame(rows, "station_id string, forecast double, actual double")
    info = flow.select("station_id", F.upper("station_id").alias("name"))
    got = D.rebalancing_list(flow, info, 4).collect()
    sides = [(r["side"], r["forecast"]) for r in got]
    assert sorted(sides) == [("drains", -3.0), ("drains", -1.0), ("fills", 2.0), ("fills", 4.0), ("fills", 6.0)]


def test_centred_mean_needs_every_day(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(12) if i != 9]
    daily = spark.createDataFrame([(d, d.day) for d in days], "date date, departures long")
    got = {r["date"].day: r["centred_mean"] for r in X.centred_mean(daily).collect()}
    assert len(got) == 11
    assert {d: m for d, m in got.items() if m is not None} == {4: 4.0, 5: 5.0, 6: 6.0}
