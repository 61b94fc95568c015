"""Forecast errors as aggregate expressions, so that any number of them costs one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _error(y: str, yhat: str) -> Column:
    return F.col(y) - F.col(yhat)


def mae(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(_error(y, yhat)))


def rmse(y: str = "y", yhat: str = "yhat") -> Column:
    return F.sqrt(F.avg(_error(y, yhat) * _error(y, yhat)))


def wape(y: str = "y", yhat: str = "yhat") -> Column:
    """Total absolute error over total actual; NULL when nothing happened."""
    total = F.sum(F.col(y))
    return F.when(total > 0, F.sum(F.abs(_error(y, yhat))) / total)


def bias(y: str = "y", yhat: str = "yhat") -> Column:
    """Mean of forecast minus actual: positive means too many trips were forecast."""
    return F.avg(-_error(y, yhat))


def skill(model_mae: Column, baseline_mae: Column) -> Column:
    """One minus the ratio of errors; NULL when the baseline makes none."""
    return F.lit(1.0) - F.try_divide(model_mae, baseline_mae)


def coverage(y: str = "y", lower: str = "yhat_lower", upper: str = "yhat_upper") -> Column:
    """Share of actuals inside the interval, bounds included."""
    inside = (F.col(y) >= F.col(lower)) & (F.col(y) <= F.col(upper))
    return F.avg(inside.cast("int"))


def missing_inputs(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows a metric over these columns must refuse (NULL or NaN)."""
    bad = F.lit(False)
    for name in columns:
        value = F.col(name).cast("double")
        bad = bad | value.isNull() | F.isnan(value)
    return df.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("rows_missing"),
    )


def require_complete(df: DataFrame, *columns: str) -> DataFrame:
    """Return ``df`` itself, or raise when a metric over these columns would meet a gap."""
    found = missing_inputs(df, *columns).first()
    if found["rows_missing"]:
        raise ValueError(f"{found['rows_missing']} rows lack a value in {columns}; nothing scored")
    return df
