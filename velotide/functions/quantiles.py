"""Exact medians of groups that may be far larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotide.session import materialize

# Bins per unit at each step. A window orders at most this many bins of one group: 360 degrees at
# 4,096 bins each, then 2^18 bins within one of those, then the doubles within 2^-30 of a unit.
STEPS = (2**12, 2**30)


def exact_median(values: DataFrame, group: list[str]) -> DataFrame:
    """Median of ``value`` per group, from rows (group..., value, weight).

    ``value`` must lie within a few hundred units, as degrees do. Equal values should be folded
    into one row with their number as ``weight`` before; NULL values are left out.

    The rank of the median is found by narrowing: counts per coarse bin tell which bin holds it,
    then only the rows of that bin are binned finer, and so on. All counting is distributed by
    (group, bin), so a group with a third of all rows is never gathered in one place; what a
    window orders is bin counts.
    """
    rows = values.filter(F.col("value").isNotNull())
    # Both middle ranks (the same one when the count is odd), 1-based.
    total = rows.groupBy(*group).agg(F.sum("weight").alias("n"))
    low, high = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    target = total.select(
        *group,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), low.alias("rank")),
                F.struct(F.lit(1).alias("side"), high.alias("rank")),
            )
        ),
    )
    within: list[str] = []
    for depth, per_unit in enumerate((*STEPS, None)):
        name = f"bin{depth}"
        if within:
            reached_bins = target.select(*group, *within).distinct()
            rows = rows.join(reached_bins, [*group, *within], "left_semi")
        key: Column = F.col("value") if per_unit is None else F.floor(F.col("value") * per_unit)
        rows = rows.withColumn(name, key)
        bins = rows.groupBy(*group, *within, name).agg(F.sum("weight").alias("weight"))
        reached = bins.join(target, [*group, *within])
        so_far = (
            Window.partitionBy(*group, "side")
            .orderBy(name)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        before = F.col("seen") - F.col("weight")
        # Two rows per group, used twice in the next step: written once, not planned twice.
        target = materialize(
            reached.withColumn("seen", F.sum("weight").over(so_far))
            .filter((before < F.col("rank")) & (F.col("rank") <= F.col("seen")))
            .select(*group, *within, name, "side", (F.col("rank") - before).alias("rank"))
        )
        within.append(name)
    return target.groupBy(*group).agg(F.avg(within[-1]).alias("median"))
