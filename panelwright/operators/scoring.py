"""The confidence score: proximity of each value to the successful median of its side, weighted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import params
from panelwright.schema import CRITERIA


def proximity(value: Column, median, spread) -> Column:
    """1 at the median, 0 from the spread on; null for a missing value or without an anchor."""
    if not isinstance(median, Column) and median is None:
        return F.lit(None).cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(value - median) / spread))


def bonus(critical: Column, high: Column) -> Column:
    """Points for several important hits."""
    return F.when(critical >= 2, 5.0).when((critical >= 1) & (high >= 2), 3.0).otherwise(0.0)


def percentage(total: Column, most: Column) -> Column:
    """The total, at most 100, in percent of the maximum; 0 for no maximum."""
    return F.coalesce(F.try_divide(F.least(total, F.lit(100.0)), most) * 100, F.lit(0.0))


def score(side: Column, supplied: tuple[str, ...] = CRITERIA) -> Column:
    """The score as one expression, with the tables' numbers as constants.

    Parameters that are not supplied, and values that are null, add to the maximum only.
    """

    def one(name: str) -> Column:
        rows = [r for r in params.rows() if r[0] == name]
        most = F.lit(sum(r[5] * 100 for r in rows))
        near = {r[1]: proximity(F.col(r[1]), r[7], r[9]) for r in rows if r[1] in supplied}
        add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
        points = add([F.coalesce(near[r[1]] * r[5] * 100, F.lit(0.0)) for r in rows if r[1] in near])
        hits = lambda kind: add([F.when(near[r[1]] > 0.5, 1.0).otherwise(0.0) for r in rows if r[1] in near and r[6] == kind])
        return percentage(points + bonus(hits("critical"), hits("high")), most)

    return F.when(side == "Long", one("Long")).when(side == "Short", one("Short")).otherwise(F.lit(0.0))


def grade(confidence: Column, what: int = 1) -> Column:
    """The grade of a score, or with ``what=2`` its class."""
    out = None
    for row in params.GRADES:
        out = F.when(confidence >= row[0], row[what]) if out is None else out.when(confidence >= row[0], row[what])
    return out.otherwise(params.LOWEST_GRADE[what - 1])


def breakdown(rows: DataFrame, keys: tuple[str, ...], side: str = "side", supplied: tuple[str, ...] = CRITERIA, table: DataFrame | None = None) -> DataFrame:
    """One row per parameter: (keys, side, param, value, status, proximity, contribution, max_contribution, importance).

    ``rows`` has ``side`` and the supplied parameters. The parameter table has 18 rows and is broadcast. A
    parameter whose table row has no median has the status ``no_stats`` and adds to the maximum only.
    """
    table = params.table(rows.sparkSession) if table is None else table
    values = F.map_from_arrays(F.array(*[F.lit(p) for p in supplied]), F.array(*[F.col(p).cast("double") for p in supplied]))
    joined = rows.select(*keys, F.col(side).alias("side"), values.alias("__values")).join(F.broadcast(table), "side")
    value = F.try_element_at("__values", F.col("param"))
    near = proximity(value, F.col("median"), F.col("spread"))
    status = F.when(F.col("median").isNull(), "no_stats").when(value.isNull(), "missing").when(near == 0, "far_from_median").when(near <= 0.5, "near_median").otherwise("optimal_proximity")
    return joined.select(
        *keys,
        "side",
        "param",
        "ord",
        value.alias("value"),
        status.alias("status"),
        near.alias("proximity"),
        F.coalesce(near * F.col("weight") * 100, F.lit(0.0)).alias("contribution"),
        (F.col("weight") * 100).alias("max_contribution"),
        "importance",
    )


def summary(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key of a breakdown: points, bonus, maximum, score and hits."""
    hit = lambda kind: F.count_if((F.col("proximity") > 0.5) & (F.col("importance") == kind))
    s = parts.groupBy(*keys).agg(F.sum("contribution").alias("points"), F.sum("max_contribution").alias("max_score"), hit("critical").alias("critical_hits"), hit("high").alias("high_hits"))
    s = s.withColumn("bonus", bonus(F.col("critical_hits"), F.col("high_hits")))
    return s.withColumn("confidence_score", percentage(F.col("points") + F.col("bonus"), F.col("max_score")))


def scored(signals: DataFrame) -> DataFrame:
    """Adds confidence_score, confidence_grade and confidence_class to classified signals."""
    from panelwright.operators.signals import is_error, side

    s = signals.withColumn("side", side())
    s = s.withColumn("confidence_score", F.when(F.col("side").isNotNull(), score(F.col("side"))).otherwise(0.0))
    scored_ = F.col("side").isNotNull()
    return s.withColumns({
        "confidence_grade": F.when(is_error(), params.LOWEST_GRADE[0]).when(scored_, grade(F.col("confidence_score"))).otherwise("N/A"),
        "confidence_class": F.when(is_error(), params.LOWEST_GRADE[1]).when(scored_, grade(F.col("confidence_score"), 2)).otherwise("neutral"),
    })
