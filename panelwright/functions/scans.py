"""Running sums with decay, y[t] = d * y[t-1] + x[t], as associative scans of affine steps.

Two steps y -> a*y + x one after the other are one step again: (a2, x2) after (a1, x1) is (a2*a1, x2 + a2*x1). A scan
by doubling composes each row's step with that of the row 1, 2, 4, 8... before it; after k rounds a row holds the
last 2**k steps. The rounds end where d ** 2**k is no longer a positive double, since nothing farther back counts then,
so there are few rounds whatever the number of rows. No weight grows with the length, nor does anything overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of columns that a scan uses itself.
_STEP, _CARRY, _AT = "__step", "__carry", "__at"


def rounds(decay: float, rows: int | None = None) -> int:
    """Rounds of doubling until all of ``rows`` rows, or all that can count, are composed."""
    least = -math.log(5e-324) / -math.log(decay) if 0 < decay < 1 else 0.0
    reach = least if rows is None else min(float(rows), least)
    return max(0, math.ceil(math.log2(max(reach, 1))))


def decayed(rows: DataFrame, window, decay: float, columns: dict[str, str], span: int | None = None) -> DataFrame:
    """Adds to each row the decayed running sums of ``columns`` (result: summand) in a window's order; NULL counts as 0.

    ``span`` is a known bound of a partition's rows. All windows are the one given, so one sort serves them.
    """
    rows = rows.withColumns({out: F.coalesce(F.col(x), F.lit(0.0)) for out, x in columns.items()})
    for k in range(rounds(decay, span)):
        a = decay ** (2**k)
        rows = rows.withColumns({out: F.col(out) + F.lit(a) * F.coalesce(F.lag(out, 2**k).over(window), F.lit(0.0)) for out in columns})
    return rows


def decayed_by_blocks(rows: DataFrame, keys: tuple[str, ...], block: str, order: tuple[str, ...], decay: float, columns: dict[str, str], row: str) -> DataFrame:
    """``decayed`` for keys with any number of rows, and the row's number from 1 as ``row``.

    ``block`` is a column that doesn't fall along the order, such as the day of a time. Rows are scanned within
    blocks, which are spread over tasks; then the blocks, of which a table with one row each is made, are scanned in
    the same way; what a block takes over from those before it, decayed by the row's place, is added to its rows.
    """
    local = Window.partitionBy(*keys, block).orderBy(*order)
    rows = decayed(rows.withColumn(row, F.row_number().over(local)), local, decay, columns)
    ends = [F.max_by(c, row).alias(f"{_STEP}{i}") for i, c in enumerate(columns)]
    blocks = rows.groupBy(*keys, block).agg(F.max(row).cast("long").alias(_AT), *ends)
    # a block is one step: what came before decays by its number of rows
    blocks = blocks.withColumn("__a", F.pow(F.lit(decay), F.col(_AT)))
    over = Window.partitionBy(*keys).orderBy(block)
    sums = [f"{_STEP}{i}" for i in range(len(columns))]
    blocks = blocks.withColumn("__before", F.sum(_AT).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    for k in range(rounds(decay)):
        near = lambda c: F.coalesce(F.lag(c, 2**k).over(over), F.lit(0.0))  # noqa: B023, E731
        blocks = blocks.withColumns({**{s: F.col(s) + F.col("__a") * near(s) for s in sums}, "__a": F.col("__a") * near("__a")})
    carried = [F.coalesce(F.lag(s).over(over), F.lit(0.0)).alias(f"{_CARRY}{i}") for i, s in enumerate(sums)]
    blocks = blocks.select(*keys, block, F.coalesce("__before", F.lit(0)).alias("__before"), *carried)
    joined = rows.join(blocks, [*keys, block])
    whole = {c: F.col(c) + F.pow(F.lit(decay), F.col(row)) * F.col(f"{_CARRY}{i}") for i, c in enumerate(columns)}
    return joined.withColumns(whole).withColumn(row, F.col(row) + F.col("__before")).drop("__before", *[f"{_CARRY}{i}" for i in range(len(columns))])
