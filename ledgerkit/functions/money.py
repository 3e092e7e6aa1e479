"""Money as integer cents: parsing, exact splitting, half-even rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_cents(text: Column) -> Column:
    """``$1,234.56``, ``(13.75)``, ``-$ 2`` -> cents; null where the text is no amount or has a fraction of a cent."""
    bare = F.regexp_replace(text, r"[\s$,]", "")
    negative = bare.startswith("(") & bare.endswith(")")
    value = F.regexp_replace(bare, r"^\((.*)\)$", "$1").try_cast("decimal(24,8)") * 100
    whole = value.cast("decimal(24,0)")
    cents = F.when(value == whole, whole.cast("long"))
    return F.when(negative, -cents).otherwise(cents)


def even_spread(cents: Column, parts: Column) -> Column:
    """Array of ``parts`` cents that sum to ``cents``; the extra ones come first, negative amounts mirror positive ones."""
    size = F.abs(cents)
    sign = F.when(cents < 0, -1).otherwise(1)
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: (sign * (F.floor(size / parts) + F.when(i < size % parts, 1).otherwise(0))).cast("long"))


def largest_remainder(rows: DataFrame, group: Sequence[str], total: str, weight: str, order: Sequence[str]) -> DataFrame:
    """``rows`` plus ``part``: each group's ``total`` split in proportion to ``weight``, exact to the cent.

    Shares are rounded down and the cents that are left go to the largest remainders, then by ``order``
    (which must be total within a group). Weights that sum to 0 give all to the first row. A negative
    total is split like its absolute value. Two windows over one partitioning: a single shuffle.
    """
    by = Window.partitionBy(*group)
    wide = "decimal(38,0)"
    sums = rows.withColumn("__w", F.sum(F.col(weight).cast(wide)).over(by)).withColumn("__nth", F.row_number().over(by.orderBy(*order)))
    parts = sums.withColumn("__q", F.when(F.col("__w") > 0, F.expr(f"(abs({total}) * cast({weight} as decimal(38,0))) div __w")).otherwise(F.lit(0)).cast("long"))
    parts = parts.withColumn("__r", F.when(F.col("__w") > 0, F.expr(f"(abs({total}) * cast({weight} as decimal(38,0))) % __w")).otherwise(F.lit(0)).cast(wide))
    parts = parts.withColumn("__short", F.abs(F.col(total)) - F.sum("__q").over(by)).withColumn("__rank", F.row_number().over(by.orderBy(F.desc("__r"), *order)))
    extra = F.when(F.col("__w") > 0, (F.col("__rank") <= F.col("__short")).cast("long")).otherwise(F.when(F.col("__nth") == 1, F.col("__short")).otherwise(0))
    sign = F.when(F.col(total) < 0, -1).otherwise(1)
    return parts.withColumn("part", (sign * (F.col("__q") + extra)).cast("long")).drop("__w", "__nth", "__q", "__r", "__short", "__rank")


def half_even(x: Column) -> Column:
    """Python's rounding: halves go to the even neighbour."""
    return F.bround(x, 0).cast("long")
