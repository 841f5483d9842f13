"""Column helpers used throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 6) -> Column:
    """Doubles, half to even of the scaled double, as SQL's round_even does; bround would decide halves by the shortest decimal text."""
    return F.rint(c * float(10**places)) / float(10**places)


def summed(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str = "value") -> DataFrame:
    """(keys, name, n, first): sums and counts of groups, added up one row after the other in a fixed order, and where each group begins in it.

    A sum of doubles depends on its order, so sums that are compared or ranked mustn't follow how rows lie in files and tasks.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("running_", F.sum(value).over(w))
    return running.groupBy(*keys).agg(F.max_by("running_", F.struct(*order)).alias(name), F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0.0)) != 0, a / F.when(b != 0, b)).otherwise(0.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def bands(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step whose bound c reaches; steps go from high to low."""
    out = None
    for bound, value in steps:
        out = F.when(c >= bound, F.lit(value)) if out is None else out.when(c >= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, joined by '; ' in order."""
    return F.concat_ws("; ", *[F.when(cond, F.lit(text)) for cond, text in pairs])


def points(*pairs: tuple[Column, float]) -> Column:
    """The sum of the points whose condition holds; unknown counts as not."""
    total = F.lit(0.0)
    for cond, value in pairs:
        total = total + F.when(cond, F.lit(float(value))).otherwise(0.0)
    return total


def epoch_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
