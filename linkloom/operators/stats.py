"""Counts and distributions of raw lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, most: int | None = None, out: str = "bucket") -> DataFrame:
    """Rows by value; with ``most`` larger numbers count there."""
    value = F.least(F.col(col), F.lit(most)) if most is not None else F.col(col)
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """How many keys have how many rows."""
    return value_counts(df.groupBy(key).agg(F.count("*").alias("size")), "size", most)


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts by two columns; ``values`` names the table's columns, so no pass is needed to find them."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, values: list, digits: int = 3) -> DataFrame:
    """Means of a column by two others; null where there is no row."""
    means = df.groupBy(rows).pivot(columns, values).agg(F.avg(value))
    return means.select(rows, *[F.round(F.col(f"`{v}`"), digits).alias(str(v)) for v in values])


def describe(df: DataFrame, group: str, value: str, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """mean, quartiles, 99th percentile and largest. Exact percentiles keep a count for each distinct value of a group;
    otherwise sketches of bounded size do."""
    q = (lambda x: F.percentile(value, x)) if exact else (lambda x: F.percentile_approx(value, x, accuracy))
    return df.groupBy(group).agg(F.round(F.avg(value), 4).alias("mean"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), q(0.99).alias("p99"), F.max(value).alias("top"))
