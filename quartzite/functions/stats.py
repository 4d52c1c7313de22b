"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.functions.exprs import col

#: A statistic of fewer eligible captures is not shown; up to MANY it is called descriptive only.
FEW, MANY = 3, 5


def nearest_rank(value: str, p: int, where: str | None = None) -> Column:
    """The value at rank ceil(p n / 100) of n sorted values; NULL of none."""
    keep = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value}){keep}")


def median_where(value: Column | str, where: Column) -> Column:
    """The interpolated median of what passes; NULL of none."""
    return F.median(F.when(where, col(value)))


def count_where(where: Column) -> Column:
    return F.count_if(where)


def distinct_where(value: Column | str, where: Column) -> Column:
    return F.count_distinct(F.when(where, col(value)))


def once(df: DataFrame, keys: list[str], value: str, flags: dict[str, Column]) -> DataFrame:
    """df with flags: each true in one row of each value within keys for which it holds in any row; never for a NULL value.

    So a distinct count is a plain count of a flag. The rows are dealt by keys and value once, where distinct counts
    side by side would multiply each row by their number.
    """
    same = Window.partitionBy(*keys, value)
    first = (F.row_number().over(same.orderBy(value)) == 1) & F.col(value).isNotNull()
    return df.withColumns({name: first & F.coalesce(F.max(flag).over(same), F.lit(False)) for name, flag in flags.items()})


def reasons(value: Column | str, where: Column | None = None) -> Column:
    """Distinct values that pass, sorted and comma-separated; NULL of none."""
    v = col(value) if where is None else F.when(where, col(value))
    found = F.array_sort(F.collect_set(v))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def ordered_values(value: str, order: list[str], where: Column) -> Column:
    """The values that pass as an array in the given order; NULL of none."""
    rows = F.array_sort(F.collect_list(F.when(where & F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))))
    return F.when(F.size(rows) > 0, F.transform(rows, lambda x: x["_v"]))


def span_sum(value: Column | str) -> Column:
    """Sum of lengths of time, not negative. Whole seconds and fractions are added apart, where long ones lose no digits, so that the order of rows doesn't show."""
    v = col(value)
    return F.sum(v - v % 1) + F.sum(v % 1)


def side(value: Column | str, where: Column) -> Column:
    return F.max(F.when(where, col(value)))


def uniform(*values: str) -> Column:
    """Does each column have exactly one distinct value in the group?"""
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(F.min(v) == F.max(v), F.lit(False))
    return out


def gated(stat: Column | str, n: Column | str, least: int = FEW) -> Column:
    return F.when(col(n) >= least, col(stat))


def sample_label(n: Column | str, under: str = "insufficient_under_3", few: str = "descriptive_only_3_to_5", many: str = "descriptive_sample_over_5") -> Column:
    return F.when(col(n) < FEW, under).when(col(n) <= MANY, few).otherwise(many)


def share_of_total(df: DataFrame, within: list[str], n: str, total: str, out: str) -> DataFrame:
    """Adds the total of n over `within` and n's share of it."""
    w = Window.partitionBy(*within)
    return df.withColumn(total, F.sum(n).over(w)).withColumn(out, F.col(n).cast("double") / F.nullif(F.col(total), F.lit(0)))
