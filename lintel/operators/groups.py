"""Grouped steps that many plans share: numbers in order, first by priority, modes, frequencies and ordered texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, form: str, by: Sequence[str] = ("doc_id",), order: str = "ord") -> DataFrame:
    """rows with `order` counted from 0 within each group, and the `id` that its number from 1 gives."""
    counted = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return counted.withColumn(order, F.col("__n") - 1).withColumn("id", F.format_string(form, F.col("__n"))).drop("__n")


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by an order that tells all rows apart: a least struct with partial sums, not a sorted window."""
    least = rows.groupBy(*by).agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*rows.columns).alias("row"))).alias("m"))
    return least.select("m.row.*")


def frequencies(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, freq): how often each value of a group stands, as a map in order of the values."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "__n")))).alias("freq"))


def mode_low(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value): the most frequent value of each group, the lowest of equals."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def text_in_order(order: Sequence[str], text: str, between: str = "") -> Column:
    """The texts of a group one after the other: an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), between)
