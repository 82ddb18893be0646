"""Ranks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(df: DataFrame, group: str, order: str, tie: str, name: str) -> DataFrame:
    """Rank from 1 within each group, nulls in the order last, ties by a column; rows of no group get null."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(order), F.asc(tie))
    return df.withColumn(name, F.when(F.col(group).isNotNull(), F.row_number().over(w)))


def acquisition_order(acquisitions: DataFrame) -> DataFrame:
    """Order of each instrument's acquisitions by time; texts with an offset are compared as instants, a text that is no time fails."""
    instant = F.to_timestamp("acquisition_datetime")
    return rank_in_group(acquisitions.withColumn("_t", instant), "instrument_serial", "_t", "acquisition_id", "acquisition_order").drop("_t")


def first_value_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by a total order; partial limits apply before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
