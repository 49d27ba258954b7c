"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import spread  # noqa: F401
from ..sources.staging import staged as materialize

#: Stripes a group is cut into when an exact number of its rows is taken.
STRIPES = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alike(col: Column) -> Column:
    """Letters and digits of a text without regard to case; null is like blank.

    Upper case is the folded form, since it also unites sharp s with SS.
    """
    return F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]", "")


def folded(col: Column) -> Column:
    """Lower case without outer white space; null stays null."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def nonblank(col: Column) -> Column:
    return F.coalesce(F.regexp_replace(col, r"(?U)\s+", ""), F.lit("")) != ""


def running_total(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Add to each row the sum of ``value`` over all rows before it in ``order``.

    Rows are range-partitioned; only one total per partition reaches the driver,
    so no task ever sees more than its own range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    )
    sums = {r[0]: r[1] for r in placed.groupBy("_pid").agg(F.sum(value)).collect()}
    base, at = [], 0
    for pid in sorted(sums):
        base.append((pid, at))
        at += int(sums[pid] or 0)
    offsets = spark.createDataFrame(base or [(-1, 0)], "_pid int, _base long")
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(w), F.lit(0)))
        .drop("_pid", "_base")
    )


def take_exactly(df: DataFrame, group: list[str], quota: DataFrame, priority: Column, wanted: str = "take") -> DataFrame:
    """Of each group keep the ``quota[wanted]`` rows of smallest priority.

    A group's rows are spread over ``STRIPES`` slices of the priority range.
    Slice counts are combined before the shuffle; whole slices are taken until the
    quota falls inside one, and only that slice is ranked. A group of any size
    is therefore never in one task.
    """
    rows = df.withColumn("_p", priority).withColumn(
        "_s", F.shiftright(F.col("_p"), 56).cast("int")
    )
    counts = rows.groupBy(*group, "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    takes = (
        counts.join(quota, group)
        .withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .withColumn("_take", F.least(F.col("_n"), F.col(wanted) - F.col("_before")))
        .where("_take > 0")
        .select(*group, "_s", "_n", "_take")
    )
    rank = F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_p", *[c for c in df.columns if c not in group][:1]))
    return (
        rows.join(takes, [*group, "_s"])
        .withColumn("_r", rank)
        .where("_r <= _take")
        .drop("_p", "_s", "_n", "_take", "_r")
    )
