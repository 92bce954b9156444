"""Accuracy over fixed grids: every cell is there, empty ones with null accuracy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import BIN_NAMES
from pagewright.operators.needles import DEPTHS
from pagewright.operators.select import DIFFICULTIES, LENGTHS


def accuracy(correct: Column, total: Column) -> Column:
    return F.try_divide(correct * 100.0, total)


def overall(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """A3: totals; accuracy is 0 without rows, incorrect is neither correct nor an error."""
    total, correct = F.count(F.lit(1)), F.count_if("correct")
    errors = F.count_if(F.col("status") != "success")
    cols = [
        total.alias("total"),
        correct.alias("correct"),
        errors.alias("errors"),
        (total - correct - errors).alias("incorrect"),
        F.coalesce(accuracy(correct, total), F.lit(0.0)).alias("accuracy"),
    ]
    return results.groupBy(*by).agg(*cols) if by else results.agg(*cols)


def grid(spark, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """All cells of fixed axes, a few dozen rows."""
    parts = [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def dense(counts: DataFrame, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Grouped counts on their grid: total and correct 0, accuracy null where nothing fell."""
    cells = grid(counts.sparkSession, axes)
    got = cells.join(counts, list(axes), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return got.select(*axes, zero("total"), zero("correct"), accuracy(F.col("correct"), F.col("total")).alias("accuracy"))


def _counts(results: DataFrame, axes: list[str]) -> DataFrame:
    return results.groupBy(*axes).agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))


def by_axis(results: DataFrame, axis: str, values: tuple[str, ...] = BIN_NAMES) -> DataFrame:
    """A4: accuracy by one axis."""
    return dense(_counts(results, [axis]), {axis: values})


def by_two_axes(results: DataFrame, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Accuracy by each axis and by both, from one pass with grouping sets; the other axis is null where not grouped."""
    (a, va), (b, vb) = axes.items()
    sets = results.groupingSets([[a], [b], [a, b]], a, b).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct")
    )
    one = dense(sets.where("g = 1").drop("g", b), {a: va}).withColumn(b, F.lit(None).cast("string"))
    two = dense(sets.where("g = 2").drop("g", a), {b: vb}).withColumn(a, F.lit(None).cast("string"))
    both = dense(sets.where("g = 0").drop("g"), axes)
    return one.unionByName(two).unionByName(both)


def by_difficulty_and_length(results: DataFrame) -> DataFrame:
    """A5."""
    return by_two_axes(results, {"difficulty": DIFFICULTIES, "length": LENGTHS})


def by_context_and_depth(results: DataFrame) -> DataFrame:
    """A6; rows of unknown depth (F13) are left out."""
    return by_two_axes(results.where("depth <> 'unknown'"), {"context_bin": BIN_NAMES, "depth": DEPTHS})


def by_instance(results: DataFrame) -> DataFrame:
    """A7."""
    counts = _counts(results, ["instance_id"])
    return counts.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def progress(tasks: DataFrame) -> DataFrame:
    """Tasks by split and state, with a grand total (null split)."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return tasks.rollup("split").agg(F.count(F.lit(1)).alias("total"), n("existing"), F.count_if(F.col("state") != "existing").alias("new"), n("completed"), n("failed"))
