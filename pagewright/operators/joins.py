"""Joins, look-ups and ordering of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.partitioning import kept


def matched(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their truth; columns pred and gt."""
    return pred.select(*keys, F.col("text").alias("pred")).join(gt.select(*keys, F.col("text").alias("gt")), keys)


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the left without a row on the right."""
    return left.join(right, keys, "left_anti").select(*keys)


def last_of_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``; one aggregation with map-side partial results, no window."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r"))
    return last.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def numbered(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Rows with their place in ``order`` from 0: ranges sorted apart, then offset by the counts before them.

    The sorted ranges are kept, since both what counts and what numbers them must see ties in one order.
    """
    dealt = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).sortWithinPartitions(order)
    local = dealt.withColumn("__m", F.monotonically_increasing_id()).withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    local = kept(local)
    counts = local.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__b"))  # a row a partition
    return local.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__m", "__p", "__i", "__b")


def pages_of(instances: DataFrame, files: DataFrame, key: str = "_id") -> DataFrame:
    """Instances with the sorted names of their page images ``<id>_*.png``; without any they go.

    files: one column ``name`` of base names.  The id is all before the last
    underscore, or before ``_page_`` where that stands.
    """
    stem = F.regexp_extract("name", r"^(.*?)(?:_page)?_[^_]*\.png$", 1)
    own = files.where(F.col("name").rlike(r"_[^_]*\.png$")).select(stem.alias(key), "name")
    lists = own.groupBy(key).agg(F.sort_array(F.collect_list("name")).alias("pages"))
    return instances.join(lists, key)


def with_instances(results: DataFrame, instances: DataFrame, columns: list[str]) -> DataFrame:
    """Results with columns of their instance; results without one go."""
    return results.join(instances.select(F.col("_id").alias("instance_id"), *columns), "instance_id")


def zipped(a: Column, b: Column) -> Column:
    """Pairs by position up to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, F.greatest(n, F.lit(0))).alias("a"), F.slice(b, 1, F.greatest(n, F.lit(0))).alias("b"))


def question_rows(instances: DataFrame) -> DataFrame:
    """Q8: one row for each question with its answer and index."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size("questions"), F.size("answers")) - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.get("questions", i).alias("q"), F.get("answers", i).alias("a")))
    some = instances.where(F.least(F.size("questions"), F.size("answers")) > 0)
    return some.withColumn("__p", F.explode(pairs)).select(
        *instances.columns, F.col("__p.i").alias("question_idx"), F.col("__p.q").alias("question"), F.col("__p.a").alias("answer")
    )


def truth_split(split: Column) -> Column:
    """The split whose ground truth a split is scored against."""
    size = F.regexp_extract(split, r"(fontsize_[0-9]+)", 1)
    return F.when(size != "", F.concat(F.lit("adv_"), size)).otherwise("clean")


def split_of(path: Column) -> Column:
    """The folder above ``images`` in a path; empty without one."""
    return F.regexp_extract(path, r"([^/]+)/images/[^/]+$", 1)


def named_secret(question: Column, secrets: Column) -> Column:
    """The first secret whose key the question names."""
    return F.get(F.filter(secrets, lambda s: F.instr(F.lower(question), F.lower(s["key"])) > 0), F.lit(0))


def nearest(points: Column, target: Column) -> Column:
    """The point nearest to the target, the smaller of two as near."""
    return F.array_min(F.transform(points, lambda b: F.struct(F.abs(b - target).alias("d"), b.alias("b"))))["b"]


def side_by_side(summaries: DataFrame, key: str, models: list[str], value: str) -> DataFrame:
    """U4: one row for each key with a column for each model."""
    return summaries.groupBy(key).pivot("model", models).agg(F.first(value))
