"""Exact duplicates by progressive refinement, in DataFrame operations only.

Texts are grouped by length; those whose length recurs are grouped by length and
a hash of their first characters; only what still has company is grouped by its
full hash.  One scan makes lengths and hashes as a narrow table, which all steps
read; no text is shuffled.  The full hash is of every text where the caller
asks for it, else of those that the first two steps leave, in a second scan.

Every grouping is an aggregation with map-side partial sums over narrow rows, and
joins split hot keys, so a group that holds a third of all rows costs no more
than others, and no window or list of a group is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, save, skew_join, with_lists


def _full_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(docs: DataFrame, prefix: int = 256, normalise=lambda text: text, with_sha: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normalise(text)`` (a Column function) is identical;
    null counts as empty, and texts of any length are read whole.  Of equal texts
    the largest doc_id stays; a null doc_id is below all others.  Where rows
    repeat both doc_id and text exactly one of them is kept.  An empty table
    gives no rows; further columns are ignored, whatever their names.  Without
    ``with_sha`` texts without company aren't hashed in full.
    """
    spark = docs.sparkSession
    text: Column = F.coalesce(normalise(F.col("text").cast("string")), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    length, head = F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix)).alias("h")
    rows, rows_at = save(base.select("doc_id", length, head, *[_full_hash(F.col("t")).alias("text_sha256")] * with_sha))
    size = F.count(F.lit(1)).alias("size")
    # Lengths that recur, then (length, prefix hash) that recur among those.
    by_length, length_at = save(rows.groupBy("n").agg(size).where("size > 1"))
    by_head, head_at = save(skew_join(rows, by_length, ["n"], "size").groupBy("n", "h").agg(size).where("size > 1"))
    if with_sha:
        own = skew_join(rows, by_head.withColumn("survives", F.lit(True)), ["n", "h"], "size", "left")
    else:
        again = skew_join(base.select("*", length, head), by_head.withColumn("survives", F.lit(True)), ["n", "h"], "size", "left")
        own = again.select("doc_id", "survives", F.when(F.col("survives"), _full_hash(F.col("t"))).alias("text_sha256"))
    found, found_at = save(own.select("doc_id", "survives", "text_sha256"))
    drop(spark, rows_at, length_at, head_at)
    # Each row its number; the found table is written, so numbers are the same for all that reads it.
    found = found.withColumn("row", F.monotonically_increasing_id())
    last = F.max(F.struct("doc_id", "row"))
    groups, _ = save(found.where("survives").groupBy("text_sha256").agg(last.alias("last"), size).where("size > 1").select("text_sha256", "last", F.col("size").alias("group_size"), "size"))
    # Only survivors can be in a group; all others are by themselves.
    marked = skew_join(found.where("survives"), groups, ["text_sha256"], "size", "left").unionByName(found.where("survives is null"), allowMissingColumns=True)
    alone = F.col("group_size").isNull()
    return marked.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows of one doc_id and text count once, the least of them by the other columns."""
    found, _ = save(exact_duplicates(docs, **(options | {"with_sha": True})))
    normalise = options.get("normalise", lambda text: text)
    sha = _full_hash(F.coalesce(normalise(F.col("text").cast("string")), F.lit("")))
    key = ("doc_id", "text_hash")
    one = found.groupBy("doc_id", F.col("text_sha256").alias("text_hash")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    gone, _ = save(one.where("not kept").select(*key))
    left = with_lists(docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_hash"), F.struct(*docs.columns).alias("row")), gone, "left_anti")
    if not one.where("kept and times > 1").isEmpty():
        left = left.groupBy(*key).agg(F.min("row").alias("row"))
    return left.select("row.*")
