"""Choosing records: exclusion lists, filters, the longest texts, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import count_words
from pagewright.operators.joins import numbered
from pagewright.operators.partitioning import kept

#: What the final exclusion list leaves out.
MOST_TOKENS, LEFT_OUT_DOMAIN = 64000, "Long Structured Data Understanding"
#: Short codes of domains.
DOMAIN_CODES = {
    "Long In-context Learning": "d0",
    "Long Doc Understanding": "d1",
    "Long Context QA": "d2",
    "Long Summarization": "d3",
    "Long Synthetic": "d4",
    "Long Code Completion": "d5",
}
DIFFICULTIES, LENGTHS = ("easy", "medium", "hard"), ("short", "medium", "long")


def excluded(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows not on the list; a null key is kept. The planner broadcasts the list when it is small."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def first_rows(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """O1: the first n rows by order; none or 0 is all."""
    return df.orderBy(F.col(order).asc_nulls_first()).limit(n) if n else df


def exclude_then_limit(df: DataFrame, ids: DataFrame, key: str, n: int | None, order: str) -> DataFrame:
    """F1."""
    return first_rows(excluded(df, ids, key), n, order)


def limit_then_exclude(df: DataFrame, ids: DataFrame, key: str, n: int | None, order: str) -> DataFrame:
    """F2."""
    return excluded(first_rows(df, n, order), ids, key)


def listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows on the list."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows without output so far (failed ones have some)."""
    return excluded(df, done.select(key), key)


def one_sample(df: DataFrame, unique_id: str) -> DataFrame:
    """F7."""
    return df.where(F.col("unique_id") == unique_id)


def with_id(df: DataFrame, key: str) -> DataFrame:
    """F8: rows with a non-empty id."""
    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def too_long(tokens: Column, domain: Column) -> Column:
    """over the token limit, or of the domain left out."""
    return (tokens > MOST_TOKENS) | F.coalesce(domain == LEFT_OUT_DOMAIN, F.lit(False))


def final_exclusions(df: DataFrame, tokens: Column) -> DataFrame:
    """Ids of rows with a context that :func:`too_long` holds for."""
    return df.where(F.col("context").isNotNull() & too_long(tokens, F.col("domain"))).select("_id")


def first_text(text: Column, context: Column, question: Column) -> Column:
    """the first of the fields that is there; an empty one there counts."""
    return F.coalesce(text, context, question)


def known_levels(df: DataFrame) -> DataFrame:
    """known difficulty and known length only."""
    return df.where(F.col("difficulty").isin(*DIFFICULTIES) & F.col("length").isin(*LENGTHS))


def known_depth(df: DataFrame) -> DataFrame:
    """F13."""
    return df.where(F.col("depth") != "unknown")


def essential(df: DataFrame) -> DataFrame:
    """F15."""
    return df.select("unique_id", "image_paths", "bboxes")


def unique_ids(df: DataFrame) -> DataFrame:
    """F16: unique_id, taken from _id where it is missing."""
    own = F.col("unique_id") if "unique_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("unique_id", F.coalesce(own, F.col("_id")))


def short_name(domain: Column, row_id: Column) -> Column:
    """domain code and the id's first eight characters."""
    codes = F.create_map(*[F.lit(x) for kv in DOMAIN_CODES.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(codes, domain), F.lit("dx")), F.lit("_"), F.substring(row_id, 1, 8))


def task_path(path: Column, task: Column) -> Column:
    """the path with the task's folder after its first ``data`` part; unchanged without one."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "data").cast("int")
    new = F.array_join(F.concat(F.slice(parts, 1, at), F.array(task), F.slice(parts, at + 1, F.size(parts))), "/")
    return F.when(at > 0, new).otherwise(path)


def longest(df: DataFrame, key: str, size: Column, percent: float, order: str, n: int | None = None) -> DataFrame:
    """The keys of the ``percent`` largest rows (cut to a whole number), ties in input order.

    n: the number that the share is of; by default all rows.  The size at the
    cut comes from the counts by size; all larger rows are in, and only rows of
    just that size are numbered, over all tasks.
    """
    rows = kept(df.select(key, size.cast("long").alias("__s"), F.col(order).alias("__o")))
    sizes = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("here")).withColumn("upto", F.sum("here").over(Window.orderBy(F.desc("__s"))))  # a row a size
    wanted = int((rows.count() if n is None else n) * percent / 100)
    cut = sizes.where(F.col("upto") >= wanted).orderBy("upto").first() if wanted else None
    if cut is None:
        return rows.select(key).limit(0) if not wanted else rows.select(key)
    ties = numbered(rows.where(F.col("__s") == cut["__s"]), "__o").where(F.col("row") < wanted - (cut["upto"] - cut["here"]))
    return rows.where(F.col("__s") > cut["__s"]).select(key).union(ties.select(key))


def longest_texts(df: DataFrame, key: str, text: Column, percent: float = 25.0, order: str = "_id", known: DataFrame | None = None) -> DataFrame:
    """Ids of the longest texts by words; empty texts do not count. Joined with the ids known before."""
    rows = df.withColumn("__t", text).where(F.coalesce("__t", F.lit("")) != "")
    out = longest(rows, key, count_words(F.col("__t")), percent, order)
    return out.union(known.select(key)).distinct() if known is not None else out.distinct()


def domain_or_longest(df: DataFrame, key: str, text: Column, domain: str, percent: float | None = None, order: str = "_id", domain_column: str = "domain") -> DataFrame:
    """Ids of a domain and of the longest of all texts (empty ones count as rows); nothing if the domain is empty."""
    own = df.where(F.col(domain_column) == domain).select(key)
    if percent is None:
        return own.distinct()
    if own.isEmpty():
        return own
    return own.union(longest(df, key, count_words(text), percent, order)).distinct()


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value. Totals are joined on, not windowed over all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def exclusion_breakdown(df: DataFrame, tokens: Column) -> DataFrame:
    """Rows by reason (one may count for both), and kept and excluded in all."""
    some = F.col("context").isNotNull()
    by_length = some & (tokens > MOST_TOKENS)
    by_domain = some & F.coalesce(F.col("domain") == LEFT_OUT_DOMAIN, F.lit(False))
    return df.agg(
        F.count_if(by_length).alias("by_length"),
        F.count_if(by_domain).alias("by_domain"),
        F.count_if(by_length | by_domain).alias("excluded"),
        F.count_if(~(by_length | by_domain)).alias("kept"),
    )
