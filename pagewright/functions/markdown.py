"""Markdown segments of a text, from the class of each line, and inline markup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import strip

#: What lines of each class look like, after white space at their end is gone.
FENCE = "```"
HEADING = r"(?sU)^(#{1,6})\s+(.+)$"
ITEM = r"(?sU)^(\s*)([*+-]|\d+\.)\s+(.+)$"
RULE = r"^[-*_]{3,}$"
#: Where a paragraph that nothing ends stands: behind all lines.
END = 1 << 30


def line_class(line: Column) -> Column:
    """fence, heading, quote, item, rule, blank or text."""
    bare = strip(line)
    return (
        F.when(bare.startswith(FENCE), "fence")
        .when(line.rlike(HEADING), "heading")
        .when(bare.startswith(">"), "quote")
        .when(line.rlike(ITEM), "item")
        .when(bare.rlike(RULE), "rule")
        .when(bare == "", "blank")
        .otherwise("text")
    )


def segment(df: DataFrame, column: str = "text") -> DataFrame:
    """Seq, kind, level and text of the segments of each row's text, beside its other columns.

    A line is in code when an odd number of fences stands before it.  Text lines
    between two lines of other classes are a paragraph, over any code between
    them; it stands where the line that ends it stands, code where its closing
    fence does.  Code without a closing fence, or blank, is lost.  Null is empty.
    """
    rest = [c for c in df.columns if c != column]
    texts = df.select(F.struct(F.lit(0).alias("__"), *rest).alias("row"), F.monotonically_increasing_id().alias("id"), F.split(F.coalesce(column, F.lit("")), "\n").alias("raw"))
    lines = texts.select("row", "id", F.posexplode("raw").alias("at", "raw"))
    lines = lines.select("row", "id", "at", F.regexp_replace("raw", r"(?U)\s+$", "").alias("line")).withColumn("class", line_class(F.col("line")))
    before, after = Window.partitionBy("id").orderBy("at"), Window.partitionBy("id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    fence = F.col("class") == "fence"
    lines = lines.withColumns({"fences": F.count_if(fence).over(before), "closed_at": F.min(F.when(fence, F.col("at"))).over(after)})
    code = ~fence & (F.col("fences") % 2 == 1)
    ends = ~fence & ~code & (F.col("class") != "text")
    lines = lines.withColumns({"code": code, "run": F.count_if(ends).over(before), "ended_at": F.min(F.when(ends, F.col("at"))).over(after)})
    kind = F.when(F.col("code"), "code").when(F.col("class") == "text", "paragraph").otherwise(F.col("class"))
    number = F.when(F.col("code"), F.col("fences")).when(kind == "paragraph", F.col("run")).otherwise(F.col("at"))
    place = F.when(F.col("code"), F.col("closed_at")).when(kind == "paragraph", F.coalesce("ended_at", F.lit(END))).otherwise(F.col("at"))
    parts = lines.where(~fence & (F.col("code") | (F.col("class") != "blank"))).select("row", "id", kind.alias("kind"), number.alias("number"), place.alias("place"), "at", "line")
    whole = parts.where("place is not null").groupBy("id", "kind", "number").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"), F.first("row").alias("row"))
    said = F.transform("lines", lambda x: x["line"])
    line = F.get(said, F.lit(0))
    text = (
        F.when(F.col("kind") == "code", F.array_join(said, "\n"))
        .when(F.col("kind") == "paragraph", F.array_join(said, " "))
        .when(F.col("kind") == "heading", F.regexp_extract(line, HEADING, 2))
        .when(F.col("kind") == "quote", strip(F.substring(strip(line), 2, END)))
        .when(F.col("kind") == "item", F.concat_ws(" ", F.regexp_extract(line, ITEM, 2), F.regexp_extract(line, ITEM, 3)))
        .otherwise("")
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, HEADING, 1))).when(F.col("kind") == "item", F.length(F.regexp_extract(line, ITEM, 1))).otherwise(0)
    made = whole.select("id", "row", "kind", level.alias("level"), text.alias("text"), "place").where((F.col("kind") != "code") | (strip(F.col("text")) != ""))
    order = Window.partitionBy("id").orderBy("place", F.col("kind") != "paragraph")
    return made.withColumn("seq", F.row_number().over(order) - 1).select(*[F.col("row")[c].alias(c) for c in rest], "seq", "kind", "level", "text")


#: Escapes, then inline markup and what it becomes, in this order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
INLINE = (
    (r"`([^`]+)`", '<font name="Courier">$1</font>'),
    (r"\*\*([^*]+)\*\*", "<b>$1</b>"),
    (r"__([^_]+)__", "<b>$1</b>"),
    (r"(?<!\*)\*([^*]+)\*(?!\*)", "<i>$1</i>"),
    (r"(?<!_)_([^_]+)_(?!_)", "<i>$1</i>"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
)


def inline(c: Column) -> Column:
    """Escaped, then code, bold, italic and link text as layout markup."""
    for old, new in ESCAPES:
        c = F.replace(c, F.lit(old), F.lit(new))
    for pattern, new in INLINE:
        c = F.regexp_replace(c, pattern, new)
    return c
