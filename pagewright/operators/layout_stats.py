"""Layout documents and statistics over boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import layout as L

#: What page descriptions say.
PAGE_WIDTH, PAGE_HEIGHT = 1700, 2200


def layout_documents(lines: DataFrame, concatenate: bool = False) -> DataFrame:
    """A layout document for each page of rows (unique_id, image_paths, bboxes typed by page)."""
    pages = lines.select("unique_id", "image_paths", F.posexplode("bboxes").alias("page", "boxes"))
    attribute = F.struct(
        F.lit("academic_literature").alias("data_source"), F.lit("english").alias("language"), F.lit("single_column").alias("layout"), F.array().cast("array<string>").alias("special_issue")
    )
    info = F.struct(
        attribute.alias("page_attribute"),
        (F.col("page") + 1).alias("page_no"),
        F.lit(PAGE_HEIGHT).alias("height"),
        F.lit(PAGE_WIDTH).alias("width"),
        L.base_name(F.get("image_paths", F.col("page"))).alias("image_path"),
    )
    return pages.select(
        "unique_id",
        L.page_elements(F.col("boxes"), concatenate).alias("layout_dets"),
        F.struct(F.array().cast("array<string>").alias("relation")).alias("extra"),
        info.alias("page_info"),
    )


def identity_predictions(layouts: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """The text of all elements as the prediction of each page; pages without a name are numbered."""
    rows = layouts.orderBy(order).limit(limit) if limit else layouts
    name = L.stem(F.col("page_info.image_path"))
    return rows.select(F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.format_string("%s_page_%03d", "unique_id", "page_info.page_no")).alias("page_id"), L.elements_text(F.col("layout_dets")).alias("text"))


def identity_from_boxes(lines: DataFrame) -> DataFrame:
    """W10 from boxes."""
    pages = lines.select("unique_id", "image_paths", F.posexplode("bboxes").alias("page", "boxes"))
    name = L.stem(F.get("image_paths", F.col("page")))
    return pages.select(F.coalesce(name, F.format_string("%s_page_%03d", "unique_id", F.col("page") + 1)).alias("page_id"), L.boxes_text(F.col("boxes")).alias("text"))


def totals(lines: DataFrame) -> DataFrame:
    """Samples, pages, boxes and their averages; failed rows have none."""
    pages = F.coalesce(F.size("bboxes"), F.lit(0))
    return lines.agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(F.greatest(pages, F.lit(0))), F.lit(0)).alias("pages"), F.coalesce(F.sum(L.box_count(F.col("bboxes"))), F.lit(0)).alias("boxes")
    ).select(
        "*", F.coalesce(F.try_divide("pages", "samples"), F.lit(0.0)).alias("pages_per_sample"), F.coalesce(F.try_divide("boxes", "pages"), F.lit(0.0)).alias("boxes_per_page")
    )


def text_lengths(lines: DataFrame) -> DataFrame:
    """Least, most, mean, median and 95th percentile of box text lengths, 0 without boxes."""
    size = lines.select(F.explode(F.flatten("bboxes")).alias("b")).select(F.length("b.text").alias("n"))
    zero = lambda c, name: F.coalesce(c.cast("double"), F.lit(0.0)).alias(name)
    return size.agg(zero(F.min("n"), "min"), zero(F.max("n"), "max"), zero(F.avg("n"), "mean"), zero(F.median("n"), "median"), zero(F.percentile("n", 0.95), "p95"))


def per_sample(lines: DataFrame) -> DataFrame:
    """Boxes, pages and boxes a page of each sample."""
    boxes, pages = L.box_count(F.col("bboxes")), F.coalesce(F.greatest(F.size("bboxes"), F.lit(0)), F.lit(0))
    return lines.select("unique_id", boxes.alias("boxes"), pages.alias("pages"), F.coalesce(F.try_divide(boxes, pages), F.lit(0.0)).alias("boxes_per_page"))


def most_boxes(lines: DataFrame, n: int = 10, order: str = "unique_id") -> DataFrame:
    """The samples with most boxes, ties in input order."""
    return per_sample(lines).orderBy(F.desc("boxes"), F.asc(order)).limit(n)


def first_pages(lines: DataFrame, n: int) -> DataFrame:
    """O2."""
    return lines.withColumns({"image_paths": F.slice("image_paths", 1, n), "bboxes": F.slice("bboxes", 1, n)})
