"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.layout import stem, typed_boxes
from pagewright.functions.text import strip
from pagewright.operators.joins import last_of_key, split_of

#: File endings taken as images.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp", "gif", "tiff", "webp", "tif")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_array(spark: SparkSession, path: str, schema: str = schemas.INSTANCE) -> DataFrame:
    """A JSON array of records, or one record a line."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, report: bool = False) -> DataFrame:
    """A record a line; blank lines go, bad ones go or, to report them, stay in ``_corrupt_record``."""
    if report:
        return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def line_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes by page, typed."""
    return json_lines(spark, path, schemas.LINE_BOX).withColumn("bboxes", typed_boxes(F.col("bboxes")))


def truth_of(layouts: DataFrame, seq: str | None = None) -> DataFrame:
    """S5 on layout documents: page id and text of the first element; rows without either go, of repeats the last stays.

    Documents without elements have no text and go too.
    """
    first = F.get("layout_dets", F.lit(0))["text"]
    path = F.col("page_info.image_path")
    rows = layouts.select(stem(path).alias("page_id"), first.alias("text"), (F.col(seq) if seq else F.monotonically_increasing_id()).alias("__s"))
    rows = rows.where((F.coalesce("page_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    return last_of_key(rows, ["page_id"], "__s").drop("__s")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_of(json_array(spark, path, schemas.LAYOUT_DOC))


def predictions(spark: SparkSession, folder: str, ending: str = "md") -> DataFrame:
    """The files of a folder, not below it, as page texts. Spark passes over files without a byte; the writer ends each page with a line break."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    read = spark.read.option("pathGlobFilter", f"*.{ending}").text(folder, wholetext=True)
    return read.select(stem(F.col("_metadata.file_name")).alias("page_id"), F.col("value").alias("text"))


def id_list(spark: SparkSession, path: str | None, must_exist: bool = False) -> DataFrame:
    """The distinct non-blank lines of a list; without a file empty, or an error."""
    if not path or not exists(spark, path):
        if must_exist:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).where("id <> ''").distinct()


def images(spark: SparkSession, folder: str, recursive: bool = False, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """Image files with content; endings in any case."""
    both = [x for e in endings for x in (e, e.upper())]
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(both) + "}").option("recursiveFileLookup", recursive)
    return read.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), split_of(F.col("path")).alias("split"), "content")


def listed_images(spark: SparkSession, list_path: str, limit: int | None = None) -> DataFrame:
    """The distinct paths of a list file in order."""
    rows = id_list(spark, list_path, must_exist=True).withColumnRenamed("id", "path").orderBy("path")
    return rows.limit(limit) if limit else rows


def splits(files: DataFrame) -> DataFrame:
    """The splits that have an images folder."""
    return files.select(split_of(F.col("path")).alias("split")).where("split <> ''").distinct()


def layout_format(df: DataFrame) -> str:
    """What records hold, by their fields."""
    names = set(df.columns)
    if {"layout_dets", "page_info"} <= names:
        return "layout"
    return "line_bbox" if {"unique_id", "bboxes"} <= names else "unknown"


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """S18."""
    return next((p for p in candidates if exists(spark, p)), None)
