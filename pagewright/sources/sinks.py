"""Writers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.records import exists, id_list


def evaluation(pages: DataFrame, summary: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """K1: per-page scores and their summary, as two tables."""
    summary.write.mode(mode).json(f"{folder}/summary")
    pages.write.mode(mode).json(f"{folder}/per_page")


def printed(summary: DataFrame) -> str:
    """K2: one line for each metric of a summary row, four decimals."""
    row = summary.first()
    return "\n".join(f"{c}: {row[c]:.4f}" if isinstance(row[c], float) else f"{c}: {row[c]}" for c in summary.columns) if row else ""


def append_boxes(lines: DataFrame, folder: str) -> None:
    """K3: the three fields of rendered rows, added to what is there."""
    lines.select("unique_id", "image_paths", "bboxes").write.mode("append").json(folder)


def records(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """A record a line."""
    df.write.mode(mode).json(folder)


def named_files(files: DataFrame, folder: str) -> int:
    """Rows (name string, content binary) as one file each in ``folder``, written by the tasks; returns how many.

    folder is a path or address that Arrow's file systems know (local or
    mounted, HDFS, S3, GCS).  A repeated task writes the same files again, and
    each appears under its name only when it is whole.
    """
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name:
                    raise ValueError(f"not a file name: {name!r}")
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    return files.select("name", "content").mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def page_files(pages: DataFrame, folder: str, ending: str = "md") -> int:
    """K6: one file ``<page_id>.md`` for each page, its text and a line break, in no folder of its own; returns how many."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    return named_files(pages.select(F.concat("page_id", F.lit(f".{ending}")).alias("name"), F.encode(text, "UTF-8").alias("content")), folder)


def page_images(pages: DataFrame, folder: str) -> int:
    """Rendered pages (name ``<id>_page_<n>.png``, content) as image files; rows with an error have none."""
    rows = pages.where("error is null") if "error" in pages.columns else pages
    return named_files(rows, folder)


def overlays(images: DataFrame, boxes: DataFrame, folder: str, overwrite: bool = False) -> int:
    """PNG images (name, content) with frames around their boxes (name, boxes array of structs); returns how many.

    Files that are there already stay unless ``overwrite``.
    """
    from pagewright.functions import png

    both = images.select("name", "content").join(boxes.select("name", "boxes"), "name")
    spark = images.sparkSession
    if not overwrite and exists(spark, folder):
        done = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        both = both.join(done, "name", "left_anti")

    @F.pandas_udf("binary")
    def draw(content: pd.Series, frames: pd.Series) -> pd.Series:
        return pd.Series([png.encode(png.overlay(png.decode(bytes(c)), [(f["x0"], f["y0"], f["x1"], f["y1"]) for f in b])) for c, b in zip(content, frames, strict=True)])

    plain = F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")]))
    return named_files(both.select("name", draw("content", plain).alias("content")), folder)


def id_file(ids: DataFrame, folder: str, union: bool = True) -> None:
    """K7, K8: sorted ids, with those there before or instead of them.

    Written beside the old list, which is an input; that is moved away before
    the new one takes its place, and goes last, so no crash loses both.
    """
    spark = ids.sparkSession
    own = ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
    if union and exists(spark, folder):
        own = own.union(id_list(spark, folder))
    path = spark._jvm.org.apache.hadoop.fs.Path
    own.distinct().orderBy("id").coalesce(1).write.mode("overwrite").text(f"{folder}.next")
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{folder}.old"), True)
    if fs.exists(path(folder)):
        fs.rename(path(folder), path(f"{folder}.old"))
    fs.rename(path(f"{folder}.next"), path(folder))
    fs.delete(path(f"{folder}.old"), True)


def report(runs: DataFrame, slices: DataFrame, results: DataFrame, folder: str) -> None:
    """K9: a run, its slices and its results, as three tables."""
    for name, df in (("runs", runs), ("slices", slices), ("results", results)):
        df.write.mode("append").json(f"{folder}/{name}")


def items(df: DataFrame, folder: str, kind: str) -> None:
    """Recognised items as JSON, as CSV with a row for each text, or as a text listing."""
    from pagewright.operators.infer import item_rows

    if kind == "json":
        df.write.mode("overwrite").json(folder)
    elif kind == "csv":
        item_rows(df).withColumn("poly", F.to_json("poly")).write.mode("overwrite").option("header", True).csv(folder)
    elif kind == "txt":
        rows = item_rows(df)
        rows.select(F.format_string("%s\t%s (%.3f)", "image_name", "text", "confidence").alias("value")).write.mode("overwrite").text(folder)
    else:
        raise ValueError(f"unknown format {kind}")
