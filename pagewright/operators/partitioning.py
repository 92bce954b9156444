"""How rows are dealt over tasks, and tables kept between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly where the scan has fewer splits than there are cores; else as they are.

    Whoever reads many files already has enough tasks, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; it goes when the application ends.

    Only with a ``local`` master may that setting be absent.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_pagewright_scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = sc._pagewright_scratch = "file://" + tempfile.mkdtemp(prefix="pagewright-scratch")
    path = f"{root.rstrip('/')}/pagewright-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch table once and read from there by all that follows."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
