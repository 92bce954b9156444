"""Session, storage and batching helpers shared by the operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir`` (any file system Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of whole texts in an Arrow batch; the default of 10,000 takes tens of MB outside the heap for each task.
BATCH_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and batches of texts small unless the session sets their size.

    Where the package directory is already on the workers' PYTHONPATH nothing
    happens; otherwise a zip goes out through Spark's own file server.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_pagewright_shipped", False):
        return
    where = Path(tempfile.mkdtemp(prefix="pagewright")) / "pagewright_src.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted((root / "pagewright").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(where))
    sc._pagewright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder where master is
    ``local``, and an error elsewhere: executors do not see each other's disks.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_pagewright_dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagewright-shared")
        sc._pagewright_dir = named
    return named.rstrip("/")


#: While a table is written: Spark removes the query's shuffle files as soon as it is there, and the driver keeps short
#: descriptions of plans only (it makes one anew after each stage, so those of long plans fill its memory).
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "4096", "spark.sql.ui.explainMode": "simple"}


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when :func:`drop` is called, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WHILE_SAVING}
    for k, v in WHILE_SAVING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that :func:`save` wrote and no plan needs any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A key with more than this share of the rows (so fewer than 1,000 keys), and with so many rows at least, is joined by broadcast.
HOT_SHARE, HOT_ROWS = 1000, 1000


def skew_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``table``, which has each key once and in ``n`` the number of rows it will meet.

    A key that holds more than a thousandth of all those rows would make one
    task of them.  There are fewer than a thousand such keys whatever the data,
    so their part of ``table`` is broadcast; the rest is an ordinary join, as is
    all where no key is hot.  ``table`` is read up to four times: give a saved
    one.  ``n`` is left out.
    """
    total, most = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(total // HOT_SHARE, HOT_ROWS)
    if most <= least:
        return rows.join(table.drop(n).hint("merge"), keys, how)
    hot = F.col(n) > least
    some = F.broadcast(table.where(hot).drop(n))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(some, keys).unionByName(rest.join(table.where(~hot).drop(n).hint("merge"), keys, how))


#: 64-bit words of the filter that tells which rows may have a partner: 2 MiB, whatever the tables hold.
FILTER_WORDS = 1 << 18


def _filter_bits(key: Column) -> list[Column]:
    """Two places in the filter."""
    bits = 64 * FILTER_WORDS
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (3, 4)]


def key_filter(table: DataFrame, key: Column) -> Column:
    """A Bloom filter of the keys, as a scalar subquery with one bit array of fixed size."""
    bit = table.select(F.explode(F.array(*_filter_bits(key))).alias("bit"))
    word = F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))")
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(word.alias("set"))
    dense = table.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("word")).join(words, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    return dense.agg(F.transform(pairs, lambda x: x["set"]).alias("bits")).scalar()


def may_be_in(bits: Column, key: Column) -> Column:
    """Whether the filter may hold the key; never false for one that it was made of."""
    tests = [F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in _filter_bits(key)]
    return tests[0] & tests[1]


def doc_key(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash)


def with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Join rows (doc_id, text_hash, ...) with a saved table that has a row for some (doc_id, text_hash).

    ``how`` is inner, left or left_anti.  A filter of fixed size over the
    table's keys decides which rows go through the join, by shuffle at any size;
    the others stay where the scan has them, text and all.  When the table
    outgrows the filter, more rows are shuffled, with the same result.
    """
    right = lists.withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"})
    bits = key_filter(right, doc_key(F.col("k_id"), F.col("k_hash")))
    may = may_be_in(bits, doc_key(F.col("doc_id"), F.col("text_hash")))
    some = docs.where(may)
    same = some["doc_id"].eqNullSafe(F.col("k_id")) & some["text_hash"].eqNullSafe(F.col("k_hash"))
    joined = some.join(right.hint("merge"), same, how)
    if how == "inner":
        return joined.drop("k_id", "k_hash")
    return joined.drop("k_id", "k_hash").unionByName(docs.where(~may), allowMissingColumns=True)


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_chunks(batches, chars: int, column: str = "text") -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``chars`` bytes of ``column`` (at least a row)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype="float64")))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chars - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += ends[to - 1] - base
            at = to
            if size >= chars or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held)
    held = []
    trim()


def texts_of(table: pa.Table, column: str = "text") -> list[str]:
    """The column as Python strings, null as the empty string."""
    return [x if x is not None else "" for x in table.column(column).to_pylist()]
