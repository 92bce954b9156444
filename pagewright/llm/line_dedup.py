"""Repeated runs of lines by winnowing over line hashes.

Of the hashes of all grams of lines, the least in every window is a fingerprint,
so each run of ``gram + window - 1`` lines holds one, the same wherever the run
stands.  Places are joined by fingerprint, and only those whose fingerprint is
met more than once go on.  There the match is extended to both sides: each run
of the least length that chose the fingerprint (it lies up to ``window - 1``
lines before or after it) is looked up at its first occurrence, and where it
stands at a later place its lines go.  Runs that meet or overlap make longer
ones, so a repeat of any length goes as a whole, whatever document held a part
of it first.

Each run is joined with one row, never with all that share its hash, and what
travels is hashes and places, not text.  Equal means equal in two hashes of 64
bits each, over lines that are equal in 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, save, ship, skew_join, text_chunks, texts_of, with_lists

CHUNK = 2_000_000


def line_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each line without its white space at both ends; blank lines are 0."""
    lines = [x.strip() for x in text.split("\n")]
    return np.fromiter((xxhash.xxh3_64_intdigest(x) | 1 if x else 0 for x in lines), np.uint64, len(lines))


def gram_hashes(lines: np.ndarray, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every gram of lines, and whether it has a line that is not blank."""
    n = len(lines) - gram + 1
    acc, some = np.full(n, np.uint64(gram + (salt << 8))), np.zeros(n, bool)
    for i in range(gram):
        x = acc * np.uint64(0x9E3779B97F4A7C15) + lines[i : n + i]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        acc = x ^ (x >> np.uint64(29))
        some |= lines[i : n + i] != 0
    return acc, some


def winnow(key: np.ndarray, window: int) -> np.ndarray:
    """For every window of ``window`` hashes (at most all) the place of its least one, the rightmost of equal ones."""
    w = min(window, len(key))
    views = np.lib.stride_tricks.sliding_window_view(key, w)
    return np.arange(len(views)) + w - 1 - views[:, ::-1].argmin(1)


def fingerprints(lines: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed grams; grams of blank lines alone are left out."""
    if len(lines) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key, some = gram_hashes(lines, gram)
    at = np.unique(winnow(np.where(some, key, np.uint64(0xFFFFFFFFFFFFFFFF)), window))
    at = at[some[at]]
    return at, key[at]


RUNS = ("lead", "mark", "key", "a", "b")


def runs(lines: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """The runs of ``gram + window - 1`` lines that are not all blank, by the fingerprint each chose.

    Of every run: whether it is the first that chose this place, the
    fingerprint, the run's own hash, and its lines [a, b).  A run of blank lines
    is carried on to the nearest line before it that is not, and to the one
    after it; it counts as chosen by the fingerprint next to that line.
    """
    least = gram + window - 1
    if len(lines) < least:
        return np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark, some = gram_hashes(lines, gram)
    chose = winnow(np.where(some, mark, np.uint64(0xFFFFFFFFFFFFFFFF)), window)
    own, full = gram_hashes(lines, least, 1)
    at = np.flatnonzero(full)
    parts = [(chose[at], own[at], at, at + least)]
    blank, lit = np.flatnonzero(~full), np.flatnonzero(lines)
    if len(blank) and len(lit):
        k = np.searchsorted(lit, blank)  # the first line after the run that is not blank
        for side, ok in ((1, k > 0), (2, k < len(lit))):
            p = blank[ok]
            other = lit[k[ok] - 1] if side == 1 else lit[k[ok]]
            a, b = (other, p + least) if side == 1 else (p, other + 1)
            x = lines[other] * np.uint64(0x9E3779B97F4A7C15) + (4 * (b - a) + side).astype(np.uint64)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((chose[a if side == 1 else b - least], x ^ (x >> np.uint64(29)), a, b))
    place, key, a, b = (np.concatenate([x[i] for x in parts]) for i in range(4))
    order = np.argsort(place, kind="stable")
    place, key, a, b = place[order], key[order], a[order], b[order]
    lead = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
    return lead, mark[place], key, a, b


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with what orders them: doc_id (null last), then the text's hash."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _scan(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(doc_id, text_hash, lead, mark, key, a, b): a row for each run."""

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            found = [runs(line_hashes(t), gram, window) for t in texts_of(table)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            lead, mark, key, a, b = (np.concatenate([f[i] for f in found]) for i in range(5))
            kept = [table.column(c).combine_chunks().take(row) for c in ("doc_id", "text_hash")]
            cols = [pa.array(lead), pa.array(mark.view(np.int64)), pa.array(key.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=["doc_id", "text_hash", *RUNS])

    return docs.mapInArrow(run, "doc_id long, text_hash long, lead boolean, mark long, key long, a int, b int")


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [a, b) joined where they meet, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_lines(docs: DataFrame, gram: int = 2, window: int = 2) -> DataFrame:
    """(doc_id, text_hash, cut): line ranges, disjoint and in order, that repeat earlier runs of ``gram + window - 1`` lines or more."""
    spark = docs.sparkSession
    ship(spark)
    own = keyed(docs).where(F.size(F.split("text", "\n", gram + window - 1)) >= gram + window - 1)  # fewer lines hold no run
    rows, rows_at = save(_scan(own, gram, window))
    # Fingerprints met at two places or more, with the number of runs that chose them.
    met, met_at = save(rows.groupBy("mark").agg(F.count_if("lead").alias("places"), F.count(F.lit(1)).alias("n")).where("places > 1").drop("places"))
    live, live_at = save(skew_join(rows, met, ["mark"], "n"))
    drop(spark, rows_at, met_at)
    # Extended to both sides: the runs through those places, each against its first occurrence.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "a")
    first, first_at = save(live.groupBy("mark", "key").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = skew_join(live, first, ["mark", "key"], "n").where(place > F.col("f"))
    found, found_at = save(later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("cut")))
    drop(spark, live_at, first_at)

    def run(batches):
        for batch in batches:
            cuts = [[{"a": a, "b": b} for a, b in merged([(c["a"], c["b"]) for c in x])] for x in batch.column(2).to_pylist()]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, kind)], names=["doc_id", "text_hash", "cut"])

    cuts, _ = save(found.mapInArrow(run, "doc_id long, text_hash long, cut array<struct<a:int,b:int>>"))
    drop(spark, found_at)
    return cuts


def drop_repeated_lines(docs: DataFrame, gram: int = 2, window: int = 2) -> DataFrame:
    """The rows of ``docs`` with ``kept_text`` and ``n_removed`` (lines) besides their columns.

    Lines equal but for white space at their ends count as equal, blank lines
    too, though not runs of blank lines alone.  Earlier is: by doc_id (null
    last), the text's hash, and place in the text; rows that repeat a doc_id and
    text are one document and stay alike, so are ties.  Of every run of
    ``gram + window - 1`` lines or more all later occurrences go; shorter ones
    stay.  Null text stays null, empty text empty; a text of any length is read
    whole, one at a time.  An empty table gives no rows.  A column of ``docs``
    named kept_text or n_removed is replaced; no other name clashes.
    """
    spark = docs.sparkSession
    ship(spark)
    cuts = repeated_lines(docs, gram, window)
    names = [c for c in docs.columns if c not in ("kept_text", "n_removed")]
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.struct(*names).alias("row"))
    joined = with_lists(rows, cuts, "left")
    lines = F.split("text", "\n")
    # What lies between the cuts, each as one slice.
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda c: c["b"]))
    ends = F.concat(F.transform("cut", lambda c: c["a"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda k: F.slice(lines, k["a"] + 1, k["b"] - k["a"])))
    has = F.col("cut").isNotNull()
    return joined.select(
        "row.*",
        F.when(has, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("kept_text"),
        F.when(has, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )
