"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing.  Items are dealt at random into groups; each
group packs its own by best fit on decreasing length and emits bins that are
nearly full.  What is left travels up a tree: underfull bins are items of the
next round, where eight groups meet, and so on up to one group.

After a round no two bins of a group fit together, so at most one of them is at
most half full.  A later merge needs such a small bin, and of ``g`` groups come
at most ``g`` of them; a group therefore hands on its small bin and its ``g``
roomiest others and may emit the rest without losing a merge.  That bounds what
the upper levels read, whatever the lengths are.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import wordbpe
from pagewright.llm.common import drop, save, ship, text_chunks, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBERS = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
CHUNK = 2_000_000


def cut(docs: DataFrame, tokenizer: str, limit: int, end_id: int = 0) -> DataFrame:
    """Encode every whole text, add ``end_id``, cut what is longer than ``limit``.

    One row per piece.  Null and empty texts are the end id alone; null or
    repeated doc_ids are kept as they are, each row being a document of its own.
    Texts of any length are encoded whole.  An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = wordbpe.load(tokenizer)
        for table in text_chunks(batches, CHUNK):
            ids, off = bpe.encode(texts_of(table))
            out: list[list] = [[], [], [], [], []]
            flat = ids.astype("<u4")
            end = np.array([end_id], "<u4")
            for doc, a, b in zip(table.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                whole = np.concatenate([flat[a:b], end])
                for k, at in enumerate(range(0, len(whole), limit)):
                    part = whole[at : at + limit]
                    for col, v in zip(out, (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit on decreasing sizes; each bin as the indices it holds."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # bit f is set where room[f] has a bin
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = free >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                free &= ~(1 << f)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
        room[f - s].append(b)
        free |= 1 << (f - s)
    return bins


STATE = pa.schema(
    [
        ("seq", pa.int64()),
        ("grp", pa.int64()),
        ("size", pa.int64()),
        ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))),
    ]
)


def _round(level: int, groups: int, capacity: int, fan_in: int, slack: int):
    """Best fit within one of ``groups`` groups; finished bins get a sequence number, others their next group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        sizes, members = table.column("size").to_pylist(), table.column("members").to_pylist()
        made = [(sum(sizes[i] for i in b), [m for i in b for m in members[i]]) for b in best_fit(sizes, capacity)]
        made.sort(key=lambda x: x[0])
        rows, large = [], 0
        for n, (size, inside) in enumerate(made):
            small = 2 * size <= capacity
            if groups > 1 and size < capacity - slack and (small or large < groups):
                large += not small
                rows.append((None, grp // fan_in, size, inside))
                continue
            at = 0
            for m in inside:
                m["offset"] = at
                at += m["length"]
            rows.append((level << 58 | grp << 24 | n, grp, size, inside))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), STATE.types, strict=True)], schema=STATE)

    return run


def pack(pieces: DataFrame, capacity: int = 2048, group_items: int = 3000, fan_in: int = 8, slack: int = 8) -> DataFrame:
    """Give every piece a sequence_id and an offset.

    pieces: rows as :func:`cut` makes them (length from 1 to ``capacity``).
    slack: bins with so few tokens free are emitted at once.  Groups are drawn
    by row, so rows that repeat spread like others.  An empty input gives an
    empty result; pieces of one length are ties, packed in any order.
    """
    ship(pieces.sparkSession)
    pieces, at = save(pieces)
    groups, level = max(1, -(-pieces.count() // group_items)), 0
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    items = pieces.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp"),
        F.col("length").alias("size"),
        F.array(member).alias("members"),
    )
    out = []
    while True:
        made, _ = save(items.groupBy("grp").applyInArrow(_round(level, groups, capacity, fan_in, slack), f"seq long, grp long, size long, members {MEMBERS}"))
        if not level:
            drop(pieces.sparkSession, at)
        out.append(made.where("seq is not null").select("seq", "members"))
        if groups == 1:
            break
        items = made.where("seq is null").select("grp", "size", "members")
        groups, level = -(-groups // fan_in), level + 1
    whole = reduce(DataFrame.union, out)
    return whole.select(F.col("seq").alias("sequence_id"), F.inline("members")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Cut and pack whole documents; other columns of ``docs`` are ignored."""
    return pack(cut(docs, tokenizer, capacity), capacity)
