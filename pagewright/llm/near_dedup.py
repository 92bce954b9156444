"""Near duplicates on word shingles by an LSH forest of MinHash signatures.

Each tree is a sorted order of signatures.  A document's candidates are its
neighbours in that order and, in every region of a common prefix, the region's
most typical member; the prefix grows with the region (adaptive depth), so a
region of any size gives a number of candidates in proportion to its members.
Candidates that a b-bit sketch does not rule out are confirmed on full sets,
best ones first; later ones only where they join different components.

What these leave apart is compared in full: in every region of equal orders each
set meets all sets of other components, in blocks dealt over tasks.  So a linked
pair is missed only when none of the trees puts it in one region, however large
its family is (at 0.8: 1 - (1 - 0.8^6)^20, 2 of 1,000 pairs, before links through
others).  The work is the square of a family that is just below the threshold.

Identical sets are one node, so copies cost no links.  No step holds a region,
a group or the links in one task or on the driver.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, save, ship, skew_join, text_chunks, with_lists

CHUNK = 2_000_000
#: Trees, hash values in a tree's order, and the depths of its regions.
TREES, DEPTH, REGIONS = 20, 6, (3, 4, 6)
#: Further hash values, one byte of each, to rule candidates out; a pair at 0.8 agrees on 51.2 of 64 on average, deviation 3.2.
SKETCH = 64
#: Sets in a block of a region, about; a task compares two blocks at a time.
BLOCK = 128
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int):
    """Yield for each text its sorted distinct shingle hashes (64 bits).

    Words are runs of other bytes than blank and U+0009 to U+000D, A-Z in lower
    case.  A text with fewer than ``width`` words has its whole sequence as one
    shingle; without words the set is empty.
    """
    data = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(data, np.uint8)
    white = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.concatenate([[True], white[1:] != white[:-1]]))
    pieces = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(np.append(edge, len(raw)).astype(np.int32)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    is_word = ~white[edge]
    words, begin = hashes[np.asarray(coded.indices)[is_word]], edge[is_word]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    last = np.searchsorted(begin, ends)
    first = np.concatenate([[0], last[:-1]])
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        w = words[a:b]
        if not len(w):
            yield np.zeros(0, np.uint64)
            continue
        n = min(width, len(w))
        acc = np.full(len(w) - n + 1, np.uint64(n))
        for i in range(n):
            acc = _mix(acc * np.uint64(MIX[0]) + w[i : len(w) - n + 1 + i])
        yield np.unique(acc)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20231)
    n = TREES * DEPTH + SKETCH
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, in 32 bits."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        x = shingles[None, i : i + 2048] * a[:, None]
        x += b[:, None]
        x >>= np.uint64(32)
        np.minimum(out, x.min(1).astype(np.uint32), out=out)
    return out


def _bytes(table: pa.Table) -> list[bytes]:
    return [x if x is not None else b"" for x in table.column("text").to_pylist()]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, orders, sketch) for every row; set_id is null for an empty set."""
    ship(docs.sparkSession)

    def run(batches):
        a, b = _functions()
        for table in text_chunks(batches, CHUNK):
            n, ids, orders, sketch = [], [], [], []
            for s in shingle_sets(_bytes(table), width):
                n.append(len(s))
                if not len(s):
                    ids.append(None), orders.append(None), sketch.append(None)
                    continue
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                h = min_hashes(s, a, b)
                orders.append(h[: TREES * DEPTH].astype(">u4").tobytes())
                sketch.append((h[TREES * DEPTH :] & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("text_hash").combine_chunks(), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (ids, orders, sketch))],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "orders", "sketch"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, orders binary, sketch binary")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


PAIR = "a binary, b binary, same int"


def _may_agree(a: pa.StructArray, b: pa.StructArray, threshold: float) -> pa.RecordBatch:
    """Of pairs (structs of set_id, n, sketch) those that may reach the threshold, with their agreement; a's id the smaller."""
    least = int(SKETCH * threshold - 4.8 * (SKETCH * threshold * (1 - threshold)) ** 0.5)

    def part(x):
        return np.frombuffer(b"".join(x.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH), x.field("n").to_numpy()

    (sa, na), (sb, nb) = part(a), part(b)
    same = (sa == sb).sum(1)
    ok = np.flatnonzero((same >= least) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9))
    ids = [sorted(p) for p in zip(a.field("set_id").take(pa.array(ok)).to_pylist(), b.field("set_id").take(pa.array(ok)).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in ids], pa.binary()), pa.array([p[1] for p in ids], pa.binary()), pa.array(same[ok].astype(np.int32))], names=["a", "b", "same"])


def _agree(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) that may reach the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _may_agree(batch.column(0), batch.column(1), threshold)

    return pairs.select("x", "y").mapInArrow(run, PAIR)


def _neighbours(rows: DataFrame, least: int, threshold: float, reach: int = 2) -> DataFrame:
    """Pairs at up to ``reach`` places in a tree's order with ``least`` leading values in common, that may reach the threshold.

    The order is dealt by range over all of (tree, order, set_id), so a region of
    many equal orders is spread over tasks like any other rows.
    """
    dealt = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, "tree", "path", "set_id").sortWithinPartitions("tree", "path", "set_id")
    cut = 4 * least

    def run(batches):
        held: list = []
        for batch in batches:
            x, y = [], []
            for tree, path, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for t, p, other in held:
                    if t == tree and p == path[:cut]:
                        x.append(other), y.append(node)
                held = [*held[1 - reach :], (tree, path[:cut], node)]
            if x:
                kind = batch.column(2).type
                yield _may_agree(pa.array(x, kind), pa.array(y, kind), threshold)

    return dealt.select("tree", "path", F.struct("set_id", "n", "sketch").alias("node")).mapInArrow(run, PAIR)


def candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets (a < b) from all trees, with the agreement of their sketches."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.select("set_id", "n", "sketch", "orders", tree.alias("tree")).select(
        "set_id", "n", "sketch", "tree", F.expr(f"substring(orders, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("path")
    )

    def prefix(d: int):
        return F.expr(f"xxhash64(tree, substring(path, 1, {4 * d}))")

    # Regions with company only.
    met = rows.select(prefix(REGIONS[0]).alias("region")).groupBy("region").count().where("count > 1").select("region")
    live, live_at = save(rows.withColumn("region", prefix(REGIONS[0])).join(met, "region").drop("region"))
    # How typical a set is: the sizes of its deepest regions, over all trees.
    deep = live.groupBy(prefix(DEPTH).alias("region")).agg(F.count(F.lit(1)).alias("size"))
    weight = live.select("set_id", prefix(DEPTH).alias("region")).join(deep, "region").groupBy("set_id").agg(F.sum("size").alias("weight"))
    weighed, weighed_at = save(live.join(weight, "set_id"))
    node = F.struct("set_id", "n", "sketch")
    # Each kind of candidates by itself, so that no plan is long.
    found = [save(_neighbours(live, REGIONS[0], threshold))]
    for d in REGIONS:
        own = weighed.select(prefix(d).alias("region"), node.alias("x"), "weight")
        pivot, at = save(own.groupBy("region").agg(F.max_by("x", F.struct("weight", F.col("x.set_id"))).alias("y"), F.count(F.lit(1)).alias("size")).where("size > 1"))
        found.append(save(_agree(skew_join(own, pivot, ["region"], "size").where("x.set_id <> y.set_id"), threshold)))
        drop(nodes.sparkSession, at)
    drop(nodes.sparkSession, live_at, weighed_at)
    out, _ = save(reduce(DataFrame.union, [x[0] for x in found]).groupBy("a", "b").agg(F.max("same").alias("same")))
    drop(nodes.sparkSession, *[x[1] for x in found])
    return out


def full_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of the documents with the given (doc_id, text_hash, set_id), a saved table."""
    picked = with_lists(keyed(docs), keys, "inner")

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            sets = [s.view(np.int64) for s in shingle_sets(_bytes(table), width)]
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([table.column("set_id").combine_chunks(), flat], names=["set_id", "shingles"])

    sets = picked.select("set_id", "text").mapInArrow(run, "set_id binary, shingles array<bigint>")
    return sets.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    a = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = pairs.select("a", "b").join(a, "a").join(b, "b")
    return joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (left, right) of places in ``sets`` (sorted, distinct) reach the threshold, on full sets."""
    n = np.array([len(x) for x in sets], np.int64)
    if len(left) < 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    else:
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(sets)), n), times[code] > 1
        code, row = (np.cumsum(times > 1) - 1)[code[shared]], row[shared]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        met = np.zeros((len(sets), len(sets)), np.float64)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            a, b = np.searchsorted(code, [at, at + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], code[a:b] - at] = 1
            met += m @ m.T
        both = met[left, right].astype(np.int64)
    return 100 * both >= percent * (n[left] + n[right] - both)


def crowded_links(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of different components that share a region of full depth in any tree.

    A component with more than a block of sets in a region has blocks of its own,
    which do not meet each other; all other blocks meet.
    """
    threshold = percent / 100
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    root = nodes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rows = root.select("set_id", "root", "orders", tree.alias("tree")).select("set_id", "root", F.expr(f"xxhash64(tree, substring(orders, tree * {4 * DEPTH} + 1, {4 * DEPTH}))").alias("region"))
    mixed = rows.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region")
    live, live_at = save(rows.join(mixed, "region"))
    held = live.groupBy("region", "root").agg(F.count(F.lit(1)).alias("held"))
    rest = held.groupBy("region").agg(F.coalesce(F.sum(F.when(F.col("held") <= BLOCK, F.col("held"))), F.lit(0)).alias("rest"))
    own = F.col("held") > BLOCK
    parts = F.ceil(F.when(own, F.col("held")).otherwise(F.col("rest")) / BLOCK)
    part = F.pmod(F.xxhash64("set_id", F.lit(1)), parts)
    placed = live.join(held, ["region", "root"]).join(rest, "region").select("set_id", "root", "region", F.when(own, F.col("root")).alias("big"), part.alias("part"))
    placed, placed_at = save(placed.withColumn("block", F.xxhash64("region", F.coalesce("big", F.lit(b"")), "part")))
    blocks = placed.groupBy("region", "block").agg(F.first("big").alias("big"))
    x, y = (blocks.select("region", F.col("block").alias(c), F.col("big").alias(f"{c}_big")) for c in ("x", "y"))
    cells = x.join(y, "region").where("x <= y and not coalesce(x_big = y_big, false)").select("x", "y", F.xxhash64("x", "y").alias("cell"))
    ends = cells.select("cell", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), (F.col("x") == F.col("y")).alias("one"))
    ends = ends.select("block", "cell", "one", (F.col("block") == F.col("y")).alias("second"))
    at = nodes.join(placed.select("set_id").distinct(), "set_id").select("set_id", "doc.doc_id", "doc.text_hash", "sketch")
    at, at_at = save(at)
    drop(docs.sparkSession, live_at)
    sets, sets_at = save(full_sets(docs, at.drop("sketch"), width).join(at.select("set_id", "sketch"), "set_id"))
    drop(docs.sparkSession, at_at)
    dealt = placed.select("set_id", "root", "block").join(ends, "block").drop("block").join(sets, "set_id")
    least = int(SKETCH * threshold - 4.8 * (SKETCH * threshold * (1 - threshold)) ** 0.5)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, of = table.column("set_id").to_pylist(), np.asarray(table.column("root").combine_chunks().dictionary_encode().indices)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        one, second = table.column("one")[0].as_py(), table.column("second").to_numpy()
        column = table.column("shingles").combine_chunks()
        flat, off = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
        sets = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        sets, n = [np.sort(s) for s in sets], np.diff(off)
        left, right = [], []
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids)) if one else np.flatnonzero(second) if not second[i] else np.zeros(0, np.int64)
            j = j[of[j] != of[i]]
            j = j[np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9]
            j = j[(sketch[j] == sketch[i]).sum(1) >= least]
            left.append(np.full(len(j), i)), right.append(j)
        left, right = np.concatenate(left), np.concatenate(right)
        ok = linked(sets, left, right, percent) if len(left) else np.zeros(0, bool)
        got = [sorted((ids[i], ids[j])) for i, j in zip(left[ok], right[ok], strict=True)]
        return pa.table({"a": pa.array([g[0] for g in got], pa.binary()), "b": pa.array([g[1] for g in got], pa.binary())})

    links, _ = save(dealt.groupBy("cell").applyInArrow(run, "a binary, b binary").distinct())
    drop(docs.sparkSession, placed_at, sets_at)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, by alternating large and small stars.

    Every round is aggregations and joins on narrow rows; rounds end when no
    edge changes.  Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    least = F.least("a", "b")
    edges, at = save(edges.where("a <> b").select(least.alias("u"), F.greatest("a", "b").alias("v")).distinct())

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: each node's smaller neighbours meet at the least of them.
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v")
        new = small.select(F.col("m").alias("u"), "v").union(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        new, new_at = save(new)
        now = mark(new)
        drop(spark, at)
        edges, at = new, new_at
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash.

    component_id is the smallest doc_id that links reach, the row's own
    included (null doc_ids only where there is no other); kept where it is the
    row's own.  Texts without words, null and empty ones too, are linked with
    nothing; texts of any length are read whole.  Rows that repeat a doc_id and
    text share a set and are both kept or both not; which of several candidates
    is tried first (ties by set) changes no result.  An empty table gives no
    rows; further columns are ignored, whatever their names.
    """
    threshold = percent / 100
    rows, _ = save(sketches(docs, width))
    some = rows.where("set_id is not null")
    nodes, nodes_at = save(
        some.groupBy("set_id").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("doc"), F.first("n_shingles").alias("n"), F.first("orders").alias("orders"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")
        )
    )
    pairs = candidates(nodes, threshold)
    involved = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    keys, keys_at = save(nodes.select("set_id", "doc.doc_id", "doc.text_hash").join(involved, "set_id"))
    sets, sets_at = save(full_sets(docs, keys, width))
    drop(docs.sparkSession, keys_at)
    # Each set's best candidate first ...
    ends = pairs.select("a", "b", "same", F.explode(F.array("a", "b")).alias("end"))
    best = ends.groupBy("end").agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p")).select("p.*").distinct()
    best, best_at = save(best)
    links, _ = save(confirm(best, sets, percent))
    roots = components(links)
    # ... then those that would join components.
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    open_ = pairs.join(best, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    open_ = open_.where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more, _ = save(confirm(open_, sets, percent))
    drop(docs.sparkSession, best_at)
    links = links.union(more)
    roots = components(links)
    # ... then all that share a region and are still apart.
    drop(docs.sparkSession, sets_at)
    last = crowded_links(docs, nodes, roots, width, percent)
    roots = components(links.union(last))
    node_root = nodes.select("set_id", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    group = F.coalesce("root", "set_id")
    labels = node_root.groupBy(group.alias("group")).agg(F.min("least").alias("component_id"))
    of_set, _ = save(node_root.select("set_id", group.alias("group")).join(labels, "group").select("set_id", "component_id", F.lit(True).alias("has")))
    drop(docs.sparkSession, nodes_at)
    out = rows.select("doc_id", "n_shingles", "set_id", "text_hash").join(of_set, "set_id", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each component, the one with the smallest doc_id.

    Rows that repeat a doc_id and text count once; of such the one whose other
    columns are least stays.  Texts without words all stay; columns of any name
    are carried along.
    """
    spark = docs.sparkSession
    found, found_at = save(near_duplicates(docs, width, percent))
    key = ("doc_id", "text_hash")
    gone, _ = save(found.where("not kept").select(*key).distinct())
    again = not found.where("kept").groupBy(*key).count().where("count > 1").isEmpty()
    drop(spark, found_at)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.struct(*docs.columns).alias("row"))
    left = with_lists(rows, gone, "left_anti")
    if again:
        left = left.groupBy(*key).agg(F.min("row").alias("row"))
    return left.select("row.*")
