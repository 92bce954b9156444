"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree holds centroids only and grows with the table: its upper levels are
fitted on a bounded sample, and where that is too small for as many leaves as
the table needs, each branch is fitted further on a bounded sample of its own
rows.  Every row of the table is then assigned to a leaf.  A query walks the
tree best bin first: a priority queue holds open branches by distance, the
nearest is opened, and leaves are visited in that order.  How many leaves are
visited is calibrated: the number is widened until sampled queries, held
against brute force over a sample without themselves, reach the wanted recall.
Vectors without any structure have their neighbours in nearly all leaves, and
calibration then says so; clustered ones need few.

Rows and queries meet in tiles of bounded size: a block of rows (neighbouring
leaves, or a part of a large one) and a slab of the queries that visit a leaf of
it.  A query travels once to each block it visits, with a bit for each of its
leaves there, never once to each leaf.  Within a tile a leaf is multiplied with
the queries that visit it; what comes near a query's floor (its k-th best of
the sample's rows in leaves it visits, later its k-th best so far) is scored
exactly.  Of rows with equal vectors in a leaf, a tile scores those that a
tie can let through.  Each tile returns at most k rows for a query.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pagewright.llm.common import drop, save, ship
from pagewright.llm.wordsplit import ragged

#: More than a product of unit vectors in double precision can differ from their cosine.
SLACK = 1e-10
#: Components of a tile's queries, and of its rows, at most; and scores held at once.
TILE_COMPONENTS, SCORES = 8_000_000, 2_000_000


class Tree(NamedTuple):
    """Nodes in order of making: centroids, first child and number of children (0: a leaf), and the leaf's number."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors, and the nearest of each row. Fewer than k where rows coincide."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    own = (x @ centers.T).argmax(1)
    for _ in range(rounds):
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centers = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centers)
        new = (x @ centers.T).argmax(1)
        if np.array_equal(new, own):
            break
        own = new
    return centers, own


def fit(sample: np.ndarray, branch: int, leaf_size: int, seed: int = 5) -> Tree:
    """Split nodes of unit vectors until they have at most ``leaf_size`` sample rows or no two different ones."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    centroids, first, count, leaf = [np.zeros(dim)], [0], [0], [-1]
    open_, leaves = [(0, np.arange(len(sample)))], 0
    while open_:
        node, rows = open_.pop()
        centers = np.zeros((0, dim))
        if len(rows) > leaf_size:
            centers, own = k_means(sample[rows], branch, rng)
        if len(centers) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], count[node] = len(centroids), len(centers)
        for i, c in enumerate(centers):
            centroids.append(c), first.append(0), count.append(0), leaf.append(-1)
            open_.append((first[node] + i, rows[own == i]))
    return Tree(np.array(centroids), np.array(first), np.array(count), np.array(leaf))


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each unit vector, going down by the nearest child."""
    node = np.zeros(len(x), np.int64)
    todo = np.arange(len(x))
    while len(todo := todo[tree.count[node[todo]] > 0]):
        for n in np.unique(node[todo]):
            rows = todo[node[todo] == n]
            near = (x[rows] @ tree.centroids[tree.first[n] : tree.first[n] + tree.count[n]].T).argmax(1)
            node[rows] = tree.first[n] + near
    return tree.leaf[node]


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves that a best-bin-first walk reaches."""
    out, queue = [], [(0.0, 0)]
    while queue and len(out) < visits:
        _, n = heapq.heappop(queue)
        if not tree.count[n]:
            out.append(int(tree.leaf[n]))
            continue
        a, b = tree.first[n], tree.first[n] + tree.count[n]
        for i, s in enumerate((tree.centroids[a:b] @ -q).tolist(), a):
            heapq.heappush(queue, (s, i))
    return out


def path_minima(tree: Tree, q: np.ndarray) -> list[np.ndarray]:
    """For each query and leaf the least score on the leaf's path, from its last node on, ..., from its first node on.

    Of two leaves a best-bin-first walk reaches the one first whose worst node
    below their last common branch is the better one.  The common part of the two
    paths lowers both alike, so paths compare by their minima from the first node
    on, then from the second, and so on.
    """
    parent = np.full(len(tree.first), -1)
    inner = np.flatnonzero(tree.count)
    parent[1:] = np.repeat(inner, tree.count[inner])[np.argsort(ragged(tree.first[inner], tree.count[inner]))]
    node = np.empty(int(tree.leaf.max()) + 1, np.int64)
    node[tree.leaf[tree.count == 0]] = np.flatnonzero(tree.count == 0)
    paths = [node]
    while (paths[-1] > 0).any():
        paths.append(np.where(paths[-1] > 0, parent[paths[-1]], 0))
    steps = np.array(paths)
    depth = (steps > 0).sum(0)
    scores = q @ tree.centroids.T
    scores[:, 0] = np.inf  # the root, which stands for what a shorter path lacks
    low, out = np.full((len(q), len(node)), np.inf), []
    for level in range(int(depth.max()), 0, -1):
        at = np.where(depth >= level, steps[np.maximum(depth - level, 0), np.arange(len(node))], 0)
        low = np.minimum(low, scores[:, at])
        out.append(low)
    return out or [low]


def walk_order(tree: Tree, q: np.ndarray) -> np.ndarray:
    """For each query all leaves in the order in which a best-bin-first walk reaches them."""
    return np.lexsort([-low for low in path_minima(tree, q)], axis=-1)


def visited_leaves(tree: Tree, q: np.ndarray, visits: int) -> np.ndarray:
    """Whether each query's walk of ``visits`` leaves reaches each leaf; single walks where they are short."""
    leaves = int(tree.leaf.max()) + 1
    out = np.full((len(q), leaves), visits >= leaves)
    if 20 * visits < leaves:
        for row, x in zip(out, q, strict=True):
            row[best_bins(tree, x, visits)] = True
    elif visits < leaves:
        # Only leaves with the same least score as the last one need more than that.
        lows = path_minima(tree, q)
        last = np.partition(lows[-1], leaves - visits, axis=1)[:, leaves - visits]
        out = lows[-1] > last[:, None]
        open_ = lows[-1] == last[:, None]
        for i, need in enumerate((visits - out.sum(1)).tolist()):
            tied = np.flatnonzero(open_[i])
            out[i, tied[np.lexsort([-low[i, tied] for low in lows])[:need]]] = True
    return out


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """The least number of leaf visits (widened by half each time) with the wanted recall on the sample."""
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]  # copies find each other in any leaf, whatever the others need
    at = np.arange(0, len(sample), max(1, len(sample) // queries))
    probe, leaves = sample[at], assign(tree, sample)
    scores = probe @ sample.T
    scores[np.arange(len(at)), at] = -np.inf  # a query is not its own neighbour
    top = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    most = int(tree.leaf.max()) + 1
    # The place at which each query's walk comes to each of its neighbours' leaves.
    place = np.empty(most, np.int64)
    need = []
    step = max(1, SCORES // most)
    walks = (w for i in range(0, len(probe), step) for w in walk_order(tree, probe[i : i + step]))
    for walk, t in zip(walks, top, strict=True):
        place[walk] = np.arange(most)
        need.append(place[leaves[t]])
    need = np.concatenate(need) if need else np.zeros(0)
    visits = 1
    while visits < most and len(need) and (need < visits).mean() < recall:
        visits = min(most, visits + max(1, visits // 8))
    return visits


def graft(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """The tree with some of its leaves replaced by trees; leaves numbered anew."""
    centroids, first, count = [tree.centroids], tree.first.copy(), tree.count.copy()
    firsts, counts, made = [first], [count], len(first)
    for node in np.flatnonzero(tree.count == 0):
        part = parts.get(int(tree.leaf[node]))
        if part is None or len(part.count) < 2:
            continue
        # The part's root is this node; its other nodes follow all there are.
        first[node], count[node] = part.first[0] - 1 + made, part.count[0]
        centroids.append(part.centroids[1:])
        firsts.append(np.where(part.count[1:] > 0, part.first[1:] - 1 + made, 0))
        counts.append(part.count[1:])
        made += len(part.count) - 1
    first, count = np.concatenate(firsts), np.concatenate(counts)
    leaf = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.concatenate(centroids), first, count, leaf)


#: Components of all centroids of a tree: 64 MB, broadcast.
MOST_COMPONENTS = 8_000_000


def deepen(rows: DataFrame, top: Tree, branch: int, leaves: int, sample_rows: int) -> Tree:
    """Fit the leaves of ``top`` further, each on about ``sample_rows`` of its rows, towards ``leaves`` leaves in all."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(top)
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(assign(sent.value, x).astype(np.int32))], names=["vec_id", "v", "leaf"])

    placed, placed_at = save(rows.select("vec_id", "v").mapInArrow(place, f"vec_id long, v {kind}, leaf int"))
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf of a tree fitted on a bounded sample
    total = sum(sizes.values())
    wanted = {leaf: max(1, round(leaves * n / total)) for leaf, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for leaf, n in sizes.items() for x in (leaf, min(1.0, sample_rows / n))])
    draw = F.pmod(F.xxhash64("vec_id", "v", F.lit(12)), F.lit(1 << 30)) < F.element_at(share, F.col("leaf")) * float(1 << 30)

    def run(key, table):
        leaf = key[0].as_py()
        x = unit(_matrix(table.column("v")))
        part = fit(x, branch, max(8, -(-len(x) // wanted[leaf])), seed=leaf)
        cols = [part.centroids.tobytes(), *(c.astype(np.int64).tobytes() for c in part[1:])]
        return pa.table([pa.array([leaf], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], names=["at", *Tree._fields])

    made = placed.where(draw).groupBy("leaf").applyInArrow(run, "at int, " + ", ".join(f"{n} binary" for n in Tree._fields))
    dim = top.centroids.shape[1]
    parts = {r["at"]: Tree(np.frombuffer(r["centroids"]).reshape(-1, dim), *(np.frombuffer(r[n], np.int64) for n in Tree._fields[1:])) for r in made.toLocalIterator()}
    drop(spark, placed_at)
    return graft(top, parts)


def usable(vec: Column) -> Column:
    """Vectors that take part: not null, with finite components only, not all zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vec.isNotNull() & fine & F.exists(vec, lambda v: v != 0)


def _given(column: pa.Array) -> np.ndarray:
    """The vectors as they are stored, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return _given(column).astype(np.float64)


class Layout(NamedTuple):
    """Leaves from lo to hi (exclusive) of each group of blocks, its first block, and in how many blocks its rows are dealt."""

    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    pieces: np.ndarray


def lay_out(sizes: np.ndarray, block_rows: int) -> Layout:
    """Blocks of about ``block_rows`` rows: neighbouring small leaves together, a large leaf dealt over several."""
    lo, pieces, held = [], [], 0
    for leaf, n in enumerate(sizes.tolist()):
        if n > block_rows or held + n > block_rows or not lo:
            lo.append(leaf)
            pieces.append(max(1, -(-n // block_rows)))
            held = 0
        held = block_rows if n > block_rows else held + n
    pieces = np.array(pieces)
    return Layout(np.array(lo), np.array([*lo[1:], len(sizes)]), np.cumsum(pieces) - pieces, pieces)


def floors(q: np.ndarray, qid: np.ndarray, visited: np.ndarray, sample: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
    """For each query (unit vectors) a score that its k-th best row in the leaves it visits has at least."""
    if len(sample) < k:
        return np.full(len(q), -np.inf)
    scores = np.where(visited[:, leaf] & (ids != qid[:, None]), q @ sample.T, -np.inf)
    return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k] - SLACK


def few_copies(x: np.ndarray, vid: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
    """The rows without those of equal vectors in a leaf that come too late in a tie for any query: k rows of k + 1 ids stay."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    at = np.arange(len(x))
    if same.max(initial=-1) + 1 == len(x):
        return at
    same = same * (int(leaf.max()) + 1) + leaf
    order = np.lexsort((vid, same))
    new = np.concatenate([[True], np.diff(same[order]) != 0])
    new_id = new | np.concatenate([[True], np.diff(vid[order]) != 0])
    of_id = at - np.maximum.accumulate(np.where(new_id, at, 0))
    nth = np.cumsum(new_id)
    nth -= nth[np.maximum.accumulate(np.where(new, at, 0))]
    return np.sort(order[(of_id < k) & (nth <= k)])


def search_tile(q: np.ndarray, qid: np.ndarray, visited: np.ndarray, floor: np.ndarray, x: np.ndarray, vid: np.ndarray, leaf: np.ndarray, k: int):
    """For some queries at a time: ids, row ids and scores of at most k best rows each, of the leaves that a query visits.

    Exact cosine in double precision, ties to the smaller id, a query's own id
    left out.  q are doubles, x as stored; qid is sorted, an id once.  Products in
    single precision, which err by (components + 2) / 2**24 at most, tell which
    pairs are scored exactly; where those are many, products in double precision.
    """
    keep = few_copies(x, vid, leaf, k)
    keep = keep[np.argsort(leaf[keep], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(leaf[keep]) != 0, [True]]))
    rows_at_once, dim = 1024, x.shape[1]
    slack = (dim + 8) / 2**23
    step = SCORES // rows_at_once
    pairs = max(1, SCORES // dim)
    for i in range(0, len(q), step):
        ids, own_q, sees, least = qid[i : i + step], q[i : i + step], visited[i : i + step], floor[i : i + step].copy()
        norm = np.sqrt((own_q * own_q).sum(1))
        units = own_q / norm[:, None]
        short = units.astype(np.float32)
        top, top_id = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            who = np.flatnonzero(sees[:, leaf[keep[begin]]])
            if not len(who):
                continue
            asking = short[who]
            for a in range(begin, end, rows_at_once):
                at = keep[a : min(end, a + rows_at_once)]
                rows, row_id = x[at].astype(np.float64), vid[at]
                row_norm = np.sqrt((rows * rows).sum(1))
                row_units = rows / row_norm[:, None]
                # A query is not its own neighbour.
                place = np.minimum(np.searchsorted(ids[who], row_id), len(who) - 1)
                itself = np.flatnonzero(ids[who[place]] == row_id)
                scores = asking @ row_units.astype(np.float32).T
                scores[place[itself], itself] = -np.inf
                near = np.flatnonzero(scores >= (least[who] - slack).astype(np.float32)[:, None])
                if len(near) > 4 * k * len(who):
                    scores = units[who] @ row_units.T
                    scores[place[itself], itself] = -np.inf
                    best = np.partition(scores, max(0, len(at) - k), axis=1)[:, max(0, len(at) - k)]
                    near = np.flatnonzero(scores >= np.maximum(least[who], best - SLACK)[:, None])
                asks, row = who[near // len(at)], near % len(at)
                real = scores.ravel()[near] > -np.inf
                asks, row = asks[real], row[real]
                if not len(asks):
                    continue
                exact = np.empty(len(asks))
                for j in range(0, len(asks), pairs):
                    o, r = asks[j : j + pairs], row[j : j + pairs]
                    exact[j : j + pairs] = (rows[r] * own_q[o]).sum(1) / (row_norm[r] * norm[o])
                # The best so far and the new ones, in order; k of each query stay.
                some = np.unique(asks)
                whose = np.concatenate([np.repeat(some, k), asks])
                score = np.concatenate([top[some].ravel(), exact])
                whom = np.concatenate([top_id[some].ravel(), row_id[row]])
                order = np.lexsort((whom, -score, whose))
                whose, score, whom = whose[order], score[order], whom[order]
                rank = np.arange(len(whose)) - np.searchsorted(whose, whose)
                good = rank < k
                top[whose[good], rank[good]], top_id[whose[good], rank[good]] = score[good], whom[good]
                least[some] = np.maximum(least[some], top[some, k - 1] - SLACK)
        found = np.flatnonzero(top.ravel() > -np.inf)
        yield ids[found // k], top_id.ravel()[found], top.ravel()[found]


def build(rows: DataFrame, picked: np.ndarray, total: int, k: int, branch: int, leaf_rows: int, recall: float, sample_rows: int) -> tuple[Tree, int]:
    """The tree for ``total`` rows from the unit vectors of a sample, and the leaves to visit."""
    leaves = max(1, min(total // leaf_rows, MOST_COMPONENTS // picked.shape[1] // 2))
    size = -(-len(picked) // leaves)
    tree = fit(picked, branch, max(8, size))
    if size < 8 and len(picked) < total:
        top = fit(picked, branch, max(8, len(picked) // branch))
        tree = deepen(rows, top, branch, leaves, sample_rows)
    return tree, calibrate(tree, picked, k, recall)


def search(
    table: DataFrame,
    queries: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    sample_rows: int = 20_000,
    branch: int = 12,
    leaf_rows: int = 500,
    recall: float = 0.95,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest rows by cosine of every row for which ``queries`` holds: query_id, rank, vec_id, score.

    sample_rows bounds what the tree, each of its branches and the number of
    visits are fitted on (fewer where vectors are long: 4,000,000 components at
    most); leaves hold about leaf_rows rows, as long as all centroids have
    8,000,000 components at most.  recall is what the visits are calibrated to.
    block_rows bounds the rows of a tile (by default a few tiles for each core,
    of 8,000,000 components at most).
    Every usable row is indexed; fewer than k candidates give all.  Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do
    rows with a null id, nor vectors of another length than the first one's.
    Rows with one id are each a candidate for other ids, and one query (the least
    vector).  Ties go to the smaller id.  An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    ship(spark)
    given = table.select(F.col(vec).alias("v")).schema["v"].dataType
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    every = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast(kind).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    fine = F.col("vec_id").isNotNull() & usable(F.col("v"))
    rows = every.where(fine)
    schema = "query_id long, rank int, vec_id long, score double"
    stats = rows.agg(F.count(F.lit(1)), F.min_by(F.size("v"), "vec_id"), F.count_if("is_query")).first()
    if not stats[0]:
        return spark.createDataFrame([], schema)
    total, dim, n_queries = stats
    fits = F.size("v") == dim
    rows = rows.where(fits)
    sample_rows = max(1, min(sample_rows, 4_000_000 // max(1, dim)))
    share = min(1.0, sample_rows / total)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    # Bounded: about sample_rows vectors; twice that cannot be passed.
    drawn = [(r["vec_id"], r["v"]) for r in every.where(draw).where(fine & fits).select("vec_id", "v").limit(2 * sample_rows).toLocalIterator()]
    drawn = drawn or [(r["vec_id"], r["v"]) for r in rows.select("vec_id", "v").limit(1).collect()]
    picked_id, picked = np.array([r[0] for r in drawn], np.int64), unit(np.array([r[1] for r in drawn], np.float64))
    del drawn
    tree, visits = build(rows, picked, total, k, branch, leaf_rows, recall, sample_rows)
    sent = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in batches:
            if b.num_rows:
                leaf = assign(sent.value, unit(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "is_query", "leaf"])

    placed, _ = save(rows.mapInArrow(index, f"vec_id long, v {kind}, is_query boolean, leaf int"))
    # The number of leaves is bounded by MOST_COMPONENTS, so this is small.
    leaves = int(tree.leaf.max()) + 1
    sizes = np.zeros(leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    cores = spark.sparkContext.defaultParallelism
    most = max(1, TILE_COMPONENTS // dim)
    layout = lay_out(sizes, block_rows or min(most, max(256, total // (4 * cores))))
    slabs = max(1, -(-n_queries // most))
    group = np.repeat(np.arange(len(layout.lo)), layout.hi - layout.lo)
    table_of = list(zip(range(leaves), layout.first[group].tolist(), layout.pieces[group].tolist(), layout.lo[group].tolist(), strict=True))
    blocks = spark.createDataFrame(table_of, "leaf int, first int, pieces int, lo int")
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).cast("int")
    data = placed.join(F.broadcast(blocks), "leaf").select(block.alias("block"), "vec_id", "v", (F.col("leaf") - F.col("lo")).alias("leaf"))
    data = data.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))) if slabs > 1 else F.lit(0))
    known = spark.sparkContext.broadcast((picked, picked_id, assign(tree, picked), layout))
    at_once = max(1, SCORES // max(leaves, len(picked)))

    def route(batches):
        tree, (sample, sample_id, sample_leaf, lay) = sent.value, known.value
        wide = max(1, SCORES // dim)
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                q, qid = unit(_matrix(part.column(1))), part.column(0).to_numpy()
                visited = visited_leaves(tree, q, visits)
                floor = floors(q, qid, visited, sample, sample_id, sample_leaf, k)
                goes = np.logical_or.reduceat(visited, lay.lo, axis=1)
                at, to, bits = [], [], []
                for g in range(len(lay.lo)):
                    who = np.flatnonzero(goes[:, g])
                    packed = [x.tobytes() for x in np.packbits(visited[who, lay.lo[g] : lay.hi[g]], axis=1)]
                    at += [who] * int(lay.pieces[g])
                    to.append(np.repeat(np.arange(lay.first[g], lay.first[g] + lay.pieces[g]), len(who)))
                    bits += packed * int(lay.pieces[g])
                at, to = np.concatenate(at), np.concatenate(to).astype(np.int32)
                for j in range(0, len(at), wide):
                    take = pa.array(at[j : j + wide])
                    cols = [part.column(0).take(take), part.column(1).take(take), pa.array(to[j : j + wide]), pa.array(bits[j : j + wide], pa.binary()), pa.array(floor[at[j : j + wide]])]
                    yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "block", "visited", "floor"])

    asked = placed.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")).repartition(max(cores, n_queries // 4096))
    asked = asked.mapInArrow(route, f"vec_id long, v {kind}, block int, visited binary, floor double")
    asked = asked.withColumn("slab", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(slabs)).cast("int"))

    def find(q: pa.Table, d: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and d.num_rows:
            q = q.sort_by("vec_id")
            bits = np.frombuffer(b"".join(q.column("visited").to_pylist()), np.uint8).reshape(q.num_rows, -1)
            asks = (_matrix(q.column("v")), q.column("vec_id").to_numpy(), np.unpackbits(bits, axis=1).view(bool), q.column("floor").to_numpy())
            parts = list(search_tile(*asks, _given(d.column("v")), d.column("vec_id").to_numpy(), d.column("leaf").to_numpy(), k))
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    near = asked.groupBy("block", "slab").cogroup(data.groupBy("block", "slab")).applyInArrow(find, "query_id long, vec_id long, score double")
    # At most k rows a tile for each query; only the best k of a query go on.
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    top = near.groupBy("query_id").agg(F.slice(best, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("p", "t")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.v").alias("vec_id"), (-F.col("t.s")).alias("score")
    )
