"""Repeated long byte strings by merging Burrows-Wheeler transforms of shards.

Texts are parsed at anchors that follow from their own bytes: the least k-gram
hash among each ``window`` positions.  Equal stretches are parsed alike, so a
repeated string of ``min_len`` bytes shows as an equal run of whole phrases after
its first anchor.

1. Every shard (a batch of documents) builds the transform of its phrase strings,
   one string for each anchor: the phrases that a repeat through it must share.
2. Strings meet by their first phrase.  There the shards' transforms are merged
   by refining the interleave: one stable pass by transform symbol for each
   symbol of depth.  Block borders that appear in pass h give common prefixes of
   h - 1 symbols, and blocks that last give the repeated intervals.  No suffix is
   sorted again.
3. A check on bytes follows, on the anchors of repeated intervals only.  All
   starts of an anchor are taken at once, then blocks of starts, then single
   ones: a range of starts is decided as soon as the bytes that cover it repeat
   (all of them do) or the bytes common to it do not (none does).  Bytes are
   compared by two independent 64-bit hashes, 128 bits together: no two of 10^14
   strings are likely to clash.

Shards pass on counts of distinct strings, never lists of occurrences; the
occurrences are found again by a join that can be split.  So a passage in a third
of all documents needs no task of its own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, save, ship, skew_join, text_chunks, with_lists
from pagewright.llm.wordsplit import ragged

CHUNK = 1_000_000
GRAM = 16
#: Bytes of the texts that are hashed at a time.
SPAN = 1 << 16
#: Starts in a block of the exact check.
BLOCK = 10
#: Input bytes for each group of first phrases.
BUCKET_BYTES = 8 << 20
CORE, COVER = ("core", "core2"), ("cover", "cover2")


#: The bases of the two hashes, odd numbers without structure.
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


@lru_cache(2)
def _byte_values(which: int = 0) -> np.ndarray:
    return np.random.default_rng((977, 1409)[which]).integers(0, 1 << 64, 256, np.uint64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get((which, True), ())) < n:
        for up in (True, False):
            p = np.full(n, BASES[which] if up else pow(BASES[which], -1, 1 << 64), np.uint64)
            p[0] = 1
            _powers[which, up] = np.cumprod(p, dtype=np.uint64)
    return _powers[which, True], _powers[which, False]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bytes:
    """Texts end to end with two hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    def hash(self, a: np.ndarray, b: np.ndarray, salt=0, which: int = 0) -> np.ndarray:
        """64-bit hashes of the bytes from a to b, told apart by length and salt."""
        n = len(self.data)
        up, down = _power(max(1 << 20, n + 1), which)
        if which not in self.sums:
            self.sums[which] = sums = np.zeros(n + 1, np.uint64)
            for a0 in range(0, n, SPAN):  # in spans, so that nothing else is as long as the texts
                b0 = min(a0 + SPAN, n)
                part = _byte_values(which)[self.data[a0:b0]]
                part *= up[a0:b0]
                part[:1] += sums[a0 : a0 + 1]
                np.cumsum(part, out=sums[a0 + 1 : b0 + 1])
        sums = self.sums[which]
        h = (sums[b] - sums[a]) * down[a]
        return _mix(h ^ ((b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ _mix(np.atleast_1d(salt).astype(np.uint64) + np.uint64(1)))


def shape(min_len: int) -> tuple[int, int]:
    """Window of the anchors and the bytes of whole phrases that a repeat shares after its first anchor."""
    window = 3 * min_len // 8
    return window, (min_len - window - GRAM + 1) - (window - 1)


def least_grams(data: np.ndarray, starts: int, window: int) -> np.ndarray:
    """For each of the first ``starts`` positions, the place of the least k-gram hash among ``window`` positions from it on."""
    n = len(data)
    h = _byte_values()[data]
    step = 1
    while step < GRAM:  # the hash of 16 bytes out of two of 8, and so on
        nxt = np.zeros_like(h)
        nxt[: n - step] = h[step:]
        h = _mix(h * np.uint64(BASES[0]) + nxt)
        step *= 2
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        low[: n - width] = np.minimum(low[: n - width], low[width:])
        width *= 2
    reach = window - width
    if reach:
        low[: n - reach] = np.minimum(low[: n - reach], low[reach:])
    return (low[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors_of(by: Bytes, long: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ``long`` texts' anchors: place, text, and the first and last window start that picks it.

    Texts are read a span of bytes at a time: a dozen numbers of eight bytes
    stand for each byte of a span, and only anchors are kept.
    """
    wide = window + GRAM - 1  # bytes that decide an anchor
    begin, end = by.begin[long], by.begin[long] + by.size[long] - wide + 1  # of the starts
    none = np.zeros(0, np.int64)
    pos, doc, first, before = [none], [none], [none], [none]
    kept = (-1, -1, -1)  # the last start so far, its text and its pick
    for a in range(0, len(by.data), SPAN):
        b = min(a + SPAN, len(by.data))
        some = slice(np.searchsorted(end, a, side="right"), np.searchsorted(begin, b))
        lo, hi = np.maximum(begin[some], a), np.minimum(end[some], b)
        at = ragged(lo, hi - lo)
        if not len(at):
            continue
        own = np.repeat(long[some], hi - lo)
        pick = least_grams(by.data[a : min(b + wide, len(by.data))], b - a, window)[at - a] + a
        earlier, owner, picked = (np.concatenate([[k], x[:-1]]) for k, x in zip(kept, (at, own, pick), strict=True))
        new = np.flatnonzero((pick != picked) | (own != owner))
        for out, x in ((pos, pick), (doc, own), (first, at), (before, earlier)):
            out.append(x[new])
        kept = (at[-1], own[-1], pick[-1])
    last = np.append(np.concatenate(before)[1:], kept[0]) if len(pos) > 1 else none
    return np.concatenate(pos), np.concatenate(doc), np.concatenate(first), last


class Anchors:
    """The anchors of some texts. For those that are the first of a string of min_len: the range of such starts, the phrase string and its key."""

    def __init__(self, texts: list[bytes], min_len: int):
        self.bytes = by = Bytes(texts)
        window, need = shape(min_len)
        self.min_len = min_len
        self.pos, self.doc, first, last = anchors_of(by, np.flatnonzero(by.size >= min_len), window)
        limit = by.begin[self.doc] + by.size[self.doc] - min_len
        self.use = np.flatnonzero(first <= limit)
        self.start, self.end = first[self.use], np.minimum(last, limit)[self.use]
        self.to = np.searchsorted(self.pos, self.pos[self.use] + need)
        self.key = by.hash(self.pos[self.use], self.pos[self.to]) if len(self.use) else np.zeros(0, np.uint64)

    def phrases(self) -> np.ndarray:
        """The symbol of the phrase after each anchor (the last of a text: no meaning); never 0."""
        if not len(self.pos):
            return np.zeros(0, np.uint64)
        return self.bytes.hash(self.pos, np.append(self.pos[1:], self.pos[-1]), 7) | np.uint64(1)


def suffix_order(symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of all suffixes of strings (each ends in a terminator, the least symbol), by prefix doubling."""
    n = len(symbols)
    end = np.repeat(np.cumsum(size), size)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step, most = 1, int(size.max(initial=0))
    at = np.arange(n)
    while step < most:
        ahead = at + step
        second = np.where(ahead < end, rank[np.minimum(ahead, n - 1)] + 1, 0)
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def transform(symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform of strings with terminator 0, and the strings in the order of their whole suffixes."""
    order = suffix_order(symbols, size)
    begin = np.cumsum(size) - size
    head = np.zeros(len(symbols), bool)
    head[begin] = True
    before = np.where(head[order], np.uint64(0), symbols[order - 1])
    owner = np.repeat(np.arange(len(size)), size)
    return before, owner[order[head[order]]]


def stable_order(x: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers from 0 to 2**32 - 1, by their two halves: NumPy sorts 16 bits by counting."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and x.max() > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def merge_transforms(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms by interleave refinement.

    Returns the interleave (which part each row comes from), the common prefix of
    each row with the one before (terminators count as equal symbols), and the
    merged transform.
    """
    sizes = [len(p) for p in parts]
    if not sum(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    both = np.concatenate(parts)
    alphabet, code = np.unique(both, return_inverse=True)
    code = code.astype(np.int32)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    from_part = np.repeat(np.arange(len(parts)), sizes)  # the interleave at depth 0
    block = np.zeros(len(both), np.int64)
    common = np.full(len(both), -1, np.int64)
    common[:1] = 0
    depth = 0
    while True:
        # The next symbol of each part, in interleaved order.
        order = stable_order(from_part)
        within = np.empty(len(both), np.int64)
        within[order] = np.arange(len(both)) - np.repeat(offset, sizes)
        symbol = code[offset[from_part] + within]
        go = stable_order(symbol)
        new_part, new_symbol, old_block = from_part[go], symbol[go], block[go]
        # Nothing follows a terminator, so rows that begin with one stay together.
        border = np.concatenate([[True], (new_symbol[1:] != new_symbol[:-1]) | ((old_block[1:] != old_block[:-1]) & (alphabet[new_symbol[1:]] != 0))])
        fresh = border & (common < 0)
        common[fresh] = depth
        depth += 1
        from_part, block = new_part, np.cumsum(border)
        if not fresh.any():  # then no pair has a longer common prefix that ends
            break
    order = stable_order(from_part)
    within = np.empty(len(both), np.int64)
    within[order] = np.arange(len(both)) - np.repeat(offset, sizes)
    common[common < 0] = np.iinfo(np.int64).max  # equal to the end
    return from_part, common, alphabet[code[offset[from_part] + within]]


def repeated_strings(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Keys of the strings that occur twice or more in all.

    parts: of each shard the transform, and in the order of its whole suffixes
    the strings' keys, counts and lengths with terminator.
    """
    from_part, common, merged = merge_transforms([p[0] for p in parts])
    whole = np.flatnonzero(merged == 0)  # rows before which a string begins: whole strings
    source = from_part[whole]
    order = np.argsort(source, kind="stable")
    key, count, size = (np.empty(len(whole), t) for t in (np.uint64, np.int64, np.int64))
    for i, out in ((1, key), (2, count), (3, size)):
        out[order] = np.concatenate([p[i] for p in parts])
    # A whole string goes on from the row before if they agree up to and with the terminator.
    joined = np.zeros(len(whole), bool)
    if len(whole) > 1:
        joined[1:] = np.minimum.reduceat(common[: whole[-1] + 1], whole[:-1] + 1) >= size[1:]
    interval = np.cumsum(~joined) - 1
    total = np.bincount(interval, weights=count) if len(whole) else np.zeros(0)
    return key[total[interval] >= 2] if len(whole) else key


def _bytes(table: pa.Table) -> list[bytes]:
    return [x if x is not None else b"" for x in table.column("text").to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def shard_transforms(docs: DataFrame, min_len: int, buckets: int) -> DataFrame:
    """(bucket, transform, keys, counts, sizes, known) of each shard.

    Strings meet by their first two phrases.  known: the keys of those that the
    shard itself holds twice; they are decided, so the transform leaves them out,
    and a passage that is in every shard stays a number a shard.
    """

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            found = Anchors(_bytes(table), min_len)
            key, first, count = np.unique(found.key, return_index=True, return_counts=True)
            if not len(key):
                continue
            symbols = found.phrases()
            head = found.use[first]
            size = found.to[first] - head + 1  # and the terminator
            flat = np.zeros(int(size.sum()), np.uint64)
            spots = ragged(np.cumsum(size) - size, size - 1)
            flat[spots] = symbols[ragged(head, size - 1)]
            begin = np.cumsum(size) - size
            bucket = (_mix(flat[begin] + _mix(flat[begin + 1])) >> np.uint64(8)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) > 0, [True]]))
            cols: list[list] = [[], [], [], [], [], []]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = int(bucket[by[a]])
                own = by[a:b]
                known, own = key[own[count[own] > 1]], own[count[own] == 1]
                out, order = transform(flat[ragged(begin[own], size[own])], size[own])
                own = own[order]
                row = (at, out.tobytes(), key[own].tobytes(), count[own].astype(np.int32).tobytes(), size[own].astype(np.int32).tobytes(), known.tobytes())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            names = ["bucket", "transform", "keys", "counts", "sizes", "known"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.binary()] * 5), strict=True)], names=names)

    return docs.select("text").mapInArrow(run, "bucket long, transform binary, keys binary, counts binary, sizes binary, known binary")


def _merge_bucket(table: pa.Table) -> pa.Table:
    rows = zip(*(table.column(c).to_pylist() for c in ("transform", "keys", "counts", "sizes")), strict=True)
    parts = [tuple(np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.uint64, np.int32, np.int32), strict=True)) for row in rows]
    known = [np.frombuffer(x, np.uint64) for x in table.column("known").to_pylist()]
    return pa.table({"key": pa.array(np.unique(np.concatenate([repeated_strings(parts), *known])).view(np.int64))})


def place_of(pos: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """An anchor's position and the range of distances from its starts, in one number."""
    return (pos.astype(np.int64) << 32) | (near.astype(np.int64) << 16) | far.astype(np.int64)


def parts_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> 16) & 0xFFFF, place & 0xFFFF


def occurrences(docs: DataFrame, min_len: int) -> DataFrame:
    """Every anchor that is the first of a string of min_len: key, document, place, and hashes (two of each).

    core: of the bytes from the anchor on that all its strings have; cover: of
    the bytes of all its strings.
    """
    window, _ = shape(min_len)

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            f = Anchors(_bytes(table), min_len)
            own = f.doc[f.use]
            pos = f.pos[f.use]
            near, far = pos - f.end, pos - f.start
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(f.key.view(np.int64)),
                    table.column("doc_id").combine_chunks().take(take),
                    table.column("text_hash").combine_chunks().take(take),
                    pa.array(place_of(pos - f.bytes.begin[own], near, far)),
                    *(pa.array(f.bytes.hash(pos, pos + min_len - (window - 1), 3, w).view(np.int64)) for w in (0, 1)),
                    *(pa.array(f.bytes.hash(f.start, f.end + min_len, near * 65536 + far, w).view(np.int64)) for w in (0, 1)),
                ],
                names=["key", "doc_id", "text_hash", "place", *CORE, *COVER],
            )

    return docs.mapInArrow(run, "key long, doc_id long, text_hash long, place long, core long, core2 long, cover long, cover2 long")


def pieces_of_ranges(docs: DataFrame, lists: DataFrame, min_len: int, block: int) -> DataFrame:
    """The listed ranges cut at multiples of ``block`` distances: each piece with its core, cover, document and weight.

    With block 1 a piece is one string.
    """

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            by = Bytes(_bytes(table))
            ranges = table.column("ranges").combine_chunks()
            sizes = ranges.value_lengths().to_numpy()
            flat = ranges.flatten()
            place, weight = (flat.field(c).to_numpy() for c in ("place", "weight"))
            core = [flat.field(c).to_numpy().view(np.uint64) for c in CORE]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pos, near, far = parts_of(place)
            n = far // block - near // block + 1
            ids, texts = table.column("doc_id").combine_chunks(), table.column("text_hash").combine_chunks()
            step = max(1, 100_000 // int(max(1, n.max(initial=1))))
            for i in range(0, len(n), step):
                cut = slice(i, i + step)
                row = np.repeat(np.arange(len(n))[cut], n[cut])
                part = ragged((near // block)[cut], n[cut])
                lo, hi = np.maximum(near[row], part * block), np.minimum(far[row], part * block + block - 1)
                at = by.begin[doc[row]] + pos[row]
                inner = [by.hash(at - part * block, at - (part * block + block - 1) + min_len, part, w) for w in (0, 1)]
                outer = [by.hash(at - hi, at - lo + min_len, (lo - part * block) * 65536 + hi - part * block, w) for w in (0, 1)]
                take = pa.array(doc[row])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(_mix(core[w][row] ^ inner[w]).view(np.int64)) for w in (0, 1)),
                        *(pa.array(outer[w].view(np.int64)) for w in (0, 1)),
                        ids.take(take),
                        texts.take(take),
                        pa.array(place_of(pos[row], lo, hi)),
                        pa.array(weight[row]),
                    ],
                    names=[*CORE, *COVER, "doc_id", "text_hash", "place", "weight"],
                )

    picked = with_lists(docs, lists, "inner").select("doc_id", "text_hash", "text", "ranges")
    return picked.mapInArrow(run, "core long, core2 long, cover long, cover2 long, doc_id long, text_hash long, place long, weight long")


def decide(found: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Ranges (core, cover, doc_id, text_hash, place, weight) that repeat as a whole, those still open, and the tables both read.

    weight counts what a row stands for.  Of equal covers one goes on, with their
    weights.  A core that occurs once settles its range: no string of it repeats.
    """
    whole, at = save(found.groupBy(*CORE, *COVER).agg(F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "text_hash", "place")).alias("one")))
    repeated, repeated_at = save(whole.where("weight > 1").select(*CORE, *COVER, F.col("weight").alias("n")))
    mixed, mixed_at = save(whole.groupBy(*CORE).agg(F.count(F.lit(1)).alias("kinds"), F.min("weight").alias("least")).where("kinds > 1 and least = 1").drop("least"))
    settled = skew_join(found.where("weight = 1"), repeated, [*CORE, *COVER], "n").select("doc_id", "text_hash", "place")
    return settled, skew_join(whole, mixed, list(CORE), "kinds").select(*CORE, "weight", "one.*"), [at, repeated_at, mixed_at]


def listed(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*CORE, "place", "weight")).alias("ranges"))


def repeated_ranges(docs: DataFrame, min_len: int) -> DataFrame:
    """(doc_id, text_hash, places): ranges of starts whose min_len bytes also start elsewhere."""
    spark = docs.sparkSession
    ship(spark)
    source = keyed(docs).where(F.octet_length("text") >= min_len)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))
    repeated, repeated_at = save(shard_transforms(source, min_len, buckets).groupBy("bucket").applyInArrow(_merge_bucket, "key long"))
    # Equal bytes may be parsed in two ways, by what follows them: a key may come from two buckets, and none may count a place twice.
    found, found_at = save(occurrences(source, min_len).join(repeated, "key", "left_semi").drop("key").withColumn("weight", F.lit(1).cast("long")))
    drop(spark, repeated_at)
    out = []
    for block in (BLOCK, 1, 0):
        settled, open_, read = decide(found)
        kept, kept_at = save(settled)
        out.append((kept, kept_at))
        if block:
            lists, lists_at = save(listed(open_))
            drop(spark, found_at, *read)
            found, found_at = save(pieces_of_ranges(source, lists, min_len, block))
            drop(spark, lists_at)
        else:
            drop(spark, found_at, *read)
    places, _ = save(reduce(DataFrame.union, [x[0] for x in out]).groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places")))
    drop(spark, *[x[1] for x in out])
    return places


def covered(places: list[int], min_len: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings of min_len at the starts of the given places."""
    pos, near, far = parts_of(np.array(places, np.int64))
    out: list[list[int]] = []
    for a, b in sorted(zip((pos - far).tolist(), (pos - near + min_len).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept_text", "string"))


def cut_repeats(docs: DataFrame, min_len: int = 400, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Removed is every byte of a min_len-byte string that also starts anywhere
    else, in the same text or in another row's; overlaps count.  kept_text leaves
    out characters of which a part is removed; kept_sha256 is of the bytes.  Null
    text is empty; a text of any length is read whole, one at a time.  Rows that
    repeat a doc_id and text are copies of each other, so all of such a text
    goes; ties do not arise.  An empty table gives no rows.  A ``keep`` column
    with the name of a result gives way to it; other columns are ignored.
    """
    spans = repeated_ranges(docs, min_len)
    text = F.col("text").cast("string")
    names = [c for c in keep if c not in dict(RESULT)]
    own = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    joined = with_lists(own, spans, "left").select("row", "text", "places")
    schema = joined.select("row").schema
    for name, kind in RESULT:
        schema = schema.add(name, kind)

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            cols: list[list] = [[], [], [], [], []]
            for text, own in zip(_bytes(table), table.column("places").to_pylist(), strict=True):
                cuts = covered(own, min_len) if own else []
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                whole = b"".join(x.decode("utf-8", "ignore").encode() for x in kept)
                for c, v in zip(cols, (len(text), len(text) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), whole), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), *made], names=schema.names)

    return joined.mapInArrow(run, schema).select("row.*", *[name for name, _ in RESULT])
