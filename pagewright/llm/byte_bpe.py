"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

In each task the distinct pieces of a batch become token-position rows.  A
recursive query joins neighbours to the merge table, contracts pairs, and goes on
until no pair merges; an ordered aggregation of token bytes decodes.

A step contracts a pair whose rank is below that of every token with the two bytes
at the pair's left edge, or those at its right edge, side by side.  No merge can
cross these edges while the pair is there, so it is contracted in any order of
merges, and nothing but its own edges depends on when; that holds for every file.
A word without such a pair has all places of its least rank contracted, those that
overlap in turn.  That equals one by one: a merge makes token r out of a pair of
rank r, and no pair with r in it has a lower rank: else r and its neighbour
together are a token of lower rank, which their bytes, met by no merge from
outside, would have become before.  That takes a file in which every token is made
of its own bytes by merges of lower rank; those with a part of higher rank are
tried when the file is read, and a file that does otherwise gets one place a step.

Pieces are cut into words where no token of the vocabulary holds the two bytes
side by side: no merge ever crosses such a place.  Of words of up to SHORT bytes
the rows of every step are kept, fewer than SHORT for a byte.  For longer words the
recursion is keyed by position and holds its last state only, so a piece of any
length takes memory in proportion to it, and time in proportion but for the words
that go on longest.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ship, text_chunks, texts_of
from pagewright.llm.wordsplit import ragged, raw_bytes, split

CHUNK = 6_000_000
#: Distinct pieces that a Python worker remembers between batches (about 100 MB).
REMEMBERED = 400_000
#: Bytes that go through the recursion at once; a longer word goes alone.
ROWS = 250_000
#: Longest word, in bytes, of which the rows of all steps are kept, which is faster than the key.
SHORT = 32
KEY = " USING KEY (k)"
#: No token holds the two bytes side by side.
NEVER = 2**31 - 1
#: k: places of tokens' first bytes, one left out between words, so that no two words are neighbours; n: bytes of the token;
#: l, r: least rank of a token that holds the two bytes at its left and at its right edge. free: pairs that no other merge can reach first.
#: Of hits that overlap the first, third and so on are contracted; {first} limits a step to a word's first place.
#: Words without a pair to contract are done, and leave with their last rows.
ENCODE = """
WITH RECURSIVE state(k, w, tok, n, l, r, done) USING KEY (k) AS (
    SELECT k, w, tok, n, l, r, false FROM start
  UNION ALL
    (WITH pair AS MATERIALIZED (
        SELECT a.k, a.w, a.tok, a.n, a.l, a.r, a.n + b.n AS n_both, b.r AS r_both, m.rank, m.rank < a.l AND m.rank < b.r AS free
        FROM state a
        LEFT JOIN state b ON b.k = a.k + a.n AND NOT b.done
        LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 32) + b.tok
        WHERE NOT a.done
     ), best AS (
        SELECT w, min(rank) AS rank, arg_min(k, (rank, k)) AS k FROM pair WHERE rank IS NOT NULL GROUP BY w HAVING NOT bool_or(free)
     ), hit AS (
        SELECT p.k, p.w, p.n, coalesce(lag(p.k + p.n) OVER (ORDER BY p.k) <> p.k, true) AS opens
        FROM pair p JOIN best ON p.w = best.w AND p.rank = best.rank {first}
     ), pick AS MATERIALIZED (
        SELECT k, w, n FROM pair WHERE free
        UNION ALL
        SELECT k, w, n FROM (SELECT *, nth - max(CASE WHEN opens THEN nth END) OVER (ORDER BY nth) AS behind FROM (SELECT *, row_number() OVER (ORDER BY k) AS nth FROM hit)) WHERE behind % 2 = 0
     )
     SELECT k, w, CASE WHEN picked THEN rank ELSE tok END, CASE WHEN picked THEN n_both ELSE n END, l, CASE WHEN picked THEN r_both ELSE r END, w NOT IN (SELECT DISTINCT w FROM pick)
     FROM (SELECT *, k IN (SELECT k FROM pick) AS picked FROM pair WHERE k NOT IN (SELECT k + n FROM pick)))
)
SELECT w, tok FROM state WHERE done ORDER BY k
"""
DECODE = """
SELECT w, unhex(string_agg(t.hex, '' ORDER BY pos)) AS bytes
FROM ids JOIN tokens t ON t.tok = ids.tok GROUP BY w ORDER BY w
"""


class ByteBPE:
    """A ``.tiktoken`` rank file, its merge table held in DuckDB."""

    def __init__(self, path: str):
        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": False})
        merges = pa.table({"pair": (left << 32) + right, "rank": rank.astype(np.int32)})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        tokens = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM tokens")
        odd = np.unique(rank[(left > rank) | (right > rank)]).tolist()
        by_rank = {r: t for t, r in self.ranks.items()}
        self.encode_sql = ENCODE.format(first="" if all(self.made_from_below(by_rank[r]) for r in odd) else "AND p.k = best.k")
        self.least = np.full(1 << 16, NEVER, np.int32)  # rank of a token that holds the two bytes side by side
        for t, r in self.ranks.items():
            both = np.frombuffer(t, np.uint8).astype(np.int64)
            at = (both[:-1] << 8) + both[1:]
            self.least[at] = np.minimum(self.least[at], r)
        self.known: dict[str, int] = {}  # pieces by place in what follows
        self.ids, self.begin, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.back: list[bytes] = []
        self.met = np.zeros(0, bool)

    def made_from_below(self, token: bytes) -> bool:
        """Whether merges, least rank first, make the token of its bytes without one of a higher rank."""
        parts, most = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, most + 1) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            if ranks[at] > most:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def look_up(self, words: pa.StringArray) -> np.ndarray:
        """Where ids and decoded bytes of every piece are held; only pieces not met before go through DuckDB."""
        strings = words.to_pylist()
        if np.count_nonzero(self.met) > REMEMBERED // 2:  # what was not met since the last turn is forgotten
            self.forget()
        at = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, off = self.encode_words(words.take(pa.array(new)))
            at[new] = np.arange(len(self.back), len(self.back) + len(new))
            self.known.update(zip([strings[i] for i in new.tolist()], at[new].tolist(), strict=True))
            self.back += self.decode_words(ids, off)
            self.begin = np.concatenate([self.begin, len(self.ids) + off[:-1]])
            self.count = np.concatenate([self.count, np.diff(off)])
            self.ids = np.concatenate([self.ids, ids.astype("<u4")])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
        self.met[at] = True
        return at

    def forget(self) -> None:
        """Hold only pieces met since the last time."""
        kept = np.flatnonzero(self.met)
        place = np.cumsum(self.met) - 1
        met = self.met.tolist()
        self.known = {w: p for (w, i), p in zip(self.known.items(), place[list(self.known.values())].tolist(), strict=True) if met[i]}
        self.back = [self.back[i] for i in kept.tolist()]
        self.ids = self.ids[ragged(self.begin[kept], self.count[kept])]
        self.count = self.count[kept]
        self.begin = np.cumsum(self.count) - self.count
        self.met = np.zeros(len(kept), bool)

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of every piece end to end, and n+1 offsets.

        A piece that is itself a token is that token (the library does the same).
        """
        n = len(words)
        data, off = raw_bytes(words)
        whole = np.fromiter((self.ranks.get(w.encode(), -1) for w in words.to_pylist()), np.int32, n)
        work = np.flatnonzero(whole < 0)
        size = np.diff(off)[work]
        ids_w, ids_t = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
        if len(work):
            byte = data[ragged(off[work], size)]
            begins = np.zeros(len(byte), bool)  # of words
            begins[np.cumsum(size) - size] = True
            begins[1:] |= self.least[(byte[:-1].astype(np.int64) << 8) + byte[1:]] == NEVER
            heads = np.flatnonzero(begins)
            bounds = pa.py_buffer(np.append(heads, len(byte)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, bounds, pa.py_buffer(byte)]).dictionary_encode()
            tokens, begin, count = self.contract(coded.dictionary)
            code = np.asarray(coded.indices)
            ids_w.append(np.repeat(np.repeat(work, size)[heads], count[code]))
            ids_t.append(tokens[ragged(begin[code], count[code])])
        w, t = np.concatenate(ids_w), np.concatenate(ids_t)
        order = np.argsort(w, kind="stable")
        return t[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n))])

    def contract(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of distinct words end to end; of every word where they begin and how many there are."""
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        byte = np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]]
        size = np.diff(off)
        heads = np.cumsum(size) - size
        edge = np.full(len(byte) + 1, NEVER, np.int32)
        edge[1:-1] = self.least[(byte[:-1].astype(np.int64) << 8) + byte[1:]]
        edge[heads] = NEVER
        place = np.int32 if 2 * len(byte) < NEVER else np.int64
        word = np.repeat(np.arange(len(words), dtype=place), size)
        start = pa.table({"k": np.arange(len(byte), dtype=place) + word, "w": word, "tok": self.single[byte], "n": np.ones(len(byte), np.int32), "l": edge[:-1], "r": edge[1:]})
        got = []
        for sql, rows in ((self.encode_sql.replace(KEY, ""), size <= SHORT), (self.encode_sql, size > SHORT)):
            if not rows.any():
                continue
            mine = start if rows.all() else start.filter(pa.array(np.repeat(rows, size)))
            begin, at = np.cumsum(size[rows]) - size[rows], 0
            while at < len(mine):  # whole words, of about ROWS bytes in all
                to = np.searchsorted(begin, at + ROWS)
                to = int(begin[to]) if to < len(begin) else len(mine)
                self.db.register("start", mine.slice(at, to - at))
                got.append(self.db.sql(sql).to_arrow_table())
                self.db.unregister("start")
                at = to
        done = pa.concat_tables(got)
        word, token = done["w"].to_numpy(), done["tok"].to_numpy()
        count = np.bincount(word, minlength=len(words))
        return token[np.argsort(word, kind="stable")], np.cumsum(count) - count, count

    def decode_words(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The bytes of every id sequence (none may be empty)."""
        size = np.diff(off)
        begin = np.repeat(off[:-1], size)
        self.db.register("ids", pa.table({"w": np.repeat(np.arange(len(size)), size), "pos": np.arange(len(ids)) - begin, "tok": ids}))
        out = self.db.sql(DECODE).to_arrow_table()["bytes"].to_pylist()
        self.db.unregister("ids")
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of all texts end to end, their n+1 offsets, and the bytes that each text's ids decode to."""
        pieces = split(texts, space_prefix=True)
        held = self.look_up(pieces.words)
        count = self.count[held][pieces.codes]
        count[pieces.last] = 0
        flat = self.ids[ragged(self.begin[held][pieces.codes], count)]
        cum = np.concatenate([[0], np.cumsum(count)])
        parts = [self.back[i] for i in held.tolist()]
        codes = pieces.codes.tolist()
        decoded = [b"".join([parts[c] for c in codes[p:q]]) for p, q in zip(pieces.first.tolist(), pieces.last.tolist(), strict=True)]
        return flat, np.append(cum[pieces.first], cum[-1]), decoded


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, ranks: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    doc_id, n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit)
    and of the decoded bytes; with ``keep_ids`` also the ids and the bytes.
    Null text counts as empty; null and repeated doc_ids stay, a row each, and
    equal rows give equal rows.  Texts and pieces of any length are encoded
    whole.  An empty table gives no rows; further columns are ignored, whatever
    their names.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids

    def run(batches):
        bpe = load(ranks)
        for table in text_chunks(batches, CHUNK):
            texts = texts_of(table)
            flat, off, decoded = bpe.encode(texts)
            ids_sha, text_sha, kept = [], [], []
            for a, b, raw in zip(off[:-1].tolist(), off[1:].tolist(), decoded, strict=True):
                ids_sha.append(hashlib.sha256(flat[a:b].tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    kept.append((flat[a:b].astype(np.int32), raw))
            cols = [table.column("doc_id").combine_chunks(), pa.array(np.diff(off)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([k[0] for k in kept], pa.list_(pa.int32())), pa.array([k[1] for k in kept], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
