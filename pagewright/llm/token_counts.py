"""Exact token counts at every prefix, by dynamic programming over the prefixes.

For byte-pair encoding the last token of a prefix's encoding is the one suffix
token that is compatible with the last token of what stands before it: the two
encode, joined, to just themselves.  So ``last[j]`` and ``count[j]`` follow from
shorter prefixes, and truncation and budget questions need no second encoding.
Words are independent of each other; counts add up over them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import wordbpe
from pagewright.llm.common import ship, text_chunks, texts_of
from pagewright.llm.wordsplit import raw_bytes, split

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK = 4_000_000
#: Words with more bytes are done one by one.
LONG = 64


class _Lookup:
    """Tokens by (length, hash of bytes): a dict for one, a hash table for many."""

    def __init__(self, tokens: dict[bytes, int]):
        self.exact = tokens
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        sizes: dict[int, list[bytes]] = {}
        for t in tokens:
            sizes.setdefault(len(t), []).append(t)
        for n, group in sizes.items():
            keys = np.array([_hash(t) for t in group], np.uint64)
            bits = max(8, int(np.ceil(np.log2(len(group)))) + 3)
            slot = (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
            by = np.argsort(slot, kind="stable")
            slot = slot[by].astype(np.int64)
            depth = np.arange(len(slot)) - np.searchsorted(slot, slot)
            rows = int(depth.max()) + 1
            table = np.zeros((rows, 1 << bits), np.uint64)
            ids = np.full((rows, 1 << bits), -1, np.int32)
            table[depth, slot] = keys[by]
            ids[depth, slot] = np.array([tokens[group[i]] for i in by], np.int32)
            self.by_length[n] = (table, ids, bits)
        self.longest = max(sizes)

    def find(self, keys: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if n in self.by_length:
            table, ids, bits = self.by_length[n]
            slot = ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
            for r in range(len(table)):
                hit = (table[r][slot] == keys) & (ids[r][slot] >= 0)
                out[hit] = ids[r][slot][hit]
        return out


def _hash(token: bytes) -> int:
    h = 0
    for b in token:
        h = (h * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class PrefixCounter:
    """Prefix token counts for one vocabulary."""

    def __init__(self, path: str):
        self.bpe = wordbpe.load(path)
        self.inner, self.final = _Lookup(self.bpe.inner_tokens), _Lookup(self.bpe.final_tokens)
        # A total order of tokens in which a merge comes after its parts; base symbols come first, the larger id later.
        made = self.bpe.made.astype(np.int64)
        self.order = np.where(made >= 0, made + len(made), np.arange(len(made)))
        self.seen: dict[tuple[int, int], bool] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b, joined, are encoded as just a and b.

        Walks down the right edge of a and the left edge of b in the order in
        which merging would have built them; a pair that merges before either
        side has grown further means that they would not have stayed apart.
        """
        n = len(a)
        out = np.ones(n, bool)
        left, right, live = a.copy(), b.copy(), np.arange(n)
        limit = np.full(n, np.iinfo(np.int64).max)
        bpe, order = self.bpe, self.order
        while len(live):
            at = bpe.pairs.find(left, right)
            rank = np.where(at >= 0, bpe.pairs.rank[at].astype(np.int64) + len(order), np.iinfo(np.int64).max)
            clash = rank < limit
            out[live[clash]] = False
            take_left = order[left] > order[right]
            can_left, can_right = bpe.made[left] >= 0, bpe.made[right] >= 0
            down_left = np.where(take_left, can_left, can_left & ~can_right)
            down_right = ~down_left & can_right
            go = (down_left | down_right) & ~clash
            # Splitting a: pairs across the cut matter if they rank below that merge; splitting b: not above it, ties to the left one.
            new_limit = np.where(down_left, order[left], order[right] + 1)
            left, right = np.where(down_left, bpe.right[left], left), np.where(down_right, bpe.left[right], right)
            live, left, right, limit = live[go], left[go], right[go], new_limit[go]
        return out

    def word_prefixes(self, data: np.ndarray, off: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray]:
        """For every byte position of every word the last token and the token count of the prefix that ends there.

        inner True: as a prefix of a longer word.  The counts of whole words come from :meth:`close`.
        """
        size = np.diff(off)
        at = np.repeat(np.arange(len(size)), size)
        last = np.full(len(data) + 1, -1, np.int32)
        count = np.zeros(len(data) + 1, np.int32)
        heads = self.rolling(data, off)
        for j in range(1, int(size.max(initial=0)) + 1):
            words = np.flatnonzero(size > j) if inner else np.flatnonzero(size >= j)
            self.step(words, off, j, heads, last, count, self.inner)
        return last[: len(at)], count[: len(at)]

    @staticmethod
    def rolling(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the prefixes within each word, at byte positions."""
        size = np.diff(off)
        out = np.zeros(len(data), np.uint64)
        h = np.zeros(len(size), np.uint64)
        for j in range(int(size.max(initial=0))):
            w = np.flatnonzero(size > j)
            h[w] = h[w] * BASE + data[off[w] + j].astype(np.uint64) + np.uint64(1)
            out[off[w] + j] = h[w]
        return out

    def step(self, words, off, j, heads, last, count, tokens: _Lookup, to=None) -> None:
        """Find the last token of the prefixes of length j; written at their last byte, or to ``to`` by word."""
        base = off[words]
        whole = heads[base + j - 1]
        for n in range(min(j, tokens.longest), 0, -1):
            if not len(words):
                return
            if n not in tokens.by_length:
                continue
            before = heads[base + j - n - 1] if n < j else np.zeros(len(words), np.uint64)
            power = np.uint64(pow(int(BASE), n, 1 << 64))
            tok = tokens.find(whole - before * power, n)
            hit = np.flatnonzero(tok >= 0)
            if not len(hit):
                continue
            if n < j:
                prev = last[base[hit] + j - n - 1]
                hit = hit[self.cached(prev, tok[hit])]
                if not len(hit):
                    continue
            n_before = count[base[hit] + j - n - 1] if n < j else np.zeros(len(hit), np.int32)
            if to is None:
                last[base[hit] + j - 1], count[base[hit] + j - 1] = tok[hit], n_before + 1
            else:
                to[words[hit]] = n_before + 1
            keep = np.ones(len(words), bool)
            keep[hit] = False
            words, base, whole = words[keep], base[keep], whole[keep]
        assert not len(words), "every prefix has a last token"

    def cached(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`compatible` on the distinct pairs."""
        key, back = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        return self.compatible((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32))[back]

    def count_words(self, words: pa.StringArray) -> np.ndarray:
        """The token count of each word (white space: 0)."""
        data, off = raw_bytes(words)
        total = np.zeros(len(words), np.int32)
        spaces = np.fromiter((w.isspace() and not any("\x1c" <= c <= "\x1f" for c in w) for w in words.to_pylist()), bool, len(words))
        size = np.diff(off)
        some = np.flatnonzero(~spaces & (size > 0) & (size <= LONG))
        some = some[np.argsort(size[some], kind="stable")]
        sub_off = np.concatenate([[0], np.cumsum(size[some])])
        sub = data[np.concatenate([np.arange(off[i], off[i + 1]) for i in some])] if 0 < len(some) < 64 else self._gather(data, off, some)
        part = np.zeros(len(some), np.int32)
        heads = self.rolling(sub, sub_off)
        last, count = np.full(len(sub), -1, np.int32), np.zeros(len(sub), np.int32)
        sizes = size[some]
        for j in range(1, int(sizes.max(initial=0)) + 1):
            here = np.arange(np.searchsorted(sizes, j), len(sizes))
            ends = here[: np.searchsorted(sizes[here], j, side="right")]
            self.step(ends, sub_off, j, heads, last, count, self.final, part)
            self.step(here[len(ends) :], sub_off, j, heads, last, count, self.inner)
        total[some] = part
        for i in np.flatnonzero(~spaces & (size > LONG)):
            total[i] = self.word(data[off[i] : off[i + 1]].tobytes())[-1]
        return total

    @staticmethod
    def _gather(data, off, some):
        from pagewright.llm.wordsplit import ragged

        return data[ragged(off[:-1][some], np.diff(off)[some])]

    def word(self, raw: bytes) -> list[int]:
        """Token counts of a word cut after each byte (one pass, any length)."""
        last, count, out = [-1], [0], []
        for j in range(1, len(raw) + 1):
            for tokens, keep in ((self.final, False), (self.inner, True)):
                for n in range(min(j, tokens.longest), 0, -1):
                    tok = tokens.exact.get(raw[j - n : j])
                    if tok is not None and (n == j or self._pair(last[j - n], tok)):
                        if keep:
                            last.append(tok)
                            count.append(count[j - n] + 1)
                        else:
                            out.append(count[j - n] + 1)
                        break
        return out

    def _pair(self, a: int, b: int) -> bool:
        if (got := self.seen.get((a, b))) is None:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            got = self.seen[a, b] = bool(self.compatible(np.array([a], np.int32), np.array([b], np.int32))[0])
        return got

    def totals(self, texts: list[str]) -> np.ndarray:
        """The token count of every whole text."""
        pieces, owner, special = self.bpe.split(texts)
        per = self.count_words(pieces.words)[pieces.codes].astype(np.int64)
        per[pieces.last] = 0
        cum = np.concatenate([[0], np.cumsum(per)])
        sizes = np.where(special >= 0, 1, cum[pieces.last] - cum[pieces.first])
        return np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of every prefix of a normalised text without special strings; entry i is for its first i characters."""
        out, before, cut_at = [0], 0, 0
        pieces = split([text], space_prefix=False)
        for code in pieces.codes[pieces.first[0] : pieces.last[0]]:
            word = pieces.words[int(code)].as_py()
            cut_at += len(word)
            if word.isspace() and not any("\x1c" <= c <= "\x1f" for c in word):
                out += [before] * len(word)
                continue
            raw, ends = word.encode(), np.cumsum([len(c.encode()) for c in word])
            counts = self.word(raw)
            here = [before + counts[e - 1] for e in ends]
            if len(word) == 3 and word in ("'re", "'ve", "'ll"):  # cut after two characters it is no contraction yet
                here[1] = before + self.word(b"'")[-1] + self.word(word[1].encode())[-1]
            out += here
            before = here[-1]
        return out

    def truncate(self, text: str, budget: int) -> int:
        """The most characters of a normalised text that take at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, c in enumerate(counts) if c <= budget)


@lru_cache(2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null text counts as empty (no token); null and repeated doc_ids stay, a row
    each, and equal rows give equal rows.  Texts of any length are counted whole.
    An empty table gives no rows; further columns are ignored, whatever their
    names.
    """
    ship(docs.sparkSession)

    def run(batches):
        counter = load(tokenizer)
        for table in text_chunks(batches, CHUNK):
            texts = texts_of(table)
            n = counter.totals(texts)
            sizes = pc.fill_null(pc.binary_length(table.column("text")), 0)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), sizes.combine_chunks().cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
