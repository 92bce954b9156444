"""Byte-pair encoding with word ends, over the distinct words of many texts at once.

Reads a ``tokenizers`` BPE file whose normaliser is NFC, white space, lower case
and whose model marks word ends; gives the ids that library gives without added
special tokens.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pagewright.llm.wordsplit import Pieces, ragged, raw_bytes, split

NONE = np.int32(2**31 - 1)
#: Words with more symbols go through a heap instead of the vectorised rounds.
LONG = 48


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class PairTable:
    """Vectorised look-up of (left, right) -> (rank, merged)."""

    def __init__(self, left, right, rank, merged):
        keys = np.asarray(left, np.int64) << 20 | np.asarray(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], np.asarray(rank, np.int32)[order], np.asarray(merged, np.int32)[order]
        bits = 19
        while True:  # a hash table in which one probe of a short bucket list is enough
            slot = self._slot(self.keys, bits)
            if np.bincount(slot).max() <= 4 or bits == 23:
                break
            bits += 1
        self.bits = bits
        by = np.argsort(slot, kind="stable")
        slot = slot[by]
        depth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.table = np.full((int(depth.max()) + 1, 1 << bits), -1, np.int32)
        self.table[depth, slot] = by

    @staticmethod
    def _slot(keys, bits):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair, -1 if there is none."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        slot, out = self._slot(keys, self.bits), np.full(len(keys), -1, np.int32)
        for row in self.table:
            at = row[slot]
            hit = (at >= 0) & (self.keys[at] == keys)
            out[hit] = at[hit]
        return out


class WordBPE:
    """A vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.end = end
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        merged = [vocab[a + b] for a, b in pairs]
        self.pairs = PairTable(left, right, range(len(pairs)), merged)
        self.rank_of = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left, right, merged, strict=True))}
        n = max(vocab.values()) + 1
        #: How each token is made: its rank (base symbols -1) and its two parts (base symbols: themselves).
        self.made = np.full(n, -1, np.int32)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        self.made[merged], self.left[merged], self.right[merged] = np.arange(len(pairs)), left, right
        back = {c: b for b, c in enumerate(chars)}
        self.inner_tokens = {bytes(back[c] for c in t): i for t, i in vocab.items() if not t.endswith(end) and all(c in back for c in t)}
        self.final_tokens = {bytes(back[c] for c in t[: -len(end)]): i for t, i in vocab.items() if t.endswith(end) and t != end and all(c in back for c in t[: -len(end)])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
        for name in self.special:
            self.inner_tokens = {k: v for k, v in self.inner_tokens.items() if v != self.special[name]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def normalise(self, text: str) -> str:
        """NFC and lower case, character by character (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def split(self, texts: list[str]) -> tuple[Pieces, np.ndarray, np.ndarray]:
        """Pieces of the normalised texts; per piece range its text, and the ids of special strings (else -1).

        A special string inside a text is one token, as the library has it by default.
        """
        parts, owner, ids = [], [], []
        for i, text in enumerate(texts):
            cut = self.special_re.split(text) if self.special_re and "<|" in text else [text]
            for part in cut:
                ids.append(self.special.get(part, -1) if len(cut) > 1 else -1)
                parts.append("" if ids[-1] >= 0 else self.normalise(part))
                owner.append(i)
        return split(parts, space_prefix=False), np.array(owner, np.int64), np.array(ids, np.int32)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One long word, by a heap over a linked list."""
        n = len(symbols)
        sym, nxt, prv, heap = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)], []
        for i in range(n - 1):
            if (r := self.rank_of.get((sym[i], sym[i + 1]))) is not None:
                heap.append((r[0], i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = self.rank_of[a, b][1], -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] >= 0 and (r := self.rank_of.get((sym[k], sym[nxt[k]]))) is not None:
                    heapq.heappush(heap, (r[0], k, sym[k], sym[nxt[k]]))
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = nxt[i]
        return out

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word end to end, and n+1 offsets. Words of white space have none."""
        data, off = raw_bytes(words)
        n = len(words)
        size = np.diff(off)
        blank = np.zeros(n, bool)
        if n:
            kinds = words.to_pylist()
            blank = np.fromiter((w.isspace() for w in kinds), bool, n)
            # White space by Unicode's property only; Python's isspace also takes U+001C to U+001F.
            ctrl = [i for i in np.flatnonzero(blank) if any("\x1c" <= c <= "\x1f" for c in kinds[i])]
            blank[ctrl] = False
        counts = np.zeros(n, np.int64)
        done_w, done_s = [], []
        work = np.flatnonzero(~blank & (size <= LONG) & (size > 0))
        sym = self.inner[data[ragged(off[work], size[work])]] if len(work) else np.zeros(0, np.int32)
        last = np.cumsum(size[work]) - 1
        if len(work):
            sym[last] = self.final[data[off[work] + size[work] - 1]]
        word = np.repeat(work, size[work])
        at = np.full(len(sym), -1, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
        at[inside] = self.pairs.find(sym[inside], sym[inside + 1])
        rank = np.where(at >= 0, self.pairs.rank[at], NONE)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            spread = np.repeat(best, np.diff(np.append(first, len(sym))))
            idle = spread == NONE
            if idle.any():
                done_w.append(word[idle])
                done_s.append(sym[idle])
                keep = ~idle
                sym, word, rank, at, spread = sym[keep], word[keep], rank[keep], at[keep], spread[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == spread)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
            sym[hit] = self.pairs.merged[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep) - 1
            spot = new[hit]
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            touched = np.concatenate([spot, spot[spot > 0] - 1])
            ok = touched[(touched + 1 < len(sym)) & (word[touched] == word[np.minimum(touched + 1, len(sym) - 1)])]
            rank[touched], at[touched] = NONE, -1
            at[ok] = self.pairs.find(sym[ok], sym[ok + 1])
            rank[ok] = np.where(at[ok] >= 0, self.pairs.rank[at[ok]], NONE)
        for i in np.flatnonzero(~blank & (size > LONG)):
            raw = data[off[i] : off[i + 1]]
            ids = self.merge_long([*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])])
            done_w.append(np.full(len(ids), i, np.int64))
            done_s.append(np.array(ids, np.int32))
        if not done_w:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        all_w, all_s = np.concatenate(done_w), np.concatenate(done_s)
        order = np.argsort(all_w, kind="stable")
        counts = np.bincount(all_w, minlength=n)
        return all_s[order], np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n+1 offsets."""
        pieces, owner, special = self.split(texts)
        ids, off = self.encode_words(pieces.words)
        per = np.diff(off)
        count = per[pieces.codes]
        count[pieces.last] = 0  # what stands between texts
        flat = ids[ragged(off[:-1][pieces.codes], count)]
        cum = np.concatenate([[0], np.cumsum(count)])
        begin = cum[pieces.first]
        if (special >= 0).any():
            spots = np.flatnonzero(special >= 0)
            flat = np.insert(flat, begin[spots], special[spots])
            sizes = cum[pieces.last] - begin
            sizes[spots] = 1
            ends = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
            return flat, np.concatenate([[0], np.cumsum(ends)])
        sizes = cum[pieces.last] - begin
        return flat, np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(4)
def load(path: str) -> WordBPE:
    return WordBPE(path)
