"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word is cut
greedily into known character n-grams, longest first, each scoring at a discount
for every step back.  A text's score is the sum over its words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import save, ship, skew_join, text_chunks, texts_of
from pagewright.llm.wordsplit import LETTER, classes, split

CHUNK = 2_000_000
#: Log probability lost with each step to a shorter n-gram.
BACKOFF = math.log(0.4)


class Model(NamedTuple):
    """Log frequencies by language: of words, of n-grams (words padded with a blank), and of nothing known."""

    langs: list[str]
    words: dict[str, np.ndarray] | Rows
    grams: dict[str, np.ndarray] | Rows
    longest: int
    floor: float


class Rows:
    """Arrays by string, as one matrix and each string's row in it: a third of the memory of an array for each string."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.at = {s: i for i, s in enumerate(table)}
        self.values = np.stack(list(table.values())) if table else np.zeros((0, 0), np.float32)

    def get(self, key: str) -> np.ndarray | None:
        at = self.at.get(key)
        return None if at is None else self.values[at]


def packed(model: Model) -> Model:
    """The model as workers hold it."""
    return model._replace(words=Rows(model.words), grams=Rows(model.grams))


def sample(labelled: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each lang, picked by a hash of doc_id; all if there are fewer."""
    rate, _ = save(labelled.groupBy("lang").agg((F.lit(per_lang) / F.count(F.lit(1))).alias("rate"), F.count(F.lit(1)).alias("n")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Rows beyond every language's rate go before the join, by the largest one.
    most = rate.agg(F.max("rate")).first()[0] or 0.0
    return skew_join(labelled.where(draw < most), rate, ["lang"], "n").where(draw < F.col("rate")).drop("rate")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): lower-cased runs of letters, counted in batches and then over all."""
    ship(docs.sparkSession)

    def run(batches):
        for table in text_chunks(batches, CHUNK):
            total: Counter = Counter()
            langs = table.column("lang").to_pylist()
            texts = [t.lower() for t in texts_of(table)]
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                got = split(own, space_prefix=False)
                n = np.bincount(got.codes, minlength=len(got.words))
                for word, k in zip(got.words.to_pylist(), n.tolist(), strict=True):
                    if classes()[ord(word[0])] == LETTER:
                        total[lang, word] += k
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = docs.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, per_lang: int = 1500, vocabulary: int = 20_000, n_grams: int = 20_000, longest: int = 5) -> Model:
    """Learn from rows with text and lang, at most about ``per_lang`` of each language.

    per_lang bounds the rows that are learned from.  vocabulary, n_grams: the
    most frequent words, and n-grams of these words, that the model keeps for
    each language (ties by spelling), which bounds it whatever the texts.  Every
    language with a word in its sample is learned, also where no word repeats.
    Null or empty texts teach nothing; without any labelled row the model has no
    language.
    """
    usable = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = word_counts(sample(usable, per_lang))
    top: dict[str, list[tuple[str, int]]] = defaultdict(list)
    # At most ``vocabulary`` words a language come to the driver.  A word met once says little, unless there are no others.
    by_lang = Window.partitionBy("lang")
    own = counts.withColumns({"place": F.row_number().over(by_lang.orderBy(F.desc("n"), "word")), "most": F.max("n").over(by_lang)})
    for r in own.where((F.col("place") <= vocabulary) & ((F.col("n") > 1) | (F.col("most") == 1))).toLocalIterator():
        top[r["lang"]].append((r["word"], r["n"]))
    langs = sorted(top)
    words, grams = [], []
    for lang in langs:
        own = sorted(top[lang], key=lambda x: (-x[1], x[0]))
        words.append(dict(own[:vocabulary]))
        g: Counter = Counter()
        for word, n in own:
            padded = f" {word} "
            for k in range(1, longest + 1):
                for i in range(len(padded) - k + 1):
                    g[padded[i : i + k]] += n
        by_size: dict[int, list] = defaultdict(list)
        for s, n in sorted(g.items(), key=lambda x: (-x[1], x[0])):
            if len(by_size[len(s)]) < n_grams // longest:
                by_size[len(s)].append((s, n))
        grams.append({s: n for some in by_size.values() for s, n in some})

    def logs(tables: list[dict[str, int]], of=lambda s: 0) -> dict[str, np.ndarray]:
        total: list[Counter] = []
        for t in tables:
            c: Counter = Counter()
            for s, n in t.items():
                c[of(s)] += n
            total.append(c)
        keys = sorted(set().union(*tables)) if tables else []
        return {s: np.array([math.log((t.get(s, 0) + 0.5) / (c[of(s)] + 1)) for t, c in zip(tables, total, strict=True)], np.float32) for s in keys}

    return Model(langs, logs(words), logs(grams, len), longest, math.log(1e-7))


class Scorer:
    """Scores words by a model; remembers a bounded number of unseen words."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def word(self, word: str) -> np.ndarray:
        m = self.model
        if (known := m.words.get(word)) is not None:
            return known
        if (old := self.seen.get(word)) is not None:
            return old
        padded, total, at = f" {word} ", np.zeros(len(m.langs), np.float32), 0
        while at < len(padded):
            for k in range(min(m.longest, len(padded) - at), 0, -1):
                if (g := m.grams.get(padded[at : at + k])) is not None:
                    total = total + g + (m.longest - k + 1) * BACKOFF
                    at += k
                    break
            else:
                total, at = total + m.floor, at + 1
        if len(self.seen) > 60_000:
            self.seen.clear()
        self.seen[word] = total
        return total

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and its share of the posterior for each text."""
        m = self.model
        got = split([t.lower() for t in texts], space_prefix=False)
        table = np.zeros((len(got.words), max(1, len(m.langs))), np.float64)
        letter = np.zeros(len(got.words), np.int64)
        for i, w in enumerate(got.words.to_pylist()):
            if classes()[ord(w[0])] == LETTER:
                letter[i] = 1
                if m.langs:
                    table[i] = self.word(w)

        def by_text(values: np.ndarray) -> np.ndarray:
            per = values[got.codes]
            per[got.last] = 0  # what stands between texts
            cum = np.concatenate([[0], np.cumsum(per)])
            return cum[got.last] - cum[got.first]

        words = by_text(letter)
        sums = np.stack([by_text(column) for column in table.T], 1)  # a language at a time, to save memory
        best = sums.argmax(1)  # ties: the first in order of name
        share = 1 / np.exp(np.clip(sums - sums.max(1, keepdims=True), -700, 0)).sum(1)
        known = (words > 0) & bool(m.langs)
        return [m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def predict(docs: DataFrame, model: Model, keep: list[Column] = ()) -> DataFrame:
    """lang_pred and score (the language's share of the posterior) of every whole text.

    ``und`` with score 0 where the text is null, empty or without a letter, or
    the model has no language; ties go to the first language by name.  Texts of
    any length are read whole.  keep: the columns to carry, by default doc_id; a
    column with the name of a result gives way to it.  Rows that repeat stay, an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(packed(model))
    keep = [c for c in keep or [F.col("doc_id")] if docs.select(c).columns[0] not in ("lang_pred", "score")]
    given = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = given.select("row").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        scorer = Scorer(sent.value)
        for table in text_chunks(batches, CHUNK):
            langs, scores = scorer.texts(texts_of(table))
            yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return given.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def held_out() -> Column:
    """Rows never learned from: crc32 of doc_id as text is divisible by 5 (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
