"""Scoring predicted pages and summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import metrics
from pagewright.functions import text as T
from pagewright.operators.joins import matched
from pagewright.operators.partitioning import spread


def score_pairs(pairs: DataFrame, keys: list[str], normalise: bool = True, with_bleu: bool = True) -> DataFrame:
    """C3 on rows with pred and gt.

    Both sides are normalised once.  Edit distance is quadratic in length, so
    the rows of a few files are dealt evenly before it.
    """
    side = lambda c: F.coalesce(T.normalise(F.col(c)) if normalise else F.col(c), F.lit("")).alias(c)
    ready = pairs.select(*keys, side("pred"), side("gt"))
    ready = spread(ready)
    cols = [metrics.cer(F.col("pred"), F.col("gt"), False).alias("cer")]
    if with_bleu:
        cols.append(metrics.bleu(F.col("pred"), F.col("gt"), False).alias("bleu"))
    return ready.select(*keys, *cols)


def score_pages(pred: DataFrame, gt: DataFrame, keys: list[str] = ("page_id",), normalise: bool = True, with_bleu: bool = True) -> DataFrame:
    """C3 over R1: a row for each page on both sides."""
    return score_pairs(matched(pred, gt, list(keys)), list(keys), normalise, with_bleu)


def summary(scores: DataFrame, columns: list[str] = ("cer", "bleu"), by: list[str | Column] = ()) -> DataFrame:
    """A1: mean, population deviation, least, most and count of each metric, by groups."""
    out = []
    for c in columns:
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("count", F.count)):
            out.append(f(c).alias(f"{c}_{name}"))
    return scores.groupBy(*by).agg(*out) if by else scores.agg(*out)


def evaluate(pred: DataFrame, gt: DataFrame, by: list[str] = (), normalise: bool = True, with_bleu: bool = True) -> tuple[DataFrame, DataFrame]:
    """A2: per-page scores and their summary; all splits in one job when ``by`` names the split."""
    pages = score_pages(pred, gt, [*by, "page_id"], normalise, with_bleu)
    return pages, summary(pages, ["cer", "bleu"] if with_bleu else ["cer"], by=list(by))
