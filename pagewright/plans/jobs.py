"""Whole jobs from files to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import joins, layout_stats, needles, scoring, select, slices
from pagewright.sources import records, sinks


def evaluate(spark: SparkSession, truth_path: str, prediction_folder: str, out: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score a folder of predictions: per-page scores, their summary, and pages that one side lacks."""
    gt, pred = records.ground_truth(spark, truth_path), records.predictions(spark, prediction_folder)
    pages, summary = scoring.evaluate(pred, gt)
    lacking = joins.missing(gt, pred, ["page_id"]).withColumn("lacks", F.lit("prediction")).union(joins.missing(pred, gt, ["page_id"]).withColumn("lacks", F.lit("truth")))
    if out:
        sinks.evaluation(pages, summary, out)
    return pages, summary, lacking


def evaluate_splits(pred: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score all splits in one job, each against its own ground truth (both with split, page_id, text)."""
    keyed = pred.withColumn("truth", joins.truth_split(F.col("split")))
    both = keyed.select("split", "truth", "page_id", F.col("text").alias("pred")).join(gt.select(F.col("split").alias("truth"), "page_id", F.col("text").alias("gt")), ["truth", "page_id"])
    pages = scoring.score_pairs(both, ["split", "page_id"])
    return pages, scoring.summary(pages, by=["split"])


def exclusion_list(instances: DataFrame, percent: float = 25.0, domain: str | None = None, tokens=None) -> DataFrame:
    """The final list, with the longest texts and a domain if asked for."""
    out = select.final_exclusions(instances, tokens if tokens is not None else T.token_estimate(F.col("context")))
    text = select.first_text(*[F.col(c) if c in instances.columns else F.lit(None).cast("string") for c in ("text", "context", "question")])
    out = out.union(select.longest_texts(instances, "_id", text, percent))
    if domain:
        out = out.union(select.domain_or_longest(instances, "_id", text, domain))
    return out.distinct()


def needle_set(instances: DataFrame, exclude: DataFrame | None = None, limit: int | None = None, multiplier: int = 1, num_secrets: int = 5, seed: int = 0) -> DataFrame:
    """Needle instances of what is not on the list."""
    rows = select.excluded(instances, exclude, "_id") if exclude is not None else instances
    return needles.generate(select.first_rows(rows, limit, "_id"), multiplier, num_secrets, seed)


def choice_report(results: DataFrame, instances: DataFrame, tokens=None, seq: str | None = None) -> dict[str, DataFrame]:
    """Totals, accuracy by context length, and by difficulty and length.

    Of instances that repeat an id the last by ``seq`` counts; without it the ids must differ.
    """
    own = joins.last_of_key(instances, ["_id"], seq) if seq else instances
    known = joins.with_instances(results, own, ["difficulty", "length", "context"])
    count = tokens(F.col("context")) if tokens else T.token_estimate(F.col("context"))
    binned = known.withColumn("context_bin", T.token_bin(count))
    return {
        "overall": slices.overall(results),
        "context": slices.by_axis(binned, "context_bin"),
        "levels": slices.by_difficulty_and_length(select.known_levels(known)),
    }


def needle_report(results: DataFrame, instances: DataFrame, tokens=None) -> dict[str, DataFrame]:
    """Totals, accuracy by instance, and by context length and depth."""
    known = joins.with_instances(results, instances, ["context", "secrets", "question_depths"])
    count = tokens(F.col("context")) if tokens else T.token_estimate(F.col("context"))
    depth = needles.question_depth(F.col("question_depths"), F.col("question_idx"), F.col("question"), F.col("secrets"), F.col("context"))
    return {
        "overall": slices.overall(results),
        "instances": slices.by_instance(results),
        "grid": slices.by_context_and_depth(known.withColumns({"context_bin": T.token_bin(count), "depth": depth})),
    }


def layout_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Totals, text lengths and the samples with most boxes."""
    return {"totals": layout_stats.totals(lines), "lengths": layout_stats.text_lengths(lines), "most": layout_stats.most_boxes(lines)}


def render_plan(instances: DataFrame, done: DataFrame | None = None, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """D12's choice of what to render: the first rows, without those on the list and those that have output."""
    rows = select.with_id(select.unique_ids(select.first_rows(instances, limit, "_id")), "unique_id")
    if exclude is not None:
        rows = select.excluded(rows, exclude, "unique_id")
    return select.remaining(rows, done, "unique_id") if done is not None else rows


def render(instances: DataFrame, make_renderer, settings: dict) -> DataFrame:
    """Lay out and draw each text with an injected renderer, made once a partition.

    The renderer is a callable ``(unique_id, paragraphs, settings)`` that returns
    a list of (png bytes, boxes) by page; PDF and font libraries are its matter.
    Rows that fail keep their error.
    """
    import pandas as pd

    from pagewright.functions.layout import batches, pre_clean

    text = batches(pre_clean(F.col("context"), bool(settings.get("remove-line-breaks"))), markup=settings.get("newline-markup", "<br/>"))
    box = "struct<x0:int,y0:int,x1:int,y1:int,text:string>"

    def run(frames):
        draw = make_renderer()
        for pdf in frames:
            rows = []
            for uid, parts in zip(pdf["unique_id"], pdf["parts"], strict=True):
                try:
                    rows += [(uid, f"{uid}_page_{n:03d}.png", png, [dict(zip(("x0", "y0", "x1", "y1", "text"), b, strict=True)) for b in boxes], None) for n, (png, boxes) in enumerate(draw(uid, list(parts), settings), 1)]
                except Exception as e:  # one text that cannot be drawn must not end the job
                    rows.append((uid, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["unique_id", "name", "content", "boxes", "error"])

    return instances.select("unique_id", text.alias("parts")).mapInPandas(run, f"unique_id string, name string, content binary, boxes array<{box}>, error string")


def line_rows(pages: DataFrame) -> DataFrame:
    """K3's rows from rendered pages: names and boxes by page in order."""
    n = F.sort_array(F.collect_list(F.struct("name", "boxes")))
    return pages.where("error is null").groupBy("unique_id").agg(n.alias("p")).select("unique_id", F.transform("p", lambda x: x["name"]).alias("image_paths"), F.transform("p", lambda x: x["boxes"]).alias("bboxes"))
