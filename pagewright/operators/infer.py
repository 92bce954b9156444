"""Calls to a model server, one row a request, with an injected client.

A client is any callable ``(prompt, images, options) -> str``.  It is made once
in each partition by a factory, so it may hold connections; requests of a
partition run in a small thread pool because they wait, not compute.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import answers as A
from pagewright.functions import ocr as O
from pagewright.functions.text import strip

Client = Callable[[str, list[bytes], dict], str]


def ask(requests: DataFrame, make_client: Callable[[], Client], options: dict | None = None, threads: int = 8, batch: int = 64) -> DataFrame:
    """Rows (prompt string, images array<binary>, ...) with output, status and error.

    status is success, connection_error or error; a failed request keeps its row.
    """
    options = dict(options or {})
    names = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def one(prompt, images):
            try:
                return client(prompt, [bytes(i) for i in images] if images is not None else [], options), "success", None
            except (ConnectionError, TimeoutError) as e:
                return None, "connection_error", str(e)
            except Exception as e:  # the server's answer, whatever it is, belongs to this row
                return None, "error", f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                for i in range(0, len(pdf), batch):
                    part = pdf.iloc[i : i + batch].copy()
                    got = list(pool.map(one, part["prompt"], part["images"]))
                    for k, name in enumerate(("output", "status", "error")):
                        part[name] = [g[k] for g in got]
                    yield part[[*names, "output", "status", "error"]]

    schema = requests.schema
    from pyspark.sql.types import StructType

    out = StructType([*schema.fields]).add("output", "string").add("status", "string").add("error", "string")
    return requests.mapInPandas(run, out)


def choice_results(instances: DataFrame, make_client, template: str | None = None, text_only: bool = False, options: dict | None = None) -> DataFrame:
    """Q1: instances (with images unless text only) to multiple-choice results."""
    choices = A.choice_map(*[F.col(f"choice_{c}") for c in "ABCD"])
    prompt = A.choice_prompt(F.col("question"), choices, template)
    if text_only:
        prompt = A.with_context(prompt, F.col("context"))
    images = F.array().cast("array<binary>") if text_only else F.col("images")
    asked = ask(instances.select("_id", "question", choices.alias("choices"), "answer", prompt.alias("prompt"), images.alias("images")), make_client, options)
    said = A.after_thinking(F.col("output"))
    ok = F.col("status") == "success"
    return asked.select(
        F.col("_id").alias("instance_id"),
        "question",
        "choices",
        F.col("answer").alias("ground_truth"),
        "prompt",
        F.when(ok, said).alias("model_output"),
        F.when(ok, A.answer_letter(said)).alias("extracted_answer"),
        F.when(ok, A.choice_correct(said, F.col("answer"))).otherwise(False).alias("correct"),
        F.size("images").alias("num_images"),
        "status",
        "error",
    )


def needle_results(questions: DataFrame, make_client, template: str | None = None, options: dict | None = None) -> DataFrame:
    """Q2: question rows (joins.question_rows) with images to needle results."""
    asked = ask(questions.select("_id", "question_idx", "question", "answer", A.question_prompt(F.col("question"), template).alias("prompt"), "images"), make_client, options)
    ok = F.col("status") == "success"
    return asked.select(
        F.col("_id").alias("instance_id"),
        "question_idx",
        "question",
        F.col("answer").alias("ground_truth"),
        "prompt",
        F.col("output").alias("model_output"),
        F.when(ok, A.contains_answer(F.col("output"), F.col("answer"))).otherwise(False).alias("correct"),
        F.size("images").alias("num_images"),
        "status",
        "error",
    )


def page_texts(pages: DataFrame, make_client, prompt: str, model: str, options: dict | None = None) -> DataFrame:
    """Q3 to Q6: page images (split, page_id, content) to cleaned page texts."""
    asked = ask(pages.select("split", "page_id", F.lit(prompt).alias("prompt"), F.array("content").alias("images")), make_client, {"model": model, **(options or {})})
    return asked.select("split", "page_id", O.clean_for_model(F.col("output"), F.lit(model)).alias("text"), "status", "error")


def first_option(*values: Column | float | None) -> Column:
    """Q9: the first setting given, else 0."""
    return F.coalesce(*[v if isinstance(v, Column) else F.lit(v) for v in values], F.lit(0.0))


def word_items(results: DataFrame) -> DataFrame:
    """P1 by word: nested words and boxes flattened, blank ones dropped, confidence 1."""
    pairs = F.flatten(F.zip_with("word_texts", "word_boxes", lambda t, b: F.zip_with(t, b, lambda x, y: F.struct(x.alias("t"), y.alias("p")))))
    return _items(results.withColumn("__i", pairs), "word", F.lit(1.0))


def block_items(results: DataFrame) -> DataFrame:
    """P1 by block: blank texts dropped, confidences kept."""
    pairs = F.arrays_zip(F.col("rec_texts").alias("t"), F.col("rec_polys").alias("p"), F.col("rec_scores").alias("c"))
    n = F.least(F.size("rec_texts"), F.size("rec_polys"), F.size("rec_scores"))
    return _items(results.withColumn("__i", F.slice(pairs, 1, F.greatest(n, F.lit(0)))), "block", None)


def _items(df: DataFrame, level: str, confidence: Column | None) -> DataFrame:
    kept = df.withColumn("__i", F.filter("__i", lambda x: strip(x["t"]) != ""))
    conf = F.transform("__i", lambda x: confidence if confidence is not None else x["c"].cast("double"))
    return kept.select(
        "image_path",
        F.element_at(F.split("image_path", "/"), -1).alias("image_name"),
        F.lit(level).alias("extraction_level"),
        F.size("__i").alias("item_count"),
        F.transform("__i", lambda x: x["p"]).alias("polys"),
        F.transform("__i", lambda x: strip(x["t"])).alias("texts"),
        conf.alias("confidences"),
    )


def polygon_of_text(c: Column) -> Column:
    """The first four points of a printed array; null with fewer than eight numbers."""
    n = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.size(n) >= 8, F.array(*[F.array(F.get(n, F.lit(i)), F.get(n, F.lit(i + 1))) for i in (0, 2, 4, 6)]))


def item_rows(items: DataFrame) -> DataFrame:
    """A row for each text."""
    return items.select("image_path", "image_name", F.inline(F.arrays_zip(F.col("texts").alias("text"), F.col("confidences").alias("confidence"), F.col("polys").alias("poly"))))


def item_totals(items: DataFrame) -> DataFrame:
    """Images, items and items an image."""
    return items.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("items"), F.avg("item_count").alias("items_per_image"))
