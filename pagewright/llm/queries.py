"""The registered queries of the operators, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import ann, byte_bpe, exact_dedup, html_extract, langid, line_dedup, near_dedup, packing, repeats, token_counts
from pagewright.llm.common import read

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
CONTEXT = 2048


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), CONTEXT)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     r AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS k
           FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, model, [F.col("doc_id"), langid.held_out().alias("held_out")])
    return got.select("doc_id", "held_out", "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), CONTEXT)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(read(spark, sf_dir, "documents"), 400).withColumnRenamed("kept_text", "text")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_exact_dedup, op3_language_id, op4_html_extraction, op5_near_dedup, op6_nearest_neighbours, op7_token_counts, op8_line_dedup, op9_suffix_dedup, op10_byte_bpe)
}
ORACLE: dict[str, str] = {"op2_exact_dedup": OP2_SQL}
