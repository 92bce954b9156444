"""The corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next.  All but the last return the columns of
``documents``; n_chars follows the text.

Further columns are ignored, whatever their names; nulls in lang, source and
n_chars change nothing.  Texts of any length are read whole.  An empty table
gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import langid, line_dedup, near_dedup, packing, repeats
from pagewright.llm.common import drop, read, save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document's language must have this share of the posterior.
LEAST_SHARE = 0.5
#: Lines of a gram and grams of a window: runs of three lines or more are found.
GRAM, WINDOW = 2, 2
#: Words of a shingle and per cent of similarity.
SHINGLE, PERCENT = 5, 80
#: Bytes of a repeated passage; fifty words of these languages are longer.
REPEAT_BYTES = 200
CONTEXT = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is not clear.

    Null and empty texts have no letter.  A tie of two languages is half of the
    posterior each and stays, rows that repeat stay, and where no document has a
    language there is none to be clear, so all go.
    """
    docs = docs.select(*COLUMNS)
    got = langid.predict(docs, langid.fit(docs), [F.col(c) for c in COLUMNS])
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of lines; a document of which nothing stays goes.

    Rows that repeat a doc_id and text are one document and stay as they are, a
    null doc_id comes after all others, and null or empty texts pass.
    """
    got = line_dedup.drop_repeated_lines(docs.select(*COLUMNS), GRAM, WINDOW)
    stays = (F.col("n_removed") == 0) | (F.trim("kept_text") != "")
    return got.where(stays).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows that repeat a doc_id and text count once, a null doc_id comes last, and
    texts without words have no duplicates and pass.
    """
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS), SHINGLE, PERCENT)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur more than once out of all texts; a document of which nothing stays goes.

    Every occurrence goes, so there are no ties; rows that repeat lose what they
    share.  Null texts become empty, and these pass.
    """
    got = repeats.cut_repeats(docs.select(*COLUMNS), REPEAT_BYTES, ("doc_id", "text", "lang", "source"))
    stays = (F.col("n_removed") == 0) | (F.trim("kept_text") != "")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return got.where(stays).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece.

    Null and empty texts are the end id alone; rows that repeat are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CONTEXT)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Several stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, used = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, at = save(stage(spark, docs, sf_dir))
        if used:
            drop(spark, used)
        used = at
    return STAGES[-1][1](spark, docs, sf_dir)
