"""Cleaning of recognition output."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions.answers import after_thinking
from pagewright.functions.text import strip

#: A reference with its detection, as grounding models write them.
GROUNDING = r"(?s)<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>"


@F.pandas_udf(StringType())
def clean_formulas(c: pd.Series) -> pd.Series:
    """L1: in display formulas on one line, without quad labels in parentheses, stripped."""

    def one(m: re.Match) -> str:
        return "\\[" + re.sub(r"\\quad\s*\([^)]*\)", "", m[1]).strip() + "\\]"

    return c.map(lambda x: re.sub(r"\\\[(.*?)\\\]", one, x), na_action="ignore")


def groundings(c: Column) -> Column:
    """L2: all reference and detection pairs, as (ref, det)."""
    whole = F.regexp_extract_all(c, F.lit(GROUNDING), F.lit(0))
    part = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, part, 1).alias("ref"), F.regexp_extract(x, part, 2).alias("det")))


def clean_output(c: Column, formulas: bool = True) -> Column:
    """L3: without groundings and centre tags; four line breaks, then three, as two; stripped."""
    c = F.regexp_replace(clean_formulas(c) if formulas else c, GROUNDING, "")
    for old, new in (("\n\n\n\n", "\n\n"), ("\n\n\n", "\n\n"), ("<center>", ""), ("</center>", "")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return strip(c)


def clean_for_model(c: Column, model: Column) -> Column:
    """L4: by the model's name."""
    name = F.lower(model)
    grounded = F.contains(name, F.lit("deepseek")) & F.contains(name, F.lit("ocr"))
    return F.when(grounded, clean_output(c)).when(F.contains(name, F.lit("glyph")), after_thinking(c, always_strip=True)).otherwise(c)


def join_blocks(blocks: Column) -> Column:
    """Blocks by line."""
    return F.array_join(blocks, "\n")
