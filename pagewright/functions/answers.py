"""Prompts, and reading and checking answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import strip

END_OF_THOUGHT = "</think>"


def after_thinking(c: Column, always_strip: bool = False) -> Column:
    """What follows the first end-of-thought tag, stripped; without a tag as it is (X2: stripped)."""
    at = F.instr(c, END_OF_THOUGHT)
    rest = strip(F.substring(c, at + len(END_OF_THOUGHT), F.length(c)))
    return F.when(at > 0, rest).otherwise(strip(c) if always_strip else c)


def answer_letter(c: Column) -> Column:
    """The first of A to D that stands alone, in parentheses, after a key word, or at the start; else empty."""
    said = F.upper(strip(c))
    found = [
        F.nullif(F.regexp_extract(said, p, 1), F.lit(""))
        for p in (r"(?U)\b([A-D])\b", r"[(\uFF08]([A-D])[)\uFF09]", r"(?:ANSWER|CHOICE|OPTION)[:\s]*([A-D])", r"^([A-D])")
    ]
    return F.coalesce(*found, F.lit(""))


def choice_correct(output: Column, truth: Column) -> Column:
    """The letter read equals the truth in upper case (an empty truth is met by no letter)."""
    return answer_letter(output) == F.upper(truth)


def contains_answer(output: Column, truth: Column, case_sensitive: bool = False) -> Column:
    """The truth occurs anywhere in the output."""
    return F.contains(output, truth) if case_sensitive else F.contains(F.lower(output), F.lower(truth))


def choice_map(a: Column, b: Column, c: Column, d: Column) -> Column:
    """the four choices by letter, missing ones empty."""
    pairs = [x for k, v in zip("ABCD", (a, b, c, d), strict=True) for x in (F.lit(k), F.coalesce(v, F.lit("")))]
    return F.create_map(*pairs)


def choices_text(choices: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def fill(template: str, **values: Column) -> Column:
    """A template with {names} as a column; unknown names are an error."""
    import string

    parts = []
    for plain, name, _, _ in string.Formatter().parse(template):
        if plain:
            parts.append(F.lit(plain))
        if name is not None:
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def choice_prompt(question: Column, choices: Column, template: str | None = None) -> Column:
    """Question and choices in order of letter."""
    return fill(template or "{question}\n\n{choices}\n\n", question=question, choices=choices_text(choices))


def question_prompt(question: Column, template: str | None = None) -> Column:
    """The question alone or in a template."""
    return fill(template, question=question) if template else question


def with_context(prompt: Column, context: Column) -> Column:
    """The context before the prompt, if there is any."""
    return F.when(F.coalesce(context, F.lit("")) == "", prompt).otherwise(F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), prompt))


def image_url(content: Column) -> Column:
    """Q7: an image as a data URL, always called jpeg. The built-in function breaks lines, a URL has none."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.translate(F.base64(content), "\r\n", ""))
