"""Boxes, layout elements and page geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.text import strip


def typed_boxes(raw: Column) -> Column:
    """Boxes read as strings, by page, as structs; null pages stay null."""
    box = lambda b: F.struct(*[F.get(b, F.lit(i)).cast("double").cast("int").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.coalesce(F.get(b, F.lit(4)), F.lit("")).alias("text"))
    return F.transform(raw, lambda page: F.transform(page, box))


def polygon(box: Column) -> Column:
    """The four corners, clockwise from the upper left."""
    return F.array(*[box[c].cast("double") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")])


def giant_box(page: Column) -> Column:
    """The box around all, texts joined by blanks; all zero and empty without boxes."""
    edge = lambda f, name: F.coalesce(f(F.transform(page, lambda b: b[name])), F.lit(0))
    return F.struct(
        edge(F.array_min, "x0").alias("x0"),
        edge(F.array_min, "y0").alias("y0"),
        edge(F.array_max, "x1").alias("x1"),
        edge(F.array_max, "y1").alias("y1"),
        F.coalesce(F.array_join(F.transform(page, lambda b: b["text"]), " "), F.lit("")).alias("text"),
    )


def category(text: Column) -> Column:
    """Short upper-case text is a title, Figure or Table opens a caption, all else is text."""
    upper = text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")
    return F.when(upper & (F.length(text) < 50), "title").when(text.startswith("Figure") | text.startswith("Table"), "figure_caption").otherwise("text_block")


def element(box: Column, order: Column, kind: Column) -> Column:
    """A layout element of one box with one span."""
    span = F.struct(F.lit("text_span").alias("category_type"), polygon(box).alias("poly"), box["text"].alias("text"))
    return F.struct(
        kind.alias("category_type"),
        polygon(box).alias("poly"),
        F.lit(False).alias("ignore"),
        order.cast("int").alias("order"),
        order.cast("int").alias("anno_id"),
        box["text"].alias("text"),
        F.array(span).alias("line_with_spans"),
        F.struct(F.lit("text_english").alias("text_language"), F.lit("white").alias("text_background"), F.lit("normal").alias("text_rotate")).alias("attribute"),
    ).cast(schemas.LAYOUT_ELEMENT)


def page_elements(page: Column, concatenate: bool) -> Column:
    """The elements of a page: one around all, or one for each box in order."""
    if concatenate:
        return F.array(element(giant_box(page), F.lit(1), F.lit("text_block")))
    return F.transform(page, lambda b, i: element(b, i + 1, category(b["text"])))


def elements_text(elements: Column) -> Column:
    """Non-empty texts in order (missing order first, ties as they stand), joined by blanks."""
    keyed = F.transform(elements, lambda e, i: F.struct(F.coalesce(e["order"], F.lit(0)).alias("o"), i.alias("i"), e["text"].alias("t")))
    return F.array_join(F.transform(F.filter(F.array_sort(keyed), lambda e: F.coalesce(e["t"], F.lit("")) != ""), lambda e: e["t"]), " ")


def boxes_text(page: Column) -> Column:
    """Non-empty box texts joined by blanks."""
    return F.array_join(F.transform(F.filter(page, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), " ")


def box_count(pages: Column) -> Column:
    """Boxes over all pages; null is none."""
    return F.coalesce(F.aggregate(pages, F.lit(0), lambda a, p: a + F.coalesce(F.size(p), F.lit(0))), F.lit(0))


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit(""))


def to_pixels(x0: Column, y0: Column, x1: Column, y1: Column, dpi: Column | float, x_scale: Column | float = 1.0) -> Column:
    """Points to whole pixels, half to even, not negative, at least one wide and high; null unless all are finite."""
    scale = F.lit(dpi) / 72.0 if not isinstance(dpi, Column) else dpi / 72.0
    over = F.lit(x_scale) if not isinstance(x_scale, Column) else x_scale
    px = [x0 * scale * over, y0 * scale, x1 * scale * over, y1 * scale]
    fine = None
    for p in px:
        ok = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
        fine = ok if fine is None else fine & ok
    a, b, c, d = (F.greatest(F.lit(0), F.rint(p).cast("int")) for p in px)
    return F.when(fine, F.struct(a.alias("x0"), b.alias("y0"), F.greatest(c, a + 1).alias("x1"), F.greatest(d, b + 1).alias("y1")))


def _finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def _placed(spans: Column, dpi: float, x_scale: float) -> Column:
    """Spans (x0, y0, x1, y1, text) in points as boxes in pixels; those out of range or without text go."""
    box = lambda s: F.struct(to_pixels(s["x0"], s["y0"], s["x1"], s["y1"], dpi, x_scale).alias("p"), strip(s["text"]).alias("text"))
    fine = F.filter(F.transform(spans, box), lambda b: b["p"].isNotNull() & (b["text"] != ""))
    return F.transform(fine, lambda b: F.struct(*[b["p"][c].alias(c) for c in ("x0", "y0", "x1", "y1")], b["text"].alias("text")))


def word_boxes(words: Column, dpi: float = 72.0, x_scale: float = 1.0) -> Column:
    """D5 by word: words in points as boxes in pixels."""
    return _placed(words, dpi, x_scale)


def line_boxes(lines: Column, dpi: float = 72.0, x_scale: float = 1.0) -> Column:
    """D5 by line: the spans of each line as one box.

    Blank spans do not count.  A span whose corners are not finite adds its text
    only; texts are joined with a blank where the text so far does not end in one.
    """

    def one(spans: Column) -> Column:
        said = F.filter(spans, lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")
        sure = F.filter(said, lambda s: _finite(s["x0"], s["y0"], s["x1"], s["y1"]))
        edge = lambda f, c: f(F.transform(sure, lambda s: s[c]))
        text = F.aggregate(said, F.lit(""), lambda a, s: F.concat(a, F.when((a != "") & ~a.endswith(" "), " ").otherwise(""), s["text"]))
        return F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"), text.alias("text"))

    return _placed(F.transform(lines, one), dpi, x_scale)


def union_boxes(spans: Column) -> Column:
    """A line's box around its spans, texts joined by one blank."""
    return giant_box(spans)


def pre_clean(text: Column, drop_breaks: bool) -> Column:
    """The paragraphs to lay out: one without line breaks, or escaped lines with runs of blanks kept."""
    c = F.translate(text, "\u00ad\u200b", "")
    if drop_breaks:
        return F.array(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\n+", " "), " +", " "), "^ +| +$", ""))
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    # Every blank of a run of two or more: one that a blank precedes or follows.
    return F.split(F.regexp_replace(c, "(?<= ) | (?= )", "&nbsp;"), "\n")


def has_cjk(text: Column) -> Column:
    """D3: any ideograph of the main block."""
    return text.rlike("[\\u4E00-\\u9FFF]")


def batches(parts: Column, size: int = 30, markup: str = "<br/>") -> Column:
    """Lines joined in batches."""
    n = F.size(parts)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, size), markup))).otherwise(F.array().cast("array<string>"))


def merge_config(base: Column, item: Column) -> Column:
    """Settings of the item over those of the base."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(item, k), F.lit(False))), F.coalesce(item, F.create_map().cast("map<string,string>")))
