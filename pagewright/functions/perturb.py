"""Registry of text and layout perturbations, all deterministic column expressions.

Text perturbations take the text and a row id; layout ones take a settings map
(hyphenated string keys).  Where the choice is random, an MD5 of row id and
position decides, so results do not depend on partitioning or retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def apply(name: str, data: Column, **params) -> Column:
    """The named perturbation of a column; unknown names are an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown perturbation {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](data, **params)


#: Look-alikes of single characters.
LOOK_ALIKES = {
    "0": ["O", "o"],
    "1": ["l", "I", "|"],
    "2": ["Z"],
    "5": ["S"],
    "6": ["G"],
    "8": ["B"],
    "9": ["g", "q"],
    "c": ["e"],
    "i": ["j"],
    "m": ["rn"],
    "w": ["vv"],
    "d": ["cl"],
    "n": ["ri"],
    "u": ["li"],
    ".": [","],
    ",": ["'"],
    "'": ["`"],
    "-": ["–", "—"],
    "_": ["-"],
    ":": [";"],
    "|": ["I", "l"],
}


def draw(*parts: Column, digits: int = 8, start: int = 1) -> Column:
    """A number below 16**digits from the MD5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


@register("font_weight")
def font_weight(text: Column, weight: str = "bold", **_) -> Column:
    """The text between one, two or three asterisks."""
    marks = {"bold": "**", "italic": "*", "bold_italic": "***"}.get(weight)
    return F.concat(F.lit(marks), text, F.lit(marks)) if marks else text


@register("homoglyph_substitution")
def look_alike(text: Column, row_id: Column, substitution_rate: float = 0.1, **_) -> Column:
    """T4: each character that has look-alikes becomes one of them at the given rate."""
    limit = round(substitution_rate * 0x10000)
    pairs = [x for k, v in LOOK_ALIKES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    table = F.create_map(*pairs)

    def one(c: Column, i: Column) -> Column:
        options = F.try_element_at(table, c)
        hit = options.isNotNull() & (draw(row_id, i, digits=4) < limit)
        return F.when(hit, F.get(options, F.pmod(draw(row_id, i, digits=4, start=5), F.size(options)).cast("int"))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def setting(config: Column, key: str) -> Column:
    return F.try_element_at(config, F.lit(key)).cast("double")


def number_text(c: Column) -> Column:
    """A number as settings hold it: whole ones without a point."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def with_setting(config: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(config, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


@register("reduced_font_size")
def smaller_font(config: Column, font_size: float = 8, **_) -> Column:
    """The font size, six at least."""
    return with_setting(config, "font-size", F.lit(f"{max(6, font_size):g}"))


@register("tighter_layout")
def tighter(config: Column, line_height_factor: float = 0.8, **_) -> Column:
    """The line height (12 if unset) times a factor, cut to a whole number."""
    height = F.coalesce(setting(config, "line-height"), F.lit(12.0)) * line_height_factor
    return with_setting(config, "line-height", height.cast("int").cast("string"))


@register("line_height_compression")
def compressed(config: Column, compression_factor: float = 0.8, **_) -> Column:
    """T5: the line height, or else the font size, times a factor as line height; unchanged without both."""
    height = F.coalesce(setting(config, "line-height"), setting(config, "font-size")) * compression_factor
    return F.when(height.isNull(), config).otherwise(with_setting(config, "line-height", height.cast("string")))


@register("tofu")
def tofu(config: Column, font_path: str = "Verdana.ttf", **_) -> Column:
    """A font that lacks the text's characters."""
    return with_setting(config, "font-path", F.lit(font_path))


@register("dpi_downscale")
def lower_dpi(config: Column, dpi: float = 72, **_) -> Column:
    """The resolution."""
    return with_setting(config, "dpi", F.lit(f"{dpi:g}"))


def dense_text(config: Column, font_size: float = 8) -> Column:
    """The font size, and a line height one larger. Not in the registry: settings only."""
    return with_setting(with_setting(config, "font-size", F.lit(f"{font_size:g}")), "line-height", F.lit(f"{font_size + 1:g}"))


def split_name(kind: Column, font_size=None, dpi=None, fmt=None, quality=None, method=None, scale=None) -> Column:
    """The name of the split that a perturbation's output goes to."""
    lit = lambda x: x if isinstance(x, Column) else F.lit("" if x is None else str(x))
    tail = (
        F.when(kind == "jpeg_compression", "jpeg")
        .when(kind == "webp_compression", "webp")
        .when(kind == "lossy_encoding", F.concat_ws("_", lit(fmt), lit(quality)))
        .when(kind == "binarization_thresholding", "binary")
        .when(kind == "random_noise", "noise")
        .when(kind == "resampling_kernel", F.concat_ws("_", F.lit("resample"), lit(method), lit(scale)))
        .when(kind == "dense_text", F.concat_ws("_", F.lit("fontsize"), lit(font_size)))
        .when(kind == "dpi_downscale", F.concat_ws("_", F.lit("dpi"), lit(dpi)))
        .otherwise(kind)
    )
    return F.concat(F.lit("adv_"), tail)


def typed_value(text: Column) -> Column:
    """a parameter as whole number, else number, else text; the first that fits is set."""
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint"))
    number = F.when(whole.isNull(), F.trim(text).try_cast("double"))
    return F.struct(whole.alias("int"), number.alias("float"), F.when(whole.isNull() & number.isNull(), text).alias("str"))
