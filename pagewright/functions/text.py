"""Text normalisation and text statistics as column expressions."""

from __future__ import annotations

from functools import lru_cache, reduce
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def strip(c: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_characters(c: Column, characters: str) -> Column:
    """Without any of the given characters at both ends."""
    one = "[" + "".join("\\" + x if not x.isalnum() else x for x in characters.replace("\n", "")) + ("\\n" if "\n" in characters else "") + "]"
    return F.regexp_replace(c, rf"^{one}+|{one}+\z", "")


def drop_fences(c: Column) -> Column:
    """Opening fences of markdown, html and latex blocks and any closing fence, each with one line break."""
    for kind in ("markdown", "html", "latex"):
        c = F.regexp_replace(c, rf"(?m)^```{kind}\n?", "")
    return F.regexp_replace(c, r"(?m)```\n?$", "")


def limit_repeats(c: Column) -> Column:
    """Four underscores or blanks at most in a row."""
    return F.regexp_replace(F.regexp_replace(c, "_{4,}", "____"), " {4,}", "    ")


def half_width(c: Column) -> Column:
    """Full-width forms and the ideographic blank as their ASCII counterparts."""
    wide = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(c, wide, " " + "".join(map(chr, range(0x21, 0x7F))))


def clean(c: Column) -> Column:
    """Strip, half width, repeats, and one blank for any white space."""
    return F.regexp_replace(limit_repeats(half_width(strip(c))), r"(?U)\s+", " ")


def normalise(c: Column) -> Column:
    """What both sides of a comparison go through."""
    return clean(drop_fences(c))


#: LaTeX commands deleted from formulas, in this order.
FORMULA_DELETIONS = (
    r"\mathbf", r"\mathrm", r"\mathnormal", r"\mathit", r"\mathbb", r"\mathcal", r"\mathscr", r"\mathfrak", r"\mathsf", r"\mathtt",
    r"\textbf", r"\text", r"\boldmath", r"\boldsymbol", r"\operatorname", r"\bm", r"\symbfit", r"\mathbfcal", r"\symbf",
    r"\scriptscriptstyle", r"\notag", r"\setlength", r"\coloneqq", r"\space", r"\thickspace", r"\thinspace", r"\medspace",
    r"\nobreakspace", r"\negmedspace", r"\quad", r"\qquad", r"\enspace", r"\substackw", " ", "$$", r"\left", r"\right",
    r"\displaystyle", r"\text",
)
#: Patterns deleted from formulas and from LaTeX tables, in this order.
FORMULA_PATTERNS = (r"\\tag\{.*?\}", r"\\hspace\{.*?\}", r"\\begin\{.*?\}", r"\\end\{.*?\}", r"\\arraycolsep.*?\}")
LATEX_TABLE_PATTERNS = (
    r"\\vspace\{.*?\}", r"\\hspace\{.*?\}", r"\\rule\{.*?\}\{.*?\}", r"\\addlinespace\[.*?\]", r"\\addlinespace",
    r"\\renewcommand\{\\arraystretch\}\{.*?\}", r"\\arraystretch\{.*?\}", r"(row|column)?colors?\{[^}]*\}(\{[^}]*\}){0,2}",
    r"\\color\{.*?\}", r"\\textcolor\{.*?\}", r"\\rowcolor(\[.*?\])?\{.*?\}", r"\\columncolor(\[.*?\])?\{.*?\}",
    r"\\cellcolor(\[.*?\])?\{.*?\}", r"\\colorbox\{.*?\}",
    r"\\(tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge)",
)


def _without(c: Column, patterns) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, "(?d)" + p, ""), patterns, c)


def normalise_formula(c: Column) -> Column:
    """The first display formula's inside if there is one, without layout commands, in lower case."""
    c = strip_characters(strip_characters(strip(c), "$"), "\n")
    display = r"(?d)\\\[(.+?)(?<!\\)\\\]"
    c = F.when(c.rlike(display), strip(F.regexp_extract(c, display, 1))).otherwise(c)
    c = strip_characters(_without(c, FORMULA_PATTERNS), ".")
    return F.lower(reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), FORMULA_DELETIONS, c))


def normalise_latex_table(c: Column) -> Column:
    """Without spacing, colour and size commands."""
    return _without(c, LATEX_TABLE_PATTERNS)


#: What a table is, the attributes that go, and the table that results.
TABLE = r"<table\b[^>]*>(.*)</table>"
TABLE_ATTRIBUTES = ("style", "height", "width", "align", "class")
TABLE_OUT = '<html><body><table border="1" >{}</table></body></html>'


class _Table(HTMLParser):
    """Writes html again with th as td, without thead and span tags, formulas as $alttext$, and only &, < and > as references."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.math = 0

    def handle_starttag(self, tag, attrs):
        if tag == "math":
            if not self.math:
                self.out.append(escape("$" + (dict(attrs).get("alttext") or "") + "$", quote=False))
            self.math += 1
        elif not self.math and tag not in ("thead", "span"):
            said = "".join(f' {k}="{escape(v, quote=False)}"' if v is not None else f" {k}" for k, v in attrs)
            self.out.append(f"<{'td' if tag == 'th' else tag}{said}>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag == "math":
            self.math -= 1

    def handle_endtag(self, tag):
        if tag == "math":
            self.math = max(0, self.math - 1)
        elif not self.math and tag not in ("thead", "span"):
            self.out.append(f"</{'td' if tag == 'th' else tag}>")

    def handle_data(self, data):
        if not self.math:
            self.out.append(escape(data, quote=False))

    def handle_entityref(self, name):
        self.handle_data(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))


def html_table(text: str | None) -> str | None:
    """N7 for one text."""
    if text is None:
        return None
    if "<table" not in text.replace(" ", "").replace("'", '"'):
        return ""
    writer = _Table()
    writer.feed(text)
    writer.close()
    flat = unicodedata.normalize("NFKC", "".join(writer.out).replace("\n", "")).strip()
    inside = "".join(re.findall(TABLE, flat, re.S | re.I))
    for name in TABLE_ATTRIBUTES:
        inside = re.sub(rf' {name}=".*?"', "", inside)
    inside = re.sub(r"\s+", " ", re.sub(r"</?tbody>", "", inside))
    return TABLE_OUT.format(inside)


@F.pandas_udf(StringType())
def normalise_html_table(c: pd.Series) -> pd.Series:
    """The tables' rows in one plain table; empty without a table."""
    return c.map(html_table, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Fixed value: characters that do not make a word by themselves.
EDGE_MARKS = ".,;:!?()[]{}\"'`"


def count_words(c: Column) -> Column:
    """White-space tokens with a character besides edge punctuation; null is 0."""
    marks = "".join("\\" + x for x in EDGE_MARKS)
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w.rlike(rf"[^{marks}]"))
    return F.coalesce(F.size(words), F.lit(0))


def content_id(c: Column) -> Column:
    """Sixteen hex digits of the text's MD5."""
    return F.substring(F.md5(c), 1, 16)


#: Upper limits of context-length bins, in tokens.
TOKEN_BINS = ((8000, "<8k"), (16000, "8k-16k"), (24000, "16k-24k"), (32000, "24k-32k"), (48000, "32k-48k"), (64000, "48k-64k"))
LONGEST_BIN = ">=64k"
BIN_NAMES = (*(name for _, name in TOKEN_BINS), LONGEST_BIN)


def token_bin(n: Column, bins=TOKEN_BINS, longest: str = LONGEST_BIN) -> Column:
    """The half-open bin of a token count."""
    (limit, name), *rest = bins
    out = F.when(n < limit, name)
    for limit, name in rest:
        out = out.when(n < limit, name)
    return out.otherwise(longest)


def token_estimate(c: Column) -> Column:
    """X10 without a vocabulary: a quarter of the code points, rounded up. An estimate, not a BPE count; null is 0."""
    return F.coalesce(F.ceil(F.length(c) / 4).cast("long"), F.lit(0).cast("long"))


@lru_cache(2)
def _encoding(ranks: str, pattern: str):
    """The vocabulary, read once by each Python worker."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counter(ranks: str, pattern: str):
    """X10 with a vocabulary: a function that counts the byte-pair tokens of a rank file; null is 0."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks, pattern)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0)

    return count


def fold_ascii(c: Column) -> Column:
    """Every other character than ASCII as a question mark."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")
