"""Main text of web pages by template deduction over the pages of a host.

Tokens (start and end tags in their container, and text blocks) with the same
occurrence vector over a host's pages form an equivalence class.  Classes that
occur on enough pages and hold both ends of a container are valid; nested by
container they are the host's template, and what lies between their tokens are
slots.  The slots of the article's container are the main text.  The template
decides: its constant text goes wherever it stands, and the container is the
innermost of its containers with half of a page's slot text, where tags and
class words only say how much a text weighs.  Hosts without a template (fewer
pages than ``least``) have nothing but the tags.

Occurrence vectors are never built: a token's vector is known by its number of
pages, its total count and two sums of page hashes weighted by count, which add
up in any order, so a host with a third of all pages is an ordinary aggregation.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, save, ship, skew_join, text_chunks, texts_of

CHUNK = 8_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|$)|[^>]*)(?:>|$)",
    re.S,
)
ATTRS = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold main text.
NEVER = frozenset("head script style title nav aside form noscript template iframe button select textarea svg canvas object audio video dialog menu noembed noframes".split())
#: Words in class, id or role that mark what surrounds the main text.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search form "
    "comment comments reply replies disqus discussion share sharing social related recommended pagination toolbar complementary contentinfo".split()
)
READERS = frozenset("comment comments reply replies disqus discussion".split())
CLOSES_P = frozenset(
    "address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
)
SPACES = re.compile(r"\s+")
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Box(NamedTuple):
    """An open element: key is tag and class in its container, state tells how its text counts."""

    name: str
    key: int
    hard: bool  # by its element never main text, or inside such
    soft: bool  # so by class, id or role
    region: int  # 2 inside an article, 1 inside main, else 0
    depth: int  # where the outermost of these stands among its containers, else 0


class Block(NamedTuple):
    text: str
    box: Box
    boxes: tuple[int, ...]


def _marks(attrs: str) -> tuple[str, set[str], str]:
    if not attrs or "=" not in attrs:
        return "", set(), ""
    said, role = [], ""
    for name, a, b, c in ATTRS.findall(attrs):
        said.append(a or b or c)
        if name.lower() in ("role", "itemprop"):
            role = (a or b or c).lower()
    words = {w.lower() for s in said for w in PARTS.findall(s)}
    return " ".join(said), words, role


def key_of(*parts: str) -> int:
    """A token's 63-bit name."""
    return xxhash.xxh64_intdigest("\0".join(parts)) >> 1


def read_page(html: str) -> tuple[list[Block], dict[int, int]]:
    """The page's text blocks in order and the count of each template token.

    Unclosed and stray tags are taken as browsers do: a block start ends an open
    paragraph, an end tag ends what was opened inside its element.
    """
    root = Box("", 0, False, False, 0, 0)
    stack, keys = [root], [0]
    blocks: list[Block] = []
    seen: dict[int, int] = defaultdict(int)
    held: list[str] = []

    def flush() -> None:
        if held:
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append(Block(text, stack[-1], tuple(keys)))
                seen[key_of("text", str(keys[-1]), text)] += 1

    def pop(n: int) -> None:
        while len(stack) > n:
            seen[key_of("end", str(keys[-1]))] += 1
            stack.pop()
            keys.pop()

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if name in INLINE and not (m["attrs"] and "=" in m["attrs"]):
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if name not in INLINE:
                        flush()
                    elif held:  # text of a marked inline element counts as that element's
                        flush() if stack[i].soft else None
                    pop(i)
                    break
            else:
                if name == "p" or name in CLOSES_P:
                    flush()
            continue
        said, words, role = _marks(m["attrs"])
        if name in INLINE:
            if words & AROUND and name != "a":
                flush()
                stack.append(stack[-1]._replace(name=name, soft=True))
                keys.append(keys[-1])
            continue
        if name not in RAW:  # a script inside a paragraph does not end it
            flush()
        if name in VOID or (m["attrs"] or "").rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            seen[key_of("tag", name, said, str(keys[-1]))] += 1
            continue
        if name in CLOSES_P and stack[-1].name == "p":
            pop(len(stack) - 1)
        if name == "li" and any(b.name == "li" for b in stack[-2:]):
            while stack[-1].name in ("p", "li"):
                last = stack[-1].name
                pop(len(stack) - 1)
                if last == "li":
                    break
        if name == "body" and any(b.name == "head" for b in stack):
            pop(next(i for i, b in enumerate(stack) if b.name == "head"))
        up = stack[-1]
        readers = bool(words & READERS)
        opens = 2 if (name == "article" or role == "articlebody") and not readers else 1 if name == "main" or role == "main" else 0
        hard = up.hard or name in NEVER or readers and name not in ("html", "body") or (name in ("footer", "header") and up.region == 0) or (name == "footer" and up.region > 0)
        soft = up.soft or (bool(words & AROUND) and name not in ("html", "body", "main") and not opens)
        if opens and not up.region:
            soft = False
        key = key_of("tag", name, said, str(keys[-1]))
        seen[key] += 1
        stack.append(Box(name, key, hard, soft, max(up.region, opens), len(keys) if opens > up.region else up.depth))
        keys.append(key)
    flush()
    pop(1)
    return blocks, seen


def host_of(url: str | None) -> str:
    """The host in lower case without port; empty if there is none."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, tag, chars, pages, total, s1, s2): each token's occurrence vector in short, summed by batch and then over all."""
    ship(pages.sparkSession)
    schema = "host string, token long, chars long, pages long, total long, s1 long, s2 long"

    def run(batches):
        for table in text_chunks(batches, CHUNK, "html"):
            sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0] * 5)
            for url, page in zip(table.column("url").to_pylist(), texts_of(table, "html"), strict=True):
                host, page_hash = host_of(url), xxhash.xxh64_intdigest(f"{url}\0{page}")
                blocks, seen = read_page(page)
                chars: dict[int, int] = defaultdict(int)
                for b in blocks:
                    if not (b.box.hard or b.box.soft):
                        for k in b.boxes[1:]:
                            chars[k] += len(b.text)
                seen[0] = 1  # stands for the page itself
                for token, n in seen.items():
                    s = sums[host, token]
                    h = xxhash.xxh64_intdigest(str(n), seed=page_hash)
                    for i, v in enumerate((chars.get(token, 0), 1, n, h & 0x7FFFFFFF, h >> 33)):
                        s[i] += v
            keys, values = list(sums), list(sums.values())
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            cols += [pa.array([v[i] for v in values], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "token", "chars", "pages", "total", "s1", "s2"])

    found = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
    return found.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("chars", "pages", "total", "s1", "s2")])


def templates(pages: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(host, n, template, main): a host's pages, the tokens of its valid classes, and of these the containers that hold text.

    A class is valid when it occurs on ``share`` of the host's pages and on
    ``least`` at least, and holds more than one token.  At most 1/share times an
    average page's tokens pass, so a host's template is bounded by page size.
    """
    found, at = save(occurrences(pages))
    hosts = found.where("token = 0").select("host", F.col("pages").alias("of"))
    often = found.where(F.col("pages") >= least).join(hosts, "host").where(F.col("pages") >= share * F.col("of"))
    classes = often.groupBy("host", "pages", "total", "s1", "s2").agg(
        F.collect_list(F.struct("token", "chars")).alias("tokens"), F.max("of").alias("of")
    )
    valid = classes.where((F.size("tokens") > 1) & (F.col("total") >= F.col("pages")))
    one = valid.select("host", "of", F.inline("tokens"))
    holding = F.collect_list(F.when(F.col("chars") > 0, F.col("token"))).alias("main")
    known, _ = save(one.groupBy("host").agg(F.max("of").alias("n"), F.collect_list("token").alias("template"), holding))
    drop(pages.sparkSession, at)
    return known


#: What a character weighs in no article, in main, and in an article.
WEIGHTS = (1, 2, 4)
#: Templates up to this many bytes in all are broadcast; beyond that pages are joined by host, hot hosts apart.
BROADCAST_BYTES = 8 << 20


def by_tags(own: list[Block], slots: list[Block]) -> list[Block]:
    """The slots in an article, else in main, else all."""
    for level in (2, 1):
        if inside := [b for b in own if b.box.region >= level]:
            return [b for b in slots if b.box.region >= level] or inside
    return slots


def main_blocks(blocks: list[Block], template: set[int], containers: set[int]) -> tuple[list[Block], bool]:
    """The blocks in the slots of the article's container, and whether the template chose it.

    The container is the innermost of the template's with half of the weight of
    the page's slots; an article or main counts as one, not its parts.  If it
    is wider than the article, because that differs from page to page, the
    article's slots stand for it where they have half of its weight.  Constant text is
    not main text, in an article neither; only an article of which nothing else
    is left (the same page many times on a host) stays as it is.
    """
    own = [b for b in blocks if not (b.box.hard or b.box.soft)]
    slots = [b for b in own if key_of("text", str(b.boxes[-1]), b.text) not in template]
    weight = {id(b): len(b.text) * WEIGHTS[b.box.region] for b in slots}
    inside: dict[int, list[Block]] = defaultdict(list)
    for b in slots:
        for k in dict.fromkeys(b.boxes[1 : b.box.depth + 1] if b.box.depth else b.boxes[1:]):
            if k in containers:
                inside[k].append(b)
    mass = {k: sum(weight[id(b)] for b in v) for k, v in inside.items()}
    half = [k for k in inside if 2 * mass[k] >= sum(weight.values())]
    if not half:
        return by_tags(own, slots), False
    best = inside[min(half, key=lambda k: len(inside[k]))]
    for level in (2, 1):
        part = [b for b in best if b.box.region >= level]
        if part and 2 * sum(weight[id(b)] for b in part) >= sum(weight[id(b)] for b in best):
            return part, True
    return best, True


def main_text(blocks: list[Block], template: set[int], containers: set[int]) -> list[str]:
    return [b.text for b in main_blocks(blocks, template, containers)[0]]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html counts as empty; a page without main text has the empty string.
    Pages with null or odd urls share the host ''.  Pages of any length are read
    whole.  Every row is a page of its own, also where rows repeat; of containers
    with equal blocks any gives the same text.  An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    ship(spark)
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = templates(own)
    bytes_ = known.agg(F.coalesce(F.sum(8 * (F.size("template") + F.size("main")) + 64), F.lit(0))).first()[0]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    joined = own.withColumn("host", host)
    joined = joined.join(F.broadcast(known.drop("n")), "host", "left") if bytes_ <= BROADCAST_BYTES else skew_join(joined, known, ["host"], "n", "left")

    def run(batches):
        for table in text_chunks(batches, CHUNK, "html"):
            sets: dict[str, tuple[set, set]] = {}
            texts = []
            for i, (host, page) in enumerate(zip(table.column("host").to_pylist(), texts_of(table, "html"), strict=True)):
                if host not in sets:
                    sets[host] = set(table.column("template")[i].as_py() or ()), set(table.column("main")[i].as_py() or ())
                texts.append("\n".join(main_text(read_page(page)[0], *sets[host])))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("page_id").combine_chunks(),
                    table.column("url").combine_chunks(),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(own.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "host", "template", "main").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
