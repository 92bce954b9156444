"""Retrieval facts in long texts: where to insert, inserting, questions, and validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.perturb import draw

#: Facts by category.
FACTS = {
    "number": ["42", "137", "256", "777", "1024", "314159", "9876", "2048", "365", "1337"],
    "animal": ["elephant", "dolphin", "penguin", "tiger", "falcon", "octopus", "koala", "lynx", "panda", "phoenix"],
    "flower": ["rose", "tulip", "orchid", "sunflower", "lily", "lotus", "jasmine", "dahlia", "iris", "peony"],
    "color": ["crimson", "azure", "amber", "violet", "coral", "indigo", "turquoise", "gold", "burgundy", "teal"],
    "city": ["Paris", "Tokyo", "Sydney", "Mumbai", "Cairo", "Seattle", "Barcelona", "Vienna", "Prague", "Kyoto"],
    "fruit": ["mango", "papaya", "lychee", "persimmon", "starfruit", "dragonfruit", "pomegranate", "kiwi", "fig", "guava"],
    "element": ["titanium", "platinum", "mercury", "cobalt", "silver", "copper", "iron", "zinc", "neon", "argon"],
    "planet": ["Mars", "Venus", "Jupiter", "Saturn", "Neptune", "Uranus", "Mercury", "Pluto", "Ceres", "Titan"],
    "instrument": ["violin", "saxophone", "piano", "flute", "harp", "cello", "trumpet", "guitar", "drums", "oboe"],
    "gemstone": ["diamond", "ruby", "sapphire", "emerald", "topaz", "amethyst", "jade", "opal", "pearl", "garnet"],
}
DEPTHS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")
NEEDLE = r"The secret (\w+) is ([\w\s]+)\."
MARK = "\u0001"


def ends_of(text: Column, pattern: str) -> Column:
    """End offsets of all matches of a pattern: mark each match's end, split there, add up the lengths."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"$1{MARK}"), MARK)
    grown = lambda acc, p: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p))
    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"), grown)


def sentence_ends(text: Column) -> Column:
    """Offsets after closing marks with white space, and after empty lines."""
    return ends_of(text, r"[.!?]+\s+|\n{2,}")


def insertion_points(text: Column, regions: int = 5) -> Column:
    """The sentence end nearest to each region's middle (the smaller of two as near), or the middle itself without any."""
    length = F.length(text)
    targets = F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda i: ((i + F.lit(0.5)) * length / F.lit(regions)).cast("int"))
    ends = sentence_ends(text)
    near = lambda t: F.array_min(F.transform(ends, lambda b: F.struct(F.abs(b - t).alias("d"), b.alias("b"))))["b"]
    return F.transform(targets, lambda t: F.coalesce(near(t), t))


def sentence(secret: Column) -> Column:
    return F.concat(F.lit("The secret "), secret["key"], F.lit(" is "), secret["value"], F.lit(". "))


def insert(text: Column, secrets: Column, points: Column) -> Column:
    """Each secret's sentence at its point; of equal points the later secret stands first."""
    placed = F.array_sort(F.filter(F.zip_with(F.transform(points, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))), secrets, lambda a, s: F.struct(a["p"].alias("p"), a["i"].alias("i"), s.alias("s"))), lambda x: x["p"].isNotNull() & x["s"].isNotNull()))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["p"] - acc["at"]), sentence(x["s"])).alias("out"), x["p"].alias("at"))
    return F.aggregate(placed, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def depth(point: Column, length: Column) -> Column:
    """The fifth of the text that a point lies in; 0-20% in an empty text."""
    share = F.when(length > 0, point / length * 100).otherwise(0.0)
    return F.when(share < 20, DEPTHS[0]).when(share < 40, DEPTHS[1]).when(share < 60, DEPTHS[2]).when(share < 80, DEPTHS[3]).otherwise(DEPTHS[4])


def pick_secrets(row_id: Column, n: int = 5, seed: int = 0) -> Column:
    """n categories in an order that MD5 gives, with one value of each."""
    table = F.create_map(*[x for k, v in FACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    keys = F.array_sort(F.transform(F.map_keys(table), lambda k: F.struct(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), row_id.cast("string"), k)).alias("h"), k.alias("key"))))
    value = lambda k: F.get(F.element_at(table, k["key"]), F.pmod(draw(F.lit(seed), row_id, k["key"], F.lit("value")), F.lit(10)).cast("int"))
    return F.transform(F.slice(keys, 1, min(n, len(FACTS))), lambda k: F.struct(k["key"].alias("key"), value(k).alias("value")))


def generate(instances: DataFrame, multiplier: int = 1, num_secrets: int = 5, seed: int = 0) -> DataFrame:
    """Needle instances of rows with _id and a context; none if there would be more questions than secrets.

    The choice follows from seed and _id, not from row order, so any partitioning gives the same.
    """
    rows = instances.where(F.col("_id").isNotNull() & (F.coalesce("context", F.lit("")) != ""))
    if multiplier > num_secrets:
        rows = rows.where(F.lit(False))
    opt = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in instances.columns else F.lit(d)
    rows = rows.select("_id", opt("difficulty", "medium").alias("difficulty"), opt("length", "long").alias("length"), opt("question", "").alias("oq"), opt("answer", "").alias("oa"), "context")
    rows = rows.withColumn("secrets", pick_secrets(F.col("_id"), num_secrets, seed)).withColumn("points", insertion_points(F.col("context"), min(num_secrets, len(FACTS))))
    asked = F.slice(F.array_sort(F.transform("secrets", lambda s, i: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}|question"), F.col("_id").cast("string"), s["key"])).alias("h"), i.alias("i"), s.alias("s")))), 1, multiplier)
    rows = rows.withColumn("asked", asked)
    size = F.length("context")
    return rows.select(
        "_id",
        F.lit("Needle in a Haystack").alias("domain"),
        F.lit("Secret Retrieval").alias("sub_domain"),
        "difficulty",
        "length",
        F.transform("asked", lambda a: F.concat(F.lit("What is the secret "), a["s"]["key"], F.lit(" in the above context?"))).alias("questions"),
        F.transform("asked", lambda a: a["s"]["value"]).alias("answers"),
        F.transform("asked", lambda a: depth(F.get("points", a["i"]), size)).alias("question_depths"),
        insert(F.col("context"), F.col("secrets"), F.col("points")).alias("context"),
        "secrets",
        F.col("oq").alias("original_question"),
        F.col("oa").alias("original_answer"),
    )


def generate_seeded(instances: DataFrame, multiplier: int = 1, num_secrets: int = 5, seed: int | None = None, order: str = "_id") -> DataFrame:
    """G6 with the standard random generator: row i, counted from 0 in ``order``, uses seed + i.

    Sample and choice follow the Python version in use.  Numbering all rows takes
    two passes over their keys, no single-partition window.
    """
    import random

    from pagewright.operators.joins import numbered

    keys = list(FACTS)

    def pick(i: int) -> list[tuple[list[tuple[str, str]], list[int]]]:
        rng = random.Random(None if seed is None else seed + i)
        own = [(k, rng.choice(FACTS[k])) for k in rng.sample(keys, min(num_secrets, len(keys)))]
        asked = rng.sample(range(len(own)), multiplier)
        return own, asked

    @F.pandas_udf("struct<secrets:array<struct<key:string,value:string>>,asked:array<int>>")
    def choose(i: pd.Series) -> pd.DataFrame:
        got = [pick(int(x)) for x in i]
        return pd.DataFrame({"secrets": [[{"key": k, "value": v} for k, v in own] for own, _ in got], "asked": [a for _, a in got]})

    rows = instances.where(F.col("_id").isNotNull() & (F.coalesce("context", F.lit("")) != ""))
    if multiplier > num_secrets:
        rows = rows.where(F.lit(False))
    rows = numbered(rows.select("_id", "context"), order).withColumn("c", choose("row")).withColumn("points", insertion_points(F.col("context"), min(num_secrets, len(keys))))
    size = F.length("context")
    return rows.select(
        "_id",
        F.transform("c.asked", lambda a: F.concat(F.lit("What is the secret "), F.get("c.secrets", a)["key"], F.lit(" in the above context?"))).alias("questions"),
        F.transform("c.asked", lambda a: F.get("c.secrets", a)["value"]).alias("answers"),
        F.transform("c.asked", lambda a: depth(F.get("points", a), size)).alias("question_depths"),
        insert(F.col("context"), F.col("c.secrets"), F.col("points")).alias("context"),
        F.col("c.secrets").alias("secrets"),
    )


def find_needles(text: Column) -> Column:
    """V1: key, value and offset of every inserted sentence."""
    whole = F.regexp_extract_all(text, F.lit(f"(?U){NEEDLE}"), F.lit(0))
    ends = ends_of(text, f"(?U:{NEEDLE})")
    return F.zip_with(
        whole,
        ends,
        lambda w, e: F.struct(
            F.regexp_extract(w, f"(?U){NEEDLE}", 1).alias("key"), F.regexp_replace(F.regexp_extract(w, f"(?U){NEEDLE}", 2), r"(?U)^\s+|\s+$", "").alias("value"), (e - F.length(w)).alias("at")
        ),
    )


def region(at: Column, length: Column) -> Column:
    """V2: the fifth of the finished text, from 0."""
    share = at / length
    return F.when(share < 0.2, 0).when(share < 0.4, 1).when(share < 0.6, 2).when(share < 0.8, 3).otherwise(4)


def validate(instances: DataFrame) -> DataFrame:
    """V3: _id, valid and message: exactly one needle in each fifth, with a line for each fault."""
    found = instances.select("_id", "context", F.when(F.coalesce("context", F.lit("")) != "", find_needles(F.col("context"))).alias("n"))
    placed = found.withColumn("n", F.transform("n", lambda x: F.struct(region(x["at"], F.length("context")).alias("r"), F.concat(x["key"], F.lit("="), x["value"], F.lit(" at pos "), x["at"].cast("string")).alias("t"))))

    def faults(r: Column) -> Column:
        own = F.filter("n", lambda x: x["r"] == r)
        name = F.concat(F.lit("Region "), (r * 20).cast("string"), F.lit("-"), ((r + 1) * 20).cast("string"), F.lit("%: "))
        many = F.concat(F.array(F.concat(name, F.size(own).cast("string"), F.lit(" secrets found (expected 1)"))), F.transform(own, lambda x: F.concat(F.lit("  - "), x["t"])))
        return F.when(F.size(own) == 0, F.array(F.concat(name, F.lit("NO secrets found")))).when(F.size(own) > 1, many).otherwise(F.array().cast("array<string>"))

    errors = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), faults))
    message = (
        F.when(F.col("n").isNull(), "No context found")
        .when(F.size("n") == 0, "No secrets found in context")
        .when(F.size(errors) > 0, F.array_join(errors, "; "))
        .otherwise("OK")
    )
    return placed.select("_id", (message == "OK").alias("valid"), message.alias("message"))


def collisions(instances: DataFrame, strip_style: str = "legacy") -> DataFrame:
    """V4: _id, clean and issues: keys and values that occur as words (or with s) in the text without its needles.

    strip_style legacy deletes needles between empty lines, inline those that
    :func:`insert` makes.
    """
    pattern = {"legacy": r"(?U)\n\nThe secret \w+ is [\w\s]+\.\n\n", "inline": r"(?U)The secret \w+ is [\w\s]+?\. "}[strip_style]
    plain = F.lower(F.regexp_replace(F.coalesce("context", F.lit("")), pattern, ""))
    quoted = lambda s: F.concat(F.lit(r"(?U)\b\Q"), F.lower(s), F.lit(r"\Es?\b"))
    hit = lambda s, kind: F.when(F.regexp_like("plain", quoted(s)), F.concat(F.lit(f"{kind} '"), s, F.lit("' found in context")))
    issues = F.filter(F.flatten(F.transform("secrets", lambda s: F.array(hit(s["key"], "key"), hit(s["value"], "value")))), lambda x: x.isNotNull())
    own = instances.select("_id", "secrets", plain.alias("plain")).withColumn("issues", F.coalesce(issues, F.array().cast("array<string>")))
    return own.select("_id", (F.size("issues") == 0).alias("clean"), "issues")


def validation_summary(checked: DataFrame) -> DataFrame:
    """Counts and shares of valid instances; shares are null without any."""
    total, valid = F.count(F.lit(1)), F.count_if("valid")
    return checked.agg(total.alias("total"), valid.alias("valid"), (total - valid).alias("invalid"), F.try_divide(valid * 100.0, total).alias("valid_pct"))


def collision_summary(checked: DataFrame) -> DataFrame:
    """Clean instances, those with issues, and issues by kind."""
    n = lambda p: F.coalesce(F.sum(F.size(F.filter("issues", lambda x: F.contains(x, F.lit(p))))), F.lit(0))
    return checked.agg(
        F.count_if("clean").alias("clean"),
        F.count_if(~F.col("clean")).alias("with_issues"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"),
        n("key '").alias("key_issues"),
        n("value '").alias("value_issues"),
    )


def generation_summary(made: DataFrame) -> DataFrame:
    """Instances and questions."""
    return made.agg(F.count(F.lit(1)).alias("instances"), F.coalesce(F.sum(F.size("questions")), F.lit(0)).alias("questions"))


def question_depth(depths: Column, index: Column, question: Column, secrets: Column, context: Column) -> Column:
    """X11: the stored depth of a question, else that of the first secret named in it, else unknown."""
    named = F.get(F.filter(secrets, lambda s: F.instr(F.lower(question), F.lower(s["key"])) > 0), F.lit(0))
    at = F.instr(context, F.concat(F.lit("The secret "), named["key"], F.lit(" is "), named["value"])) - 1
    return F.coalesce(F.get(depths, index), F.when(at >= 0, depth(at, F.length(context))), F.lit("unknown"))
