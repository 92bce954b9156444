"""Registered queries of records: choosing, joining, prompts and answers, results, settings, and files written and read again.

Texts that regular expressions with word classes meet are folded to ASCII, since
the classes of the two engines differ beyond it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import answers as A
from pagewright.functions import layout as L
from pagewright.functions import markdown, ocr, perturb
from pagewright.functions import text as T
from pagewright.operators import infer, joins, layout_stats, needles, select, slices
from pagewright.operators.partitioning import scratch, spread
from pagewright.queries import ACC, BINS_SQL, BOX_SQL, FOLD, RESULT_SQL, TOXIC_SQL, boxes, instances, needle_sets, query, results, rounded, sql_text, table, toxic
from pagewright.sources import records, sinks

F_TEXT = FOLD.format("text")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def folded(spark, d) -> DataFrame:
    """documents with text ``t`` in ASCII."""
    return docs(spark, d).withColumn("t", T.fold_ascii(F.col("text")))


# Choosing rows.


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' OR doc_id NOT IN {TOXIC_SQL}")
def excluded_but_unnamed(spark, d):
    """English documents stand for rows without an id."""
    rows = docs(spark, d).withColumn("_id", F.when(F.col("lang") == "en", None).otherwise(F.col("doc_id")))
    return select.excluded(rows, toxic(spark, d), "_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def remaining_rows(spark, d):
    """F5, F6."""
    return select.remaining(docs(spark, d), table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query(BOX_SQL + "SELECT unique_id, count(DISTINCT page)::INTEGER AS pages, count(*)::INTEGER AS boxes FROM x WHERE unique_id = 7 GROUP BY unique_id")
def one_sample(spark, d):
    """F7."""
    return layout_stats.per_sample(select.one_sample(boxes(spark, d), "7")).select("unique_id", "pages", "boxes")


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'de')")
def rows_with_id(spark, d):
    """F8: an empty id for English, none for German."""
    name = F.when(F.col("lang") == "en", "").when(F.col("lang") != "de", F.col("lang"))
    return select.with_id(docs(spark, d).withColumn("name", name), "name").select("doc_id")


@query("SELECT doc_id, md5(CASE lang WHEN 'en' THEN text WHEN 'de' THEN source WHEN 'fr' THEN '' ELSE lang END) AS digest FROM documents")
def first_text(spark, d):
    """text, context or question, the first that is there."""
    lang = F.col("lang")
    own = F.when(lang == "en", F.col("text")).when(lang == "fr", "")
    return docs(spark, d).select("doc_id", F.md5(select.first_text(own, F.when(lang == "de", F.col("source")), lang)).alias("digest"))


@query(BOX_SQL + "SELECT unique_id, count(DISTINCT page)::INTEGER AS images, count(DISTINCT page)::INTEGER AS pages FROM x GROUP BY unique_id")
def essential_fields(spark, d):
    """F15."""
    own = select.essential(boxes(spark, d).withColumn("domain", F.lit("x")))
    return own.select("unique_id", F.size("image_paths").alias("images"), F.size("bboxes").alias("pages"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE doc_id::VARCHAR END AS unique_id FROM documents")
def renamed_ids(spark, d):
    """F16."""
    rows = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("_id"), F.when(F.col("lang") == "en", F.col("source")).alias("unique_id"))
    return select.unique_ids(rows).select("doc_id", "unique_id")


DOMAINS = {"en": "Long Doc Understanding", "de": "Long Summarization", "fr": "Long Code Completion"}


@query("SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'd1' WHEN 'de' THEN 'd3' WHEN 'fr' THEN 'd5' END, 'dx') || '_' || substr(md5(text), 1, 8) AS short FROM documents")
def short_names(spark, d):
    """F17."""
    domain = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in DOMAINS.items()], F.lit("other"))
    return docs(spark, d).select("doc_id", select.short_name(domain, F.md5("text")).alias("short"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '/a/data/ocr/' || source || '/data/x.png' ELSE '/a/' || source || '/x.png' END AS path FROM documents")
def task_paths(spark, d):
    """F19."""
    path = F.when(F.col("lang") == "en", F.concat(F.lit("/a/data/"), "source", F.lit("/data/x.png"))).otherwise(F.concat(F.lit("/a/"), "source", F.lit("/x.png")))
    return docs(spark, d).select("doc_id", select.task_path(path, F.lit("ocr")).alias("path"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars END AS whole, CASE WHEN lang = 'de' THEN n_chars / 4.0::DOUBLE + 0.125 END AS number, CASE WHEN lang NOT IN ('en', 'de') THEN source END AS said FROM documents")
def typed_values(spark, d):
    """a whole number, another number, or text."""
    n = F.col("n_chars")
    given = F.when(F.col("lang") == "en", n.cast("string")).when(F.col("lang") == "de", (n / 4 + 0.125).cast("string")).otherwise(F.col("source"))
    v = perturb.typed_value(given)
    return docs(spark, d).select("doc_id", v["int"].alias("whole"), v["float"].alias("number"), v["str"].alias("said"))


# Joins.


@query(BOX_SQL + "SELECT unique_id AS doc_id, count(DISTINCT page)::INTEGER AS pages, min(unique_id || '_page_' || lpad((page + 1)::VARCHAR, 3, '0') || '.png') AS first FROM x GROUP BY unique_id")
def page_lookup(spark, d):
    """Documents with the sorted names of their images, which a listing of files gives."""
    b = boxes(spark, d)
    files = b.select(F.explode("image_paths").alias("p")).select(L.base_name(F.col("p")).alias("name")).union(b.select(F.concat(F.col("unique_id").cast("string"), F.lit("_page_001.txt"))))
    own = joins.pages_of(docs(spark, d).select(F.col("doc_id").cast("string").alias("_id"), "doc_id"), files)
    return own.select("doc_id", F.size("pages").alias("pages"), F.get("pages", F.lit(0)).alias("first"))


ZIP_SQL = f"""WITH q AS (SELECT doc_id, string_split(t, chr(10)) AS q, string_split(t, '. ') AS a FROM (SELECT doc_id, {F_TEXT} AS t FROM documents)),
z AS (SELECT doc_id, unnest(list_transform(range(1, least(len(q), len(a)) + 1), lambda i: {{'i': i - 1, 'q': q[i], 'a': a[i]}})) AS p FROM q) """


@query(ZIP_SQL + "SELECT doc_id, count(*)::INTEGER AS n, md5(string_agg(p.q || '|' || p.a, '#' ORDER BY p.i)) AS digest FROM z GROUP BY doc_id")
def zipped_questions(spark, d):
    """Questions and answers in pairs, up to the shorter list."""
    rows = folded(spark, d).select("doc_id", joins.zipped(F.split("t", "\n"), F.split("t", r"\. ")).alias("z"))
    return rows.where(F.size("z") > 0).select("doc_id", F.size("z").alias("n"), F.md5(F.array_join(F.transform("z", lambda p: F.concat(p["a"], F.lit("|"), p["b"])), "#")).alias("digest"))


@query(ZIP_SQL + "SELECT doc_id, p.i::INTEGER AS question_idx, md5(p.q) AS question, md5(p.a) AS answer FROM z")
def question_rows(spark, d):
    """Q8, R9."""
    rows = folded(spark, d).select("doc_id", F.split("t", "\n").alias("questions"), F.split("t", r"\. ").alias("answers"))
    return joins.question_rows(rows).select("doc_id", "question_idx", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


SECRETS = (("er", "one"), ("EN", "two"), ("the", "three"))


@query("SELECT doc_id, CASE WHEN contains(t, 'er') THEN 'one' WHEN contains(t, 'en') THEN 'two' WHEN contains(t, 'the') THEN 'three' END AS value " + f"FROM (SELECT doc_id, lower({F_TEXT}) AS t FROM documents)")
def named_secret(spark, d):
    """The first secret whose key the text names."""
    secrets = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in SECRETS])
    return folded(spark, d).select("doc_id", joins.named_secret(F.col("t"), secrets)["value"].alias("value"))


@query("SELECT DISTINCT source AS split FROM documents")
def splits_of_paths(spark, d):
    """S13."""
    files = docs(spark, d).select(F.concat(F.lit("/in/"), "source", F.lit("/images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return records.splits(files.union(docs(spark, d).select(F.concat(F.lit("/in/"), "source", F.lit("/note.txt")))))


@query("SELECT source AS name, count(*) AS n FROM (SELECT lang AS source FROM documents) GROUP BY 1")
def sub_domains(spark, d):
    """A16."""
    return select.histogram(instances(spark, d), "sub_domain").select(F.col("sub_domain").alias("name"), "n")


# Needles.

NEEDLE_DOC_SQL = f"""WITH t AS (SELECT doc_id, {F_TEXT} AS t FROM documents WHERE coalesce(text, '') <> ''),
p AS (SELECT doc_id, t, list_transform(range(0, 5), lambda i: substr(t, (i * length(t)) // 5 + 1, ((i + 1) * length(t)) // 5 - (i * length(t)) // 5)) AS s FROM t),
k AS (SELECT doc_id, s, CASE WHEN length(t) % 3 = 0 THEN 4 ELSE 5 END AS n FROM p),
c AS (SELECT doc_id, n, list_transform(range(1, 6), lambda i: s[i] || CASE WHEN i <= n THEN 'The secret k' || i || ' is v' || i || '. ' ELSE '' END) AS w, s FROM k),
a AS (SELECT doc_id, n, array_to_string(w, '') AS context, list_transform(range(1, n + 1), lambda i: coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x)))::BIGINT, 0) + length(s[i])) AS pos FROM c),
r AS (SELECT doc_id, n, list_transform(pos, lambda x: least(4, CASE WHEN x / length(context) < 0.2 THEN 0 WHEN x / length(context) < 0.4 THEN 1 WHEN x / length(context) < 0.6 THEN 2 WHEN x / length(context) < 0.8 THEN 3 ELSE 4 END)) AS reg FROM a),
v AS (SELECT doc_id, n, len(list_distinct(reg)) = 5 AND n = 5 AS valid FROM r) """


def planted(spark, d) -> DataFrame:
    """documents with a needle after each fifth, the last one missing where the length is divisible by three."""
    rows = folded(spark, d).where("coalesce(text, '') <> ''").withColumns({"n": F.when(F.length("t") % 3 == 0, 4).otherwise(5), "z": F.length("t")})
    cut = lambda i: F.floor(i * F.col("z") / 5).cast("int")
    said = lambda i: F.when(i < F.col("n"), F.concat(F.lit("The secret k"), (i + 1).cast("string"), F.lit(" is v"), (i + 1).cast("string"), F.lit(". "))).otherwise("")
    parts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.substring("t", cut(i) + 1, cut(i + 1) - cut(i)), said(i)))
    return rows.select("doc_id", F.col("doc_id").alias("_id"), F.array_join(parts, "").alias("context"))


@query(NEEDLE_DOC_SQL + "SELECT doc_id, valid FROM v")
def needle_checks(spark, d):
    """V1, V2, V3 on texts with known needles."""
    return needles.validate(planted(spark, d)).select(F.col("_id").alias("doc_id"), "valid")


@query(NEEDLE_DOC_SQL + "SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid, round(count(*) FILTER (WHERE valid) * 100.0 / count(*), 6) AS valid_pct FROM v")
def needle_check_totals(spark, d):
    """A19."""
    return rounded(needles.validation_summary(needles.validate(planted(spark, d))))


@query(
    f"""WITH t AS (SELECT doc_id, lower({F_TEXT}) AS t FROM documents),
i AS (SELECT doc_id, (CASE WHEN regexp_matches(t, '\\bthes?\\b') THEN 1 ELSE 0 END) AS a, (CASE WHEN regexp_matches(t, '\\bders?\\b') THEN 1 ELSE 0 END) AS b FROM t)
SELECT count(*) FILTER (WHERE a + b = 0) AS clean, count(*) FILTER (WHERE a + b > 0) AS with_issues, sum(a + b)::BIGINT AS issues, sum(a)::BIGINT AS key_issues, sum(b)::BIGINT AS value_issues FROM i"""
)
def word_collisions(spark, d):
    """A secret named ``the`` with value ``Der`` against every text."""
    secret = F.array(F.struct(F.lit("the").alias("key"), F.lit("Der").alias("value")))
    return needles.collision_summary(needles.collisions(folded(spark, d).select(F.col("doc_id").alias("_id"), F.col("t").alias("context"), secret.alias("secrets")), "inline"))


@query("SELECT count(*) AS instances, (2 * count(*))::BIGINT AS questions FROM documents WHERE coalesce(text, '') <> ''")
def needle_totals(spark, d):
    """A22."""
    return needles.generation_summary(needle_sets(spark, d))


DEPTH_SQL = f"""WITH f AS (SELECT doc_id, lang, source, {F_TEXT} AS t FROM documents),
s AS (SELECT *, instr(t, 'The secret ' || lang || ' is ' || source) - 1 AS pos, length(t) AS n FROM (SELECT doc_id, lang, source, substr(t, 1, length(t) // 3) || CASE WHEN length(t) % 4 > 0 THEN 'The secret ' || lang || ' is ' || source || '. ' ELSE '' END || substr(t, length(t) // 3 + 1) AS t FROM f)),
x AS (SELECT doc_id, lang, source, n, CASE WHEN lang = 'en' THEN '80-100%' WHEN pos < 0 THEN 'unknown' WHEN pos * 100.0 / n < 20 THEN '0-20%' WHEN pos * 100.0 / n < 40 THEN '20-40%' WHEN pos * 100.0 / n < 60 THEN '40-60%' WHEN pos * 100.0 / n < 80 THEN '60-80%' ELSE '80-100%' END AS depth FROM s) """


def depths(spark, d) -> DataFrame:
    """documents with a needle a third into most of them; English ones have their depth stored."""
    needle = F.concat(F.lit("The secret "), "lang", F.lit(" is "), "source", F.lit(". "))
    third = F.floor(F.length("t") / 3).cast("int")
    context = F.concat(F.substring("t", F.lit(1), third), F.when(F.length("t") % 4 > 0, needle).otherwise(""), F.substring("t", third + 1, F.length("t")))
    rows = folded(spark, d).select("doc_id", "lang", "source", context.alias("context"))
    stored = F.when(F.col("lang") == "en", F.array(F.lit("80-100%"))).otherwise(F.array().cast("array<string>"))
    secrets = F.array(F.struct(F.col("lang").alias("key"), F.col("source").alias("value")))
    question = F.concat(F.lit("What is the secret "), F.upper("lang"), F.lit(" in the above context?"))
    return rows.withColumn("depth", needles.question_depth(stored, F.lit(0), question, secrets, F.col("context")))


@query(DEPTH_SQL + "SELECT doc_id, depth FROM x")
def question_depths(spark, d):
    """X11, R11, G5."""
    return depths(spark, d).select("doc_id", "depth")


@query(
    DEPTH_SQL
    + f""", r AS (SELECT depth, quality = 1 AS correct, CASE WHEN n < 1000 THEN '<8k' WHEN n < 2000 THEN '8k-16k' WHEN n < 3000 THEN '16k-24k' WHEN n < 4000 THEN '24k-32k' WHEN n < 6000 THEN '32k-48k' WHEN n < 8000 THEN '48k-64k' ELSE '>=64k' END AS context_bin
FROM labels JOIN x USING (doc_id) WHERE depth <> 'unknown'), dv AS (SELECT * FROM (VALUES ('0-20%'), ('20-40%'), ('40-60%'), ('60-80%'), ('80-100%')) v(depth))
SELECT context_bin, NULL::VARCHAR AS depth, {ACC} FROM {BINS_SQL} LEFT JOIN r USING (context_bin) GROUP BY context_bin
UNION ALL SELECT NULL, depth, {ACC} FROM dv LEFT JOIN r USING (depth) GROUP BY depth
UNION ALL SELECT context_bin, depth, {ACC} FROM (SELECT * FROM {BINS_SQL}, dv) LEFT JOIN r USING (context_bin, depth) GROUP BY context_bin, depth"""
)
def accuracy_by_context_and_depth(spark, d):
    """Eight tokens a character."""
    rows = depths(spark, d).withColumn("context_bin", T.token_bin(F.length("context") * 8))
    own = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")).join(rows, "doc_id")
    return rounded(slices.by_context_and_depth(own))


@query()
def accuracy_by_tokens(spark, d):
    """A4 with X10's real token counts."""
    import public_tokenizers

    count = T.token_counter(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = spread(docs(spark, d)).select("doc_id", T.token_bin(count("text") * 8).alias("context_bin"))
    own = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")).join(rows, "doc_id")
    return rounded(slices.by_axis(own, "context_bin"))


# Prompts and answers.

PARTS_SQL = "(SELECT conv_id, turn, text, string_split(text, '. ') AS p FROM conversations)"


@query(f"SELECT conv_id, turn, md5(text || chr(10) || chr(10) || 'A. ' || coalesce(p[1], '') || chr(10) || 'B. ' || coalesce(p[2], '') || chr(10) || 'C. ' || coalesce(p[3], '') || chr(10) || 'D. ' || coalesce(p[4], '') || chr(10) || chr(10)) AS prompt FROM {PARTS_SQL}")
def choice_prompts(spark, d):
    """A turn as the question, its first sentences as choices."""
    p = F.split("text", r"\. ")
    choices = A.choice_map(*[F.get(p, F.lit(i)) for i in range(4)])
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(A.choice_prompt(F.col("text"), choices)).alias("prompt"))


SAID_SQL = f"(SELECT conv_id, turn, upper(regexp_replace({F_TEXT}, '^\\s+|\\s+$', '', 'g')) AS u, lower(substr(text, 1, 1)) AS truth FROM conversations)"


@query(
    f"""SELECT conv_id, turn, coalesce(nullif(regexp_extract(u, '\\b([A-D])\\b', 1), ''), nullif(regexp_extract(u, '[(]([A-D])[)]', 1), ''), nullif(regexp_extract(u, '(?:ANSWER|CHOICE|OPTION)[:\\s]*([A-D])', 1), ''), nullif(regexp_extract(u, '^([A-D])', 1), ''), '') = upper(truth) AS correct FROM {SAID_SQL}"""
)
def choice_checks(spark, d):
    """Every turn as an answer; its first letter is the truth."""
    return table(spark, d, "conversations").select("conv_id", "turn", A.choice_correct(T.fold_ascii(F.col("text")), F.lower(F.substring("text", 1, 1))).alias("correct"))


THOUGHT_SQL = "(SELECT doc_id, text, CASE WHEN lang = 'en' THEN '<think>' || source || '</think> ' ELSE ' ' END || text || ' ' AS t, lang FROM documents)"


@query(
    f"SELECT doc_id, md5(CASE WHEN lang = 'en' THEN s ELSE t END) AS kept, md5(s) AS stripped FROM (SELECT doc_id, t, lang, regexp_replace(CASE WHEN lang = 'en' THEN substr(t, instr(t, '</think>') + 8) ELSE t END, '^\\s+|\\s+$', '', 'g') AS s FROM {THOUGHT_SQL})"
)
def after_thinking(spark, d):
    """X1, X2."""
    t = F.concat(F.when(F.col("lang") == "en", F.concat(F.lit("<think>"), "source", F.lit("</think> "))).otherwise(" "), "text", F.lit(" "))
    return docs(spark, d).select("doc_id", F.md5(A.after_thinking(t)).alias("kept"), F.md5(A.after_thinking(t, True)).alias("stripped"))


@query(
    "SELECT doc_id, md5(CASE lang WHEN 'en' THEN regexp_replace(replace(replace(text || ' x', chr(10) || chr(10) || chr(10) || chr(10), chr(10) || chr(10)), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g') "
    "WHEN 'de' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '<center>' || text || '</center> x' END) AS digest FROM documents"
)
def cleaned_for_model(spark, d):
    """L4 (with L3 and X2 behind it): the model follows the language."""
    lang = F.col("lang")
    model = F.when(lang == "en", "DeepSeek-OCR-2").when(lang == "de", "x-Glyph").otherwise("other")
    said = F.when(lang == "de", F.concat(F.lit("q</think> "), "text")).otherwise(F.concat(F.lit("<center>"), "text", F.lit("</center> x")))
    return docs(spark, d).select("doc_id", F.md5(ocr.clean_for_model(said, model)).alias("digest"))


@query("SELECT doc_id, md5(replace(text, '. ', chr(10))) AS digest FROM documents")
def joined_blocks(spark, d):
    """L5."""
    return docs(spark, d).select("doc_id", F.md5(ocr.join_blocks(F.split("text", r"\. "))).alias("digest"))


@query("SELECT doc_id, md5('data:image/jpeg;base64,' || base64(encode(text))) AS digest FROM documents")
def image_urls(spark, d):
    """Q7: the bytes of a text as an image."""
    return docs(spark, d).select("doc_id", F.md5(A.image_url(F.encode("text", "UTF-8"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 1.5 WHEN quality = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS penalty FROM labels")
def penalties(spark, d):
    """Q9: toxic documents have an option given, good ones a setting."""
    given, set_ = F.when(F.col("toxic") == 1, 1.5), F.when(F.col("quality") == 1, 0.5)
    return table(spark, d, "labels").select("doc_id", infer.first_option(given, set_).alias("penalty"))


# Recognised items.

ITEM_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, {F_TEXT} AS t FROM documents)),
w AS (SELECT doc_id, i, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS j FROM l),
k AS (SELECT doc_id, i, j, regexp_replace(word, '^\\s+|\\s+$', '', 'g') AS word FROM w WHERE regexp_replace(word, '^\\s+|\\s+$', '', 'g') <> '') """


def items(spark, d) -> DataFrame:
    """documents as recognised pages: words by line, each with a box."""
    lines = F.transform(F.split("t", "\n"), lambda x: F.split(x, " "))
    rows = folded(spark, d).select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"), lines.alias("word_texts"))
    point = lambda i, j: F.array(F.array(j * 1.0, i * 1.0))
    return infer.word_items(rows.withColumn("word_boxes", F.transform("word_texts", lambda x, i: F.transform(x, lambda _, j: point(i, j)))))


@query(ITEM_SQL + "SELECT doc_id || '.png' AS image_name, count(*)::INTEGER AS item_count, md5(string_agg(word, ' ' ORDER BY i, j)) AS digest, sum(i + j - 2)::DOUBLE AS places FROM k GROUP BY doc_id")
def word_items(spark, d):
    """P1 by word."""
    places = F.aggregate("polys", F.lit(0.0), lambda a, p: a + p[0][0] + p[0][1])
    return items(spark, d).where("item_count > 0").select("image_name", "item_count", F.md5(F.array_join("texts", " ")).alias("digest"), places.alias("places"))


@query(
    f"WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM (SELECT doc_id, {F_TEXT} AS t FROM documents)) "
    "SELECT doc_id || '.png' AS image_name, count(*)::INTEGER AS item_count, sum(length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars FROM l WHERE regexp_matches(line, '\\S') GROUP BY doc_id"
)
def block_items(spark, d):
    """P1 by block: lines as blocks, with confidences."""
    lines = F.split("t", "\n")
    rows = folded(spark, d).select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"),
        lines.alias("rec_texts"),
        F.transform(lines, lambda _: F.array(F.array(F.lit(0.0), F.lit(0.0)))).alias("rec_polys"),
        F.transform(lines, lambda _: F.lit(0.5)).alias("rec_scores"),
    )
    got = infer.block_items(rows).where("item_count > 0 and size(confidences) = item_count")
    return got.select("image_name", "item_count", F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(ITEM_SQL + "SELECT (SELECT count(*) FROM documents) AS images, count(*) AS items, round(count(*) / (SELECT count(*) FROM documents), 6) AS items_per_image FROM k")
def item_totals(spark, d):
    """A21."""
    return rounded(infer.item_totals(items(spark, d)))


# Texts.


@query(
    "SELECT doc_id, md5(regexp_replace('```markdown' || chr(10) || text || chr(10) || '```', '^```markdown' || chr(10) || '|```$', '', 'g')) AS digest FROM documents WHERE NOT contains(text, '```') UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"
)
def unfenced(spark, d):
    """N1."""
    t = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))
    return docs(spark, d).where("text is null or not contains(text, '```')").select("doc_id", F.md5(T.drop_fences(t)).alias("digest"))


WIDE = "translate({}, '　' || array_to_string(list_transform(range(65281, 65375), lambda i: chr(i::INTEGER)), ''), ' ' || array_to_string(list_transform(range(33, 127), lambda i: chr(i::INTEGER)), ''))"


@query(f"SELECT doc_id, md5({WIDE.format(chr(39) + 'ＡＢ（１）～　' + chr(39) + ' || text')}) AS digest FROM documents")
def half_width(spark, d):
    """N3."""
    return docs(spark, d).select("doc_id", F.md5(T.half_width(F.concat(F.lit("ＡＢ（１）～　"), "text"))).alias("digest"))


@query("SELECT doc_id, md5('fi1A' || nfc_normalize(text)) AS digest FROM documents")
def compatibility_form(spark, d):
    """Compatibility characters before the text."""
    return docs(spark, d).select("doc_id", F.md5(T.nfkc(F.concat(F.lit("ﬁ①Ａ"), "text"))).alias("digest"))


CELL_SQL = "regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')"


@query(f"""SELECT doc_id, md5('<html><body><table border="1" ><tr><td>' || c || '</td></tr><tr><td>' || c || '$x+1$</td></tr></table></body></html>') AS digest FROM (SELECT doc_id, {CELL_SQL} AS c FROM documents)""")
def html_tables(spark, d):
    """A table around each text, with all that is taken out of tables."""
    c = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    t = F.concat(F.lit('<p>a</p><table class="k" width="3"><thead align="left"><tr><th>'), c, F.lit('</th></tr></thead>\n<tbody><tr style="x"><td height="2"><span>'), c, F.lit('</span><math alttext="x+1"><mi>x</mi></math></td></tr></tbody></table><p>b</p>'))
    return spread(docs(spark, d)).select("doc_id", F.md5(T.normalise_html_table(t)).alias("digest"))


ESCAPED_SQL = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
PLAIN = "regexp_replace(text, '[`*_\\[\\]]', '', 'g')"


@query(f"""SELECT doc_id, md5('<font name="Courier">a&amp;b</font> <b>c</b> <b>d</b> <i>e</i> <i>f</i> t ' || {ESCAPED_SQL.format(PLAIN)}) AS digest FROM documents""")
def inline_markup(spark, d):
    """D11."""
    t = F.concat(F.lit("`a&b` **c** __d__ *e* _f_ [t](u) "), F.regexp_replace("text", r"[`*_\[\]]", ""))
    return docs(spark, d).select("doc_id", F.md5(markdown.inline(t)).alias("digest"))


#: What every line of a text becomes in turn.
MARKS = ("# ", "", "", "> ", "", "- ", "", "```", "", "   12. ", "```", "---", "### ")
MARKED_SQL = f"""WITH m AS (SELECT [{', '.join(sql_text(x) for x in MARKS)}] AS marks),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM (SELECT doc_id, coalesce({F_TEXT}, '') AS t FROM documents)),
n AS (SELECT doc_id, pos, regexp_replace(CASE WHEN marks[pos % 13 + 1] = '---' THEN '---' ELSE marks[pos % 13 + 1] || raw END, '\\s+$', '') AS line FROM l, m),
k AS (SELECT *, regexp_replace(line, '^\\s+', '') AS bare FROM n),
c AS (SELECT *, CASE WHEN starts_with(bare, '```') THEN 'fence' WHEN regexp_matches(line, '^#{{1,6}}\\s+.+$') THEN 'heading' WHEN starts_with(bare, '>') THEN 'quote' WHEN regexp_matches(line, '^\\s*([*+-]|\\d+\\.)\\s+.+$') THEN 'item'
  WHEN regexp_matches(bare, '^[-*_]{{3,}}$') THEN 'rule' WHEN bare = '' THEN 'blank' ELSE 'text' END AS class FROM k),
f AS (SELECT *, count(*) FILTER (WHERE class = 'fence') OVER (PARTITION BY doc_id ORDER BY pos) AS fences, count(*) FILTER (WHERE class = 'fence') OVER (PARTITION BY doc_id) AS total FROM c),
r AS (SELECT *, class <> 'fence' AND fences % 2 = 1 AS code, count(*) FILTER (WHERE class NOT IN ('fence', 'text') AND fences % 2 = 0) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
s AS (SELECT doc_id, 'code' AS kind, 0 AS level, string_agg(line, chr(10) ORDER BY pos) AS text, max(pos) + 0.5 AS place FROM r WHERE code AND fences < total GROUP BY doc_id, fences HAVING regexp_matches(string_agg(line, ''), '\\S')
  UNION ALL SELECT a.doc_id, 'paragraph', 0, a.text, coalesce((SELECT min(b.pos) FROM r b WHERE b.doc_id = a.doc_id AND NOT b.code AND b.class NOT IN ('fence', 'text') AND b.pos > a.last) - 0.25, 1e9) FROM (SELECT doc_id, run, string_agg(line, ' ' ORDER BY pos) AS text, max(pos) AS last FROM r WHERE NOT code AND class = 'text' GROUP BY doc_id, run) a
  UNION ALL SELECT doc_id, 'heading', length(regexp_extract(line, '^(#+)', 1)), regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1), pos FROM r WHERE NOT code AND class = 'heading'
  UNION ALL SELECT doc_id, 'quote', 0, regexp_replace(substr(bare, 2), '^\\s+', ''), pos FROM r WHERE NOT code AND class = 'quote'
  UNION ALL SELECT doc_id, 'item', length(regexp_extract(line, '^(\\s*)', 1)), regexp_replace(bare, '^([*+-]|\\d+\\.)\\s+', '\\1 '), pos FROM r WHERE NOT code AND class = 'item'
  UNION ALL SELECT doc_id, 'rule', 0, '', pos FROM r WHERE NOT code AND class = 'rule') """


@query(MARKED_SQL + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS seq, kind, level::INTEGER AS level, md5(text) AS digest FROM s")
def markdown_of_lines(spark, d):
    """Lines with marks in turn."""
    mark = F.array(*[F.lit(x) for x in MARKS])
    lines = F.transform(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x, i: F.when(F.get(mark, i % 13) == "---", "---").otherwise(F.concat(F.get(mark, i % 13), x)))
    s = markdown.segment(folded(spark, d).select("doc_id", F.array_join(lines, "\n").alias("text")))
    return s.select("doc_id", F.col("seq").cast("long").alias("seq"), "kind", "level", F.md5("text").alias("digest"))


# Layout and settings.


@query(BOX_SQL + "SELECT unique_id, page::INTEGER AS page, sum(20 + 2 * i * 12 + 4 * (20 + length(text)) + 8 * (i * 12 + 10) + 16 * 20 + 32 * i * 12)::DOUBLE AS total FROM x GROUP BY unique_id, page")
def polygons(spark, d):
    """Corners, each with its own weight in a sum."""
    one = lambda b: F.aggregate(F.transform(F.array(*[F.get(L.polygon(b), F.lit(k)) for k in (0, 1, 2, 5, 6, 3)]), lambda v, k: v * F.pow(F.lit(2.0), k)), F.lit(0.0), lambda a, x: a + x)
    pages = boxes(spark, d).select("unique_id", F.posexplode("bboxes").alias("page", "b"))
    return pages.select("unique_id", "page", F.aggregate(F.transform("b", one), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(BOX_SQL + "SELECT unique_id || '_page_' || lpad((page + 1)::VARCHAR, 3, '0') AS page_id, md5(coalesce(string_agg(text, ' ' ORDER BY i) FILTER (WHERE text <> ''), '')) AS digest FROM x GROUP BY unique_id, page")
def identity_from_boxes(spark, d):
    """W9, W10."""
    return layout_stats.identity_from_boxes(boxes(spark, d)).select("page_id", F.md5("text").alias("digest"))


@query(BOX_SQL + "SELECT unique_id, count(DISTINCT page)::INTEGER AS pages, count(*)::INTEGER AS boxes FROM x WHERE page < 2 GROUP BY unique_id")
def first_pages(spark, d):
    """O2."""
    return layout_stats.per_sample(layout_stats.first_pages(boxes(spark, d), 2)).select("unique_id", "pages", "boxes")


SPAN_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS j FROM l),
g AS (SELECT doc_id, i, j, word, j * 7.3 AS x0, i * 9.7 AS y0, j * 7.3 + length(word) * 1.1 AS x1, i * 9.7 + 8.2 AS y1 FROM s WHERE regexp_matches(word, '\\S')) """
PX = "greatest(0, round_even({} * 144 / 72.0, 0))::INTEGER"


def spans(spark, d) -> DataFrame:
    """documents as spans of words by line, in points."""
    span = lambda w, i, j: F.struct((j * F.lit(7.3)).alias("x0"), (i * F.lit(9.7)).alias("y0"), (j * F.lit(7.3) + F.length(w) * F.lit(1.1)).alias("x1"), (i * F.lit(9.7) + F.lit(8.2)).alias("y1"), w.alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.transform(F.split(t, " "), lambda w, j: span(w, i, j)))
    return docs(spark, d).select("doc_id", lines.alias("lines"))


def box_sums(found: DataFrame) -> DataFrame:
    """Number, edges and characters of each document's boxes, summed."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], F.sum(F.length("b.text")).alias("chars"))


PIXEL_SQL = f"SELECT doc_id, count(*) AS n, sum({PX.format('x0')})::BIGINT AS x0, sum({PX.format('y0')})::BIGINT AS y0, sum(greatest({PX.format('x1')}, {PX.format('x0')} + 1))::BIGINT AS x1, sum(greatest({PX.format('y1')}, {PX.format('y0')} + 1))::BIGINT AS y1, sum(length(word))::BIGINT AS chars FROM "


@query(SPAN_SQL + PIXEL_SQL + "g GROUP BY doc_id")
def word_boxes(spark, d):
    """D5 by word."""
    return box_sums(spans(spark, d).select("doc_id", F.explode(L.word_boxes(F.flatten("lines"), 144.0)).alias("b")))


@query(SPAN_SQL + ", u AS (SELECT doc_id, i, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(word, ' ' ORDER BY j) AS word FROM g GROUP BY doc_id, i) " + PIXEL_SQL + "u GROUP BY doc_id")
def line_boxes(spark, d):
    """D5 by line."""
    return box_sums(spans(spark, d).select("doc_id", F.explode(L.line_boxes(F.col("lines"), 144.0)).alias("b")))


@query(
    "SELECT doc_id, CASE WHEN lang = 'en' THEN ((n_chars % 40) * 0.8::DOUBLE)::VARCHAR WHEN lang = 'de' THEN ((n_chars % 20) * 0.8::DOUBLE)::VARCHAR END AS pressed, 'Verdana.ttf' AS font, '8' AS size, '9' AS height FROM documents"
)
def settings_perturbed(spark, d):
    """Line heights of English, font sizes of German documents, neither of others."""
    n, lang = F.col("n_chars"), F.col("lang")
    none = F.create_map().cast("map<string,string>")
    config = F.when(lang == "en", F.create_map(F.lit("line-height"), (n % 40).cast("string"), F.lit("font-size"), F.lit("9"))).when(lang == "de", F.create_map(F.lit("font-size"), (n % 20).cast("string"))).otherwise(none)
    dense = perturb.dense_text(config, 8)
    get = lambda c, k: F.try_element_at(c, F.lit(k))
    return docs(spark, d).select(
        "doc_id", get(perturb.apply("line_height_compression", config), "line-height").alias("pressed"), get(perturb.apply("tofu", config), "font-path").alias("font"), get(dense, "font-size").alias("size"), get(dense, "line-height").alias("height")
    )


@query("SELECT doc_id, source AS dpi, CASE WHEN lang = 'en' THEN 'own' ELSE 'base' END AS font, CASE WHEN lang = 'en' THEN lang END AS extra FROM documents")
def merged_settings(spark, d):
    """Settings of some documents over those of all."""
    base = F.create_map(F.lit("dpi"), F.col("source"), F.lit("font"), F.lit("base"))
    item = F.when(F.col("lang") == "en", F.create_map(F.lit("font"), F.lit("own"), F.lit("extra"), F.col("lang")))
    got = L.merge_config(base, item)
    return docs(spark, d).select("doc_id", *[F.try_element_at(got, F.lit(k)).alias(k) for k in ("dpi", "font", "extra")])


@query("SELECT doc_id, trunc(length(text) * 0.8::DOUBLE)::INTEGER AS width, trunc(length(source) * 0.8::DOUBLE)::INTEGER AS height FROM documents WHERE text IS NOT NULL")
def scaled_sizes(spark, d):
    """The size that resampling gives."""
    from pagewright.functions import images

    size = images.scaled_size(F.length("text"), F.length("source"), 0.8)
    return docs(spark, d).where("text is not null").select("doc_id", size["width"].alias("width"), size["height"].alias("height"))


# Files written and read again.


def instance_rows(spark, d) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("domain"), F.col("lang").alias("sub_domain"), F.col("text").alias("context"))


INSTANCE_SQL = "SELECT doc_id::VARCHAR AS _id, source AS domain, lang AS sub_domain, md5(text) AS digest FROM documents"


@query(INSTANCE_SQL)
def json_lines_again(spark, d):
    """Records, one a line."""
    at = scratch(spark, "records")
    sinks.records(instance_rows(spark, d), at)
    return records.json_lines(spark, at, schemas.INSTANCE).select("_id", "domain", "sub_domain", F.md5("context").alias("digest"))


@query(INSTANCE_SQL)
def json_array_again(spark, d):
    """An array of records a file, here a file for each source."""
    at = scratch(spark, "array")
    rows = instance_rows(spark, d)
    whole = rows.withColumn("file", F.col("domain")).groupBy("file").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    whole.repartition("file").write.partitionBy("file").text(at)
    return records.json_array(spark, at).select("_id", "domain", "sub_domain", F.md5("context").alias("digest"))


@query("SELECT 'p' || doc_id AS page_id, md5(coalesce(text, '') || chr(10)) AS digest FROM documents")
def page_files_again(spark, d):
    """A file for each page, read by name."""
    at = scratch(spark, "pages")
    sinks.page_files(spread(docs(spark, d)).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_id"), "text"), at)
    return records.predictions(spark, at).select("page_id", F.md5("text").alias("digest"))


@query("SELECT DISTINCT id FROM (SELECT doc_id::VARCHAR AS id FROM labels UNION ALL SELECT source FROM documents)")
def id_list_again(spark, d):
    """A list, added to and read."""
    at = scratch(spark, "ids")
    sinks.id_file(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")), at, union=False)
    sinks.id_file(docs(spark, d).select(F.col("source").alias("id")), at)
    return records.id_list(spark, at, must_exist=True)


@query(BOX_SQL + "SELECT unique_id::VARCHAR AS unique_id, count(DISTINCT page)::INTEGER AS pages, count(*)::INTEGER AS boxes, sum(20 + i * 12 + 20 + length(text) + i * 12 + 10 + length(text))::BIGINT AS total FROM x GROUP BY unique_id")
def boxes_again(spark, d):
    """Boxes as rows of strings, typed when read."""
    at = scratch(spark, "boxes")
    plain = F.transform("bboxes", lambda p: F.transform(p, lambda b: F.array(*[b[c].cast("string") for c in ("x0", "y0", "x1", "y1", "text")])))
    rows = boxes(spark, d).select(F.col("unique_id").cast("string").alias("unique_id"), "image_paths", plain.alias("bboxes"))
    sinks.append_boxes(rows.where("unique_id % 2 = 0"), at)
    sinks.append_boxes(rows.where("unique_id % 2 = 1"), at)
    total = F.aggregate(F.flatten("bboxes"), F.lit(0).cast("long"), lambda a, b: a + b["x0"] + b["y0"] + b["x1"] + b["y1"] + F.length(b["text"]))
    return records.line_boxes(spark, at).select("unique_id", F.size("bboxes").alias("pages"), L.box_count(F.col("bboxes")).alias("boxes"), total.alias("total"))


@query(BOX_SQL + "SELECT unique_id || '_page_' || lpad((page + 1)::VARCHAR, 3, '0') AS page_id, md5(max(text) FILTER (WHERE i = 0)) AS digest FROM x GROUP BY unique_id, page HAVING max(text) FILTER (WHERE i = 0) <> ''")
def ground_truth_again(spark, d):
    """Layout documents written, and their first element read as truth."""
    at = scratch(spark, "layout")
    layout_stats.layout_documents(boxes(spark, d)).drop("unique_id").write.json(at)
    return records.truth_of(records.json_lines(spark, at, schemas.LAYOUT_DOC)).select("page_id", F.md5("text").alias("digest"))


@query(ITEM_SQL + "SELECT doc_id || '.png' AS image_name, count(*) AS n, sum(length(word))::BIGINT AS chars FROM k GROUP BY doc_id")
def items_again(spark, d):
    """Items as a row for each text."""
    at = scratch(spark, "items")
    sinks.items(items(spark, d), at, "csv")
    rows = spark.read.option("header", True).schema("image_path string, image_name string, text string, confidence double, poly string").csv(at)
    return rows.groupBy("image_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT source AS split, doc_id || '.png' AS name, greatest(1, (length(t) + 63) // 64)::INTEGER AS height, coalesce(list_sum(list_transform(string_split(t, ''), lambda c: ascii(c))), 0)::BIGINT AS total " + f"FROM (SELECT doc_id, source, {F_TEXT} AS t FROM documents WHERE coalesce(text, '') <> '')")
def images_again(spark, d):
    """Texts drawn as grey images of 64 columns, written as PNG by split, listed and read."""
    at = scratch(spark, "images")
    rows = spread(folded(spark, d).where("coalesce(text, '') <> ''")).select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), F.encode("t", "UTF-8").alias("raw"))

    @F.pandas_udf("binary")
    def drawn(raw: pd.Series) -> pd.Series:
        import numpy as np

        from pagewright.functions import png

        def one(b):
            a = np.zeros((max(1, -(-len(b) // 64)), 64), np.uint8)
            a.reshape(-1)[: len(b)] = np.frombuffer(b, np.uint8)
            return png.encode(a)

        return raw.map(one)

    @F.pandas_udf("struct<height:int,total:long>")
    def seen(content: pd.Series) -> pd.DataFrame:
        from pagewright.functions import png

        got = [png.decode(bytes(c)) for c in content]
        return pd.DataFrame({"height": [len(a) for a in got], "total": [int(a.sum(dtype="int64")) for a in got]})

    files = rows.select("source", "name", drawn("raw").alias("content")).persist()
    for (source,) in sorted(tuple(r) for r in files.select("source").distinct().collect()):  # a folder for each split, of which there are few
        sinks.page_images(files.where(F.col("source") == source), f"{at}/{source}/images")
    files.unpersist()
    listed = records.images(spark, at, recursive=True)
    return listed.withColumn("s", seen("content")).select("split", "name", "s.height", "s.total")


@query("SELECT 1 AS row, round(0.0::DOUBLE, 6) AS cer_mean, (SELECT count(*) FROM documents WHERE coalesce(text, '') <> '') AS pages")
def evaluation_again(spark, d):
    """Pages written, read as predictions and scored against themselves."""
    from pagewright.operators import scoring

    at, out = scratch(spark, "predictions"), scratch(spark, "evaluation")
    gt = docs(spark, d).where("coalesce(text, '') <> ''").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_id"), "text")
    sinks.page_files(spread(gt), at)
    pages, summary = scoring.evaluate(records.predictions(spark, at), gt, with_bleu=False)
    sinks.evaluation(pages, summary, out)
    read = spark.read.json(f"{out}/per_page").agg(F.count(F.lit(1)).alias("pages"))
    return read.select(F.lit(1).alias("row"), F.lit(spark.read.json(f"{out}/summary").first()["cer_mean"]).cast("double").alias("cer_mean"), "pages")


@query(RESULT_SQL + "SELECT source AS domain, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source")
def results_with_instances(spark, d):
    """R5."""
    own = table(spark, d, "labels").select(F.col("doc_id").alias("instance_id"), "quality")
    return joins.with_instances(own, instances(spark, d), ["domain"]).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'in/' || source || '.png' AS path FROM documents")
def listed_images(spark, d):
    """The distinct paths of a list."""
    at = scratch(spark, "list")
    docs(spark, d).select(F.concat(F.lit("in/"), "source", F.lit(".png")).alias("value")).write.text(at)
    return records.listed_images(spark, at)
