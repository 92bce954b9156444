"""The registered queries of the library over the given tables, and their DuckDB SQL.

``documents`` stand for instances and pages, ``labels`` for results,
``conversations`` for prompts and outputs.  Every query runs over whole tables
and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import answers as A
from pagewright.functions import layout as L
from pagewright.functions import images, markdown, ocr, perturb
from pagewright.functions import text as T
from pagewright.operators import infer, joins, layout_stats, needles, scoring, select, slices
from pagewright.operators.partitioning import spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, and two sides of each document: folded to ASCII, and with look-alikes.

    Edit distance takes lines, not whole documents: a page is a line of a text, so
    its cost is bounded by line length and all text is scored.
    """
    docs = spread(table(spark, d, "documents"))
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split(T.fold_ascii(F.col("text")), "\n")).alias("line", "gt"))
    page = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("line").cast("string"))
    lines = lines.withColumn("page_id", page)
    return lines.withColumn("pred", T.fold_ascii(perturb.look_alike(F.col("gt"), F.col("page_id"), 0.1)))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOOK_SQL = (
    "MAP {"
    + ", ".join(f"{sql_text(k)}: [{', '.join(sql_text(x) for x in v)}]" for k, v in perturb.LOOK_ALIKES.items())
    + "}"
)


def look_sql(text: str, row_id: str, rate: int) -> str:
    """Look-alikes in DuckDB; list positions start at 1 there."""
    num = lambda a: f"('0x' || substr(md5({row_id} || '|' || (i - 1)), {a}, 4))::BIGINT"
    return (
        f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: CASE WHEN look[c] IS NOT NULL AND {num(1)} < {rate} "
        f"THEN look[c][({num(5)} % len(look[c])) + 1] ELSE c END), '')"
    )


PAGES_SQL = f"""
WITH m AS (SELECT {LOOK_SQL} AS look),
f AS (SELECT doc_id, lang, source, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents),
l AS (SELECT doc_id, lang, source, unnest(string_split(t, chr(10))) AS gt, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM f),
p AS (SELECT *, doc_id || '_' || line AS page_id FROM l),
pg AS (SELECT p.*, regexp_replace({look_sql("gt", "page_id", 6554)}, '[^\\x00-\\x7F]', '?', 'g') AS pred FROM p, m)
"""
NORM = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '_{{4,}}', '____', 'g'), ' {{4,}}', '    ', 'g'), '\\s+', ' ', 'g')"
CER_SQL = PAGES_SQL + f""", n AS (SELECT *, {NORM('gt')} AS g, {NORM('pred')} AS q FROM pg),
c AS (SELECT doc_id, lang, source, page_id, CASE WHEN g = '' THEN CASE WHEN q = '' THEN 0.0 ELSE 100.0 END
      ELSE levenshtein(g, q)::DOUBLE / greatest(length(g), length(q)) * 100 END AS cer FROM n)
"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_pairs(pages(spark, d), ["doc_id", "lang", "source", "page_id"], with_bleu=False)


SUMMARY_SQL = "round(avg(cer), 6) AS cer_mean, round(stddev_pop(cer), 6) AS cer_std, round(min(cer), 6) AS cer_min, round(max(cer), 6) AS cer_max, count(cer) AS cer_count"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(CER_SQL + f"SELECT lang, {SUMMARY_SQL} FROM c GROUP BY lang")
def cer_by_lang(spark, d):
    return rounded(scoring.summary(scored(spark, d), ["cer"], ["lang"]))


@query(CER_SQL + f"SELECT {SUMMARY_SQL} FROM c")
def cer_summary(spark, d):
    return rounded(scoring.summary(scored(spark, d), ["cer"]))


@query(CER_SQL + f"SELECT source, {SUMMARY_SQL} FROM c GROUP BY source")
def cer_by_split(spark, d):
    """A2 by split: predictions joined with their truth (R1), scored (C3) and summed up."""
    both = pages(spark, d)
    side = lambda c: both.select("source", "page_id", F.col(c).alias("text"))
    return rounded(scoring.evaluate(side("pred"), side("gt"), ["source"], with_bleu=False)[1])


@query()
def bleu_by_lang(spark, d):
    return rounded(scoring.summary(scoring.score_pairs(pages(spark, d), ["lang"]), ["bleu"], ["lang"]))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_missing_pred(spark, d):
    return joins.missing(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang <> 'en' AND l.doc_id = d.doc_id)")
def coverage_missing_gt(spark, d):
    """Labels as predictions; documents in other languages than English as truth."""
    return joins.missing(table(spark, d, "labels"), table(spark, d, "documents").where("lang <> 'en'"), ["doc_id"])


WORDS_SQL = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: regexp_matches(w, '[^.,;:!?()\\[\\]{}\"''`]')))"


@query(f"SELECT doc_id, {WORDS_SQL}::INTEGER AS words, substr(md5(text), 1, 16) AS content_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def text_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.count_words(t).alias("words"), T.content_id(t).alias("content_id"), T.token_estimate(t).alias("tokens"))


TOP_SQL = f"""WITH w AS (SELECT doc_id, source, {WORDS_SQL} AS n FROM documents WHERE coalesce(text, '') <> ''),
t AS (SELECT doc_id FROM w ORDER BY n DESC, doc_id LIMIT (SELECT CAST(trunc(count(*) * 25.0 / 100) AS BIGINT) FROM w)) """


@query(TOP_SQL + "SELECT doc_id FROM t")
def top_pct_longest(spark, d):
    return select.longest_texts(table(spark, d, "documents"), "doc_id", F.col("text"), 25.0, "doc_id")


@query(TOP_SQL + "SELECT doc_id FROM t UNION SELECT doc_id FROM documents WHERE source = 'src1'")
def domain_or_longest(spark, d):
    return select.domain_or_longest(table(spark, d, "documents"), "doc_id", F.col("text"), "src1", 25.0, "doc_id", "source")


@query("SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY source")
def domain_histogram(spark, d):
    return rounded(select.histogram(table(spark, d, "documents"), "source"))


def instances(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("context"), F.col("source").alias("domain"), F.col("lang").alias("sub_domain"))


@query(
    "SELECT count(*) FILTER (WHERE tok > 64000) AS by_length, count(*) FILTER (WHERE source = 'Long Structured Data Understanding') AS by_domain, "
    "count(*) FILTER (WHERE tok > 64000 OR source = 'Long Structured Data Understanding') AS excluded, count(*) FILTER (WHERE NOT (tok > 64000 OR source = 'Long Structured Data Understanding')) AS kept "
    "FROM (SELECT source, length(text) * 16 AS tok FROM documents)"
)
def exclusion_breakdown(spark, d):
    return select.exclusion_breakdown(instances(spark, d), F.length("context") * 16)


@query("SELECT doc_id AS _id FROM documents WHERE length(text) * 16 > 64000 OR source = 'Long Structured Data Understanding'")
def final_exclusions(spark, d):
    return select.final_exclusions(instances(spark, d), F.length("context") * 16)


def toxic(spark, d) -> DataFrame:
    return table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()


TOXIC_SQL = "(SELECT doc_id FROM labels WHERE toxic = 1)"


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN {TOXIC_SQL} ORDER BY doc_id LIMIT 100")
def blacklist_before_limit(spark, d):
    return select.exclude_then_limit(table(spark, d, "documents"), toxic(spark, d), "doc_id", 100, "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) WHERE doc_id NOT IN {TOXIC_SQL}")
def blacklist_after_limit(spark, d):
    return select.limit_then_exclude(table(spark, d, "documents"), toxic(spark, d), "doc_id", 100, "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE doc_id IN {TOXIC_SQL}")
def blacklisted_present(spark, d):
    return select.listed(table(spark, d, "documents"), toxic(spark, d), "doc_id").select("doc_id")


@query("SELECT text_id, max(doc_id) AS doc_id FROM (SELECT md5(text) AS text_id, doc_id FROM documents) GROUP BY text_id")
def dedupe_last_wins(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("text_id"), "doc_id", F.col("doc_id").alias("seq"))
    return joins.last_of_key(rows, ["text_id"], "seq").select("text_id", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents")
def input_order(spark, d):
    return joins.numbered(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "row")


def results(spark, d) -> DataFrame:
    """labels as results: quality is correctness, toxic an error; levels from lang and length."""
    docs = table(spark, d, "documents")
    level = F.when(F.col("lang") == "en", "easy").when(F.col("lang") == "de", "medium").when(F.col("lang") == "fr", "hard")
    size = F.when(F.length("text") < 1000, "short").when(F.length("text") < 5000, "medium").otherwise("long")
    known = docs.select("doc_id", level.alias("difficulty"), size.alias("length"), T.token_bin(F.length("text") * 4).alias("context_bin"), F.col("source").alias("instance_id"))
    status = F.when(F.col("toxic") == 1, "error").otherwise("success")
    return table(spark, d, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("correct"), status.alias("status")).join(known, "doc_id")


RESULT_SQL = """WITH k AS (SELECT doc_id, source AS instance_id, CASE lang WHEN 'en' THEN 'easy' WHEN 'de' THEN 'medium' WHEN 'fr' THEN 'hard' END AS difficulty,
  CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 5000 THEN 'medium' ELSE 'long' END AS length,
  CASE WHEN length(text) * 4 < 8000 THEN '<8k' WHEN length(text) * 4 < 16000 THEN '8k-16k' WHEN length(text) * 4 < 24000 THEN '16k-24k' WHEN length(text) * 4 < 32000 THEN '24k-32k'
       WHEN length(text) * 4 < 48000 THEN '32k-48k' WHEN length(text) * 4 < 64000 THEN '48k-64k' ELSE '>=64k' END AS context_bin FROM documents),
r AS (SELECT k.*, quality = 1 AND toxic = 0 AS correct, CASE WHEN toxic = 1 THEN 'error' ELSE 'success' END AS status FROM labels JOIN k USING (doc_id)) """
ACC = "count(correct) AS total, count(*) FILTER (WHERE correct) AS correct, round(CASE WHEN count(correct) > 0 THEN count(*) FILTER (WHERE correct) * 100.0 / count(correct) END, 6) AS accuracy"


@query(
    RESULT_SQL
    + "SELECT count(*) AS total, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE status <> 'success') AS errors, count(*) - count(*) FILTER (WHERE correct) - count(*) FILTER (WHERE status <> 'success') AS incorrect, "
    "round(coalesce(count(*) FILTER (WHERE correct) * 100.0 / nullif(count(*), 0), 0), 6) AS accuracy FROM r"
)
def accuracy_overall(spark, d):
    return rounded(slices.overall(results(spark, d)))


BINS_SQL = "(VALUES ('<8k'), ('8k-16k'), ('16k-24k'), ('24k-32k'), ('32k-48k'), ('48k-64k'), ('>=64k')) b(context_bin)"


@query(RESULT_SQL + f"SELECT context_bin, {ACC} FROM {BINS_SQL} LEFT JOIN r USING (context_bin) GROUP BY context_bin")
def accuracy_by_length_dense(spark, d):
    return rounded(slices.by_axis(results(spark, d), "context_bin"))


@query(
    RESULT_SQL
    + f""", x AS (SELECT * FROM r WHERE difficulty IS NOT NULL), dv AS (SELECT * FROM (VALUES ('easy'), ('medium'), ('hard')) v(difficulty)), lv AS (SELECT * FROM (VALUES ('short'), ('medium'), ('long')) v(length))
SELECT difficulty, NULL::VARCHAR AS length, {ACC} FROM dv LEFT JOIN x USING (difficulty) GROUP BY difficulty
UNION ALL SELECT NULL, length, {ACC} FROM lv LEFT JOIN x USING (length) GROUP BY length
UNION ALL SELECT difficulty, length, {ACC} FROM (SELECT * FROM dv, lv) LEFT JOIN x USING (difficulty, length) GROUP BY difficulty, length"""
)
def accuracy_grouping_sets(spark, d):
    return rounded(slices.by_difficulty_and_length(select.known_levels(results(spark, d))))


@query(RESULT_SQL + f"SELECT instance_id, {ACC} FROM r GROUP BY instance_id")
def accuracy_per_instance(spark, d):
    return rounded(slices.by_instance(results(spark, d)))


@query(
    RESULT_SQL
    + "SELECT instance_id AS split, count(*) AS total, count(*) FILTER (WHERE state = 'existing') AS existing, count(*) FILTER (WHERE state <> 'existing') AS new, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'failed') AS failed "
    "FROM (SELECT instance_id, CASE WHEN status = 'error' THEN 'failed' WHEN correct THEN 'completed' ELSE 'existing' END AS state FROM r) GROUP BY ROLLUP (instance_id)"
)
def split_progress(spark, d):
    state = F.when(F.col("status") == "error", "failed").when(F.col("correct"), "completed").otherwise("existing")
    return slices.progress(results(spark, d).select(F.col("instance_id").alias("split"), state.alias("state")))


ENDS_SQL = """WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]+\\s+|\\n{2,})', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
e AS (SELECT doc_id, text, length(text) AS n, list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p)))::INTEGER) AS ends FROM s) """


@query(ENDS_SQL + "SELECT doc_id, len(ends)::INTEGER AS n, coalesce(list_sum(ends), 0)::BIGINT AS total FROM e")
def sentence_boundaries(spark, d):
    ends = needles.sentence_ends(F.col("text"))
    rows = spread(table(spark, d, "documents")).select("doc_id", ends.alias("e"))
    return rows.select("doc_id", F.size("e").alias("n"), F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


POINTS_SQL = ENDS_SQL + """, q AS (SELECT doc_id, text, n, ends, list_transform(range(0, 5), lambda i: trunc((i + 0.5) * n / 5)::INTEGER) AS ts FROM e),
p AS (SELECT doc_id, text, n, list_transform(ts, lambda t: CASE WHEN len(ends) = 0 THEN t ELSE list_min(list_transform(ends, lambda b: {'d': abs(b - t), 'b': b})).b END) AS points FROM q) """


@query(POINTS_SQL + "SELECT doc_id, points[1] AS p0, points[2] AS p1, points[3] AS p2, points[4] AS p3, points[5] AS p4 FROM p")
def needle_positions(spark, d):
    rows = spread(table(spark, d, "documents")).select("doc_id", needles.insertion_points(F.col("text")).alias("p"))
    return rows.select("doc_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(5)])


@query(
    POINTS_SQL
    + """, i AS (SELECT doc_id, text, n, list_sort(list_transform(points, lambda p, k: {'p': p, 'k': -k})) AS o FROM p),
j AS (SELECT doc_id, text, o, list_transform(range(1, 7), lambda k: substr(text, CASE WHEN k = 1 THEN 1 ELSE o[k - 1].p + 1 END, CASE WHEN k = 6 THEN n ELSE o[k].p END - CASE WHEN k = 1 THEN 0 ELSE o[k - 1].p END)) AS parts FROM i)
SELECT doc_id, md5(parts[1] || list_reduce(list_transform(range(1, 6), lambda k: 'The secret k' || (-o[k].k - 1) || ' is v' || (-o[k].k - 1) || '. ' || parts[k + 1]), lambda a, b: a || b)) AS digest FROM j"""
)
def needle_insert(spark, d):
    secrets = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")).alias("key"), F.concat(F.lit("v"), i.cast("string")).alias("value")))
    text = F.col("text")
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(needles.insert(text, secrets, needles.insertion_points(text))).alias("digest"))


def needle_sets(spark, d) -> DataFrame:
    return needles.generate(spread(instances(spark, d)), multiplier=2)


@query()
def needle_generate(spark, d):
    g = needle_sets(spark, d)
    return g.select("_id", "questions", "answers", "question_depths", F.md5("context").alias("context_md5"), F.to_json("secrets").alias("secrets"))


@query()
def needle_validate(spark, d):
    return needles.validate(needle_sets(spark, d))


@query()
def needle_collisions(spark, d):
    return needles.collision_summary(needles.collisions(needle_sets(spark, d), "inline"))


FOLD = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"
LETTER_SQL = f"""SELECT conv_id, turn, coalesce(nullif(regexp_extract(u, '\\b([A-D])\\b', 1), ''), nullif(regexp_extract(u, '[(]([A-D])[)]', 1), ''),
nullif(regexp_extract(u, '(?:ANSWER|CHOICE|OPTION)[:\\s]*([A-D])', 1), ''), nullif(regexp_extract(u, '^([A-D])', 1), ''), '') AS letter
FROM (SELECT conv_id, turn, upper(regexp_replace({FOLD.format("text")}, '^\\s+|\\s+$', '', 'g')) AS u FROM conversations WHERE role = 'assistant')"""


@query(LETTER_SQL)
def answer_extract(spark, d):
    said = table(spark, d, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", A.answer_letter(T.fold_ascii(F.col("text"))).alias("letter"))


@query(
    f"SELECT conv_id, turn, contains(lower(t), 'the') AS found, length('Context:' || chr(10) || t || chr(10) || chr(10) || 'Q: ' || t) AS prompt_size FROM (SELECT conv_id, turn, {FOLD.format('text')} AS t FROM conversations WHERE text <> '')"
)
def needle_answers(spark, d):
    t = T.fold_ascii(F.col("text"))
    rows = table(spark, d, "conversations").where("text <> ''")
    return rows.select("conv_id", "turn", A.contains_answer(t, F.lit("the")).alias("found"), F.length(A.with_context(A.question_prompt(t, "Q: {question}"), t)).cast("long").alias("prompt_size"))


def boxes(spark, d) -> DataFrame:
    """documents as boxes: a page for every 40 lines, a box for each line."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unique_id"), F.split("text", "\n").alias("l"))
    box = lambda p, t, i: F.struct(F.lit(20).alias("x0"), (i * 12).alias("y0"), (F.lit(20) + F.length(t)).alias("x1"), (i * 12 + 10).alias("y1"), t.alias("text"))
    n = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 40).cast("int"))
    pages = F.transform(n, lambda p: F.transform(F.slice("l", p * 40 + 1, F.lit(40)), lambda t, i: box(p, t, i)))
    names = F.transform(n, lambda p: F.format_string("img/%s_page_%03d.png", F.col("unique_id").cast("string"), p + 1))
    return docs.select("unique_id", names.alias("image_paths"), pages.alias("bboxes"))


BOX_SQL = """WITH l AS (SELECT doc_id AS unique_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT unique_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS k FROM l),
x AS (SELECT unique_id, k // 40 AS page, k % 40 AS i, text FROM b) """


@query(
    BOX_SQL
    + "SELECT unique_id, (page + 1)::INTEGER AS page_no, min(20) AS x0, min(i * 12)::INTEGER AS y0, max(20 + length(text))::INTEGER AS x1, max(i * 12 + 10)::INTEGER AS y1, md5(string_agg(text, ' ' ORDER BY i)) AS digest FROM x GROUP BY unique_id, page"
)
def layout_giant_bbox(spark, d):
    p = boxes(spark, d).select("unique_id", F.posexplode("bboxes").alias("page", "b")).select("unique_id", "page", L.giant_box(F.col("b")).alias("g"))
    return p.select("unique_id", (F.col("page") + 1).alias("page_no"), "g.x0", "g.y0", "g.x1", "g.y1", F.md5("g.text").alias("digest"))


@query(
    BOX_SQL
    + """SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, CASE WHEN regexp_matches(text, '\\p{Lu}') AND NOT regexp_matches(text, '[\\p{Ll}\\p{Lt}]') AND length(text) < 50 THEN 'title'
WHEN text LIKE 'Figure%' OR text LIKE 'Table%' THEN 'figure_caption' ELSE 'text_block' END AS kind FROM x) GROUP BY kind"""
)
def layout_categories(spark, d):
    e = layout_stats.layout_documents(boxes(spark, d)).select(F.explode("layout_dets").alias("e"))
    return e.groupBy(F.col("e.category_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("e.text")).alias("chars"))


@query(
    BOX_SQL
    + ", t AS (SELECT count(DISTINCT unique_id) AS samples, count(DISTINCT (unique_id, page)) AS pages, count(*) AS boxes FROM x) SELECT *, round(pages / samples, 6) AS pages_per_sample, round(boxes / pages, 6) AS boxes_per_page FROM t"
)
def layout_totals(spark, d):
    return rounded(layout_stats.totals(boxes(spark, d)))


@query(BOX_SQL + "SELECT min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, round(avg(n), 6) AS mean, round(median(n)::DOUBLE, 6) AS median, round(quantile_cont(n, 0.95)::DOUBLE, 6) AS p95 FROM (SELECT length(text) AS n FROM x)")
def layout_lengths(spark, d):
    return rounded(layout_stats.text_lengths(boxes(spark, d)))


@query(BOX_SQL + "SELECT unique_id, count(*)::INTEGER AS boxes, count(DISTINCT page)::INTEGER AS pages, count(*) / count(DISTINCT page) AS boxes_per_page FROM x GROUP BY unique_id ORDER BY boxes DESC, unique_id LIMIT 10")
def layout_most_boxes(spark, d):
    return layout_stats.most_boxes(boxes(spark, d))


@query(BOX_SQL + "SELECT unique_id || '_page_' || lpad((page + 1)::VARCHAR, 3, '0') AS page_id, md5(string_agg(text, ' ' ORDER BY i) FILTER (WHERE text <> '')) AS digest FROM x GROUP BY unique_id, page HAVING count(*) FILTER (WHERE text <> '') > 0")
def identity_predictions(spark, d):
    p = layout_stats.identity_predictions(layout_stats.layout_documents(boxes(spark, d)))
    return p.where("text <> ''").select("page_id", F.md5("text").alias("digest"))


@query(
    f"WITH m AS (SELECT {LOOK_SQL} AS look) SELECT doc_id, md5({look_sql('text', 'doc_id', 6554)}) AS digest FROM documents, m"
)
def homoglyph(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(perturb.apply("homoglyph_substitution", F.col("text"), row_id=F.col("doc_id"))).alias("digest"))


@query("SELECT doc_id, md5('**' || text || '**') AS bold, md5('*' || text || '*') AS italic, md5('***' || text || '***') AS both FROM documents")
def font_weight(spark, d):
    w = lambda k: F.md5(perturb.apply("font_weight", F.col("text"), weight=k))
    return table(spark, d, "documents").select("doc_id", w("bold").alias("bold"), w("italic").alias("italic"), w("bold_italic").alias("both"))


@query("SELECT doc_id, CAST(greatest(6, 8) AS VARCHAR) AS font, CAST(trunc((doc_id % 30) * 0.8)::INTEGER AS VARCHAR) AS height, '72' AS dpi, 'adv_fontsize_' || (doc_id % 30) AS split FROM documents")
def layout_perturbations(spark, d):
    config = F.create_map(F.lit("line-height"), (F.col("doc_id") % 30).cast("string"), F.lit("font-size"), F.lit("9"))
    get = lambda c, k: F.element_at(c, k)
    return table(spark, d, "documents").select(
        "doc_id",
        get(perturb.apply("reduced_font_size", config), "font-size").alias("font"),
        get(perturb.apply("tighter_layout", config), "line-height").alias("height"),
        get(perturb.apply("dpi_downscale", config), "dpi").alias("dpi"),
        perturb.split_name(F.lit("dense_text"), font_size=(F.col("doc_id") % 30).cast("string")).alias("split"),
    )


@query(
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), ' +', ' ', 'g'), '^ +| +$', '', 'g')) AS plain, regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') AS cjk FROM documents"
)
def render_preclean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.get(L.pre_clean(F.col("text"), True), F.lit(0))).alias("plain"), L.has_cjk(F.col("text")).alias("cjk"))


@query(
    """WITH e AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '  ', chr(1) || chr(1), 'g'), chr(1) || ' ', chr(1) || chr(1), 'g') AS u FROM e),
p AS (SELECT doc_id, string_split(replace(u, chr(1), '&nbsp;'), chr(10)) AS l FROM b)
SELECT doc_id, coalesce((len(l) + 29) // 30, 0)::INTEGER AS n, md5(coalesce(array_to_string(l, '<br/>'), '')) AS digest FROM p"""
)
def paragraph_batches(spark, d):
    b = L.batches(L.pre_clean(F.col("text"), False))
    rows = table(spark, d, "documents").select("doc_id", b.alias("b"))
    return rows.select("doc_id", F.size("b").alias("n"), F.md5(F.array_join("b", "<br/>")).alias("digest"))


GROUNDED_SQL = "'<center>' || '\\[ ' || source || ' \\quad (' || lang || ') \\]' || substr(text, 1, 40) || '<|ref|>a<|/ref|><|det|>[[1,2]]<|/det|>' || chr(10) || chr(10) || chr(10) || text || '</center> '"


@query(
    f"""SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(regexp_replace(replace({GROUNDED_SQL}, '\\[ ' || source || ' \\quad (' || lang || ') \\]', '\\[' || source || '\\]'), '(?s)<\\|ref\\|>.*?<\\|/ref\\|><\\|det\\|>.*?<\\|/det\\|>', '', 'g'),
chr(10) || chr(10) || chr(10) || chr(10), chr(10) || chr(10)), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), '<center>', ''), '</center>', ''), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents"""
)
def ocr_clean(spark, d):
    formula = F.concat(F.lit("\\[ "), "source", F.lit(" \\quad ("), "lang", F.lit(") \\]"))
    t = F.concat(F.lit("<center>"), formula, F.substring("text", 1, 40), F.lit("<|ref|>a<|/ref|><|det|>[[1,2]]<|/det|>\n\n\n"), F.col("text"), F.lit("</center> "))
    return table(spark, d, "documents").select("doc_id", F.md5(ocr.clean_output(t)).alias("digest"))


def nested_sql(start: str, patterns) -> str:
    for p in patterns:
        start = f"regexp_replace({start}, {sql_text(p)}, '', 'g')"
    return start


LATEX_SQL = "'\\hspace{1em}\\textcolor{red}{' || coalesce(text, '') || '} \\rowcolor[gray]{.9} \\small x'"


@query(f"SELECT doc_id, md5({nested_sql(LATEX_SQL, T.LATEX_TABLE_PATTERNS)}) AS digest FROM documents")
def latex_table_norm(spark, d):
    t = F.concat(F.lit("\\hspace{1em}\\textcolor{red}{"), F.coalesce("text", F.lit("")), F.lit("} \\rowcolor[gray]{.9} \\small x"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise_latex_table(t)).alias("digest"))


def formula_sql() -> str:
    out = nested_sql(f"'\\mathbf{{x}}\\tag{{1}} = \\left(' || {FOLD.format('text')} || '\\right)'", T.FORMULA_PATTERNS)
    out = f"regexp_replace({out}, '^[.]+|[.]+$', '', 'g')"
    for x in T.FORMULA_DELETIONS:
        out = f"replace({out}, {sql_text(x)}, '')"
    return f"lower({out})"


@query(f"SELECT doc_id, md5({formula_sql()}) AS digest FROM documents")
def formula_norm(spark, d):
    t = F.concat(F.lit("\\mathbf{x}\\tag{1} = \\left("), T.fold_ascii(F.col("text")), F.lit("\\right)"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise_formula(t)).alias("digest"))


@query(f"SELECT doc_id, md5({NORM('text')}) AS digest FROM documents")
def text_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


@query(
    """SELECT page_id, CASE WHEN contains(replace(html, ' ', ''), '<table') THEN 1 ELSE 0 END AS tables, '<html><body><table border="1" ><tr><td>' || replace(url, '&', '&amp;') || '</td></tr></table></body></html>' AS url_table FROM pages"""
)
def html_table_totals(spark, d):
    """N7 over whole pages and urls: whether a page has a table, and a table around its url."""
    got = html_table_norm(spark, d)
    return got.select("page_id", F.when(F.col("table") != "", 1).otherwise(0).alias("tables"), "url_table")


@query()
def html_table_norm(spark, d):
    of_url = F.concat(F.lit("<table class=\"a\"><thead><tr><th>"), "url", F.lit("</th></tr></thead></table>"))
    return table(spark, d, "pages").select("page_id", T.normalise_html_table(F.col("html")).alias("table"), T.normalise_html_table(of_url).alias("url_table"))


@query()
def markdown_segments(spark, d):
    s = markdown.segment(table(spark, d, "documents").select("doc_id", "text"))  # of the texts as they are; markdown_of_lines has marks in them
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, '[[' || doc_id || ' 2] [3 4] [5 6] [7 8]]' AS printed, doc_id::DOUBLE AS x FROM documents")
def polygon_text(spark, d):
    printed = F.concat(F.lit("[["), F.col("doc_id").cast("string"), F.lit(" 2] [3 4] [5 6] [7 8]]"))
    return table(spark, d, "documents").select("doc_id", printed.alias("printed"), F.get(F.get(infer.polygon_of_text(printed), F.lit(0)), F.lit(0)).alias("x"))


@query(
    "WITH r AS (SELECT doc_id, doc_id / 7.0 AS a, doc_id / 5.0 AS b FROM documents) SELECT doc_id, round_even(a * 144 / 72.0, 0)::INTEGER AS x0, greatest(round_even(b * 144 / 72.0, 0)::INTEGER, round_even(a * 144 / 72.0, 0)::INTEGER + 1) AS x1 FROM r"
)
def pixel_boxes(spark, d):
    a, b = F.col("doc_id") / F.lit(7.0), F.col("doc_id") / F.lit(5.0)
    rows = table(spark, d, "documents").select("doc_id", L.to_pixels(a, a, b, b, 144.0).alias("p"))
    return rows.select("doc_id", "p.x0", "p.x1")


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(source, 'src[0-9]$') THEN 'clean' ELSE 'adv_fontsize_' || regexp_extract(source, '([0-9]+)$', 1) END AS truth FROM documents"
)
def truth_routing(spark, d):
    split = F.when(F.col("source").rlike("src[0-9]$"), F.col("source")).otherwise(F.concat(F.lit("adv_fontsize_"), F.regexp_extract("source", "([0-9]+)$", 1)))
    return table(spark, d, "documents").select("doc_id", joins.truth_split(split).alias("truth"))


@query("SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'de' THEN n END) AS de, max(CASE WHEN lang = 'fr' THEN n END) AS fr, max(CASE WHEN lang = 'es' THEN n END) AS es FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def model_comparison(spark, d):
    n = table(spark, d, "documents").groupBy("source", F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return joins.side_by_side(n, "source", ["en", "de", "fr", "es"], "n")


def grey_images(spark, d) -> DataFrame:
    """documents as grey images of 64 columns: a pixel for each byte of the text in ASCII, the rest of the last row black."""
    t = T.fold_ascii(F.col("text"))
    rows = spread(table(spark, d, "documents").where("coalesce(text, '') <> ''")).select("doc_id", t.alias("t"), F.ceil(F.length(t) / 64).cast("int").alias("height"))
    data = F.concat(F.transform(F.split("t", ""), lambda c: F.ascii(c)), F.array_repeat(F.lit(0), F.col("height") * 64 - F.length("t")))
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("image_id"), "height", F.lit(64).alias("width"), F.lit(1).alias("channels"), data.alias("data"))


@query()
def pixel_noise(spark, d):
    return images.random_noise(grey_images(spark, d)).select("image_id", "status", F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT doc_id, list_sum(list_transform(string_split(t, ''), lambda c: CASE WHEN ascii(c) > 100 THEN 255 ELSE 0 END))::BIGINT AS total FROM (SELECT doc_id, {FOLD.format('text')} AS t FROM documents WHERE coalesce(text, '') <> '')")
def pixel_threshold(spark, d):
    """I4, I10."""
    black = perturb.apply("binarization_thresholding", F.col("data"), threshold=100)
    return grey_images(spark, d).select("doc_id", F.aggregate(black, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT doc_id::VARCHAR AS image_id, 'success' AS status, trunc(((length(t) + 63) // 64) * 0.5)::INTEGER AS height, 32 AS width FROM (SELECT doc_id, {FOLD.format('text')} AS t FROM documents WHERE length(text) > 64)")
def resampled(spark, d):
    """Half the size by bilinear resampling."""
    own = grey_images(spark, d).where("height > 1")
    return images.resample(own, "bilinear", 0.5).select("image_id", "status", "height", "width")


@query()
def blurred(spark, d):
    """A blur keeps the mean, about."""
    return images.blur(grey_images(spark, d)).select("image_id", "status", F.size("data").alias("pixels"))


@query("SELECT doc_id::VARCHAR AS image_id, (6 + n_chars % 50)::INTEGER AS width, (5 + n_chars % 5)::INTEGER AS height FROM documents WHERE n_chars IS NOT NULL")
def cropped(spark, d):
    """White images with a dark block as long and high as the text's length says, cut two pixels behind it."""
    n = F.col("n_chars")

    def pixel(p):
        row, col = F.floor(p / 64), p % 64
        return F.when((row >= 2) & (row < 4 + n % 5) & (col >= 2) & (col < 4 + n % 50), 0).otherwise(255)

    data = F.transform(F.sequence(F.lit(0), F.lit(12 * 64 - 1)), pixel)
    rows = table(spark, d, "documents").where("n_chars is not null").select(F.col("doc_id").cast("string").alias("image_id"), F.lit(12).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return images.adaptive_crop(rows, 2, 2).select("image_id", "width", "height")


from pagewright import record_queries  # noqa: E402, F401  registers its queries
