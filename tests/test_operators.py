import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import BIN_NAMES
from pagewright.operators import infer, joins, layout_stats, needles, scoring, select, slices
from pagewright.plans import jobs

TEXT = "A b. C d!  E\n\nF"


def ids(df):
    return sorted(r[0] for r in df.collect())


def secrets():
    return F.array(*[F.struct(F.lit(f"k{i}").alias("key"), F.lit(f"v{i}").alias("value")) for i in range(5)])


def test_sentence_ends_and_points(one):
    assert one(needles.sentence_ends(F.lit(TEXT))) == [5, 11, 14]
    assert one(needles.insertion_points(F.lit(TEXT))) == [5, 5, 5, 11, 14]
    assert one(needles.insertion_points(F.lit("abcdefghij"))) == [1, 3, 5, 7, 9]
    assert one(needles.sentence_ends(F.lit(""))) == []


def test_insert(one):
    want = "A b. The secret k2 is v2. The secret k1 is v1. The secret k0 is v0. C d!  The secret k3 is v3. E\n\nThe secret k4 is v4. F"
    made = one(needles.insert(F.lit(TEXT), secrets(), needles.insertion_points(F.lit(TEXT))))
    assert made == want
    found = one(needles.find_needles(F.lit(made)))
    assert [(x["key"], x["at"]) for x in found] == [("k2", 5), ("k1", 26), ("k0", 47), ("k3", 74), ("k4", 98)]
    assert [one(needles.depth(F.lit(p), F.lit(15))) for p in (5, 11, 14)] == ["20-40%", "60-80%", "80-100%"]


def test_validation(spark):
    made = spark.range(1).select(F.lit("a").alias("_id"), needles.insert(F.lit(TEXT), secrets(), needles.insertion_points(F.lit(TEXT))).alias("context"), secrets().alias("secrets"))
    row = needles.validate(made).first()
    assert not row["valid"] and "Region 20-40%: 2 secrets found" in row["message"] and "Region 40-60%: NO secrets found" in row["message"]
    legacy = needles.collisions(made).first()
    assert not legacy["clean"] and len(legacy["issues"]) == 10
    assert needles.collisions(made, "inline").first()["clean"]
    summed = needles.collision_summary(needles.collisions(made)).first()
    assert (summed["clean"], summed["with_issues"], summed["key_issues"], summed["value_issues"]) == (0, 1, 5, 5)


def test_generate(spark):
    long = " ".join(f"Sentence {i} stands here." for i in range(100))
    rows = spark.createDataFrame([("a", long), ("b", long + " More."), (None, long), ("c", "")], "_id string, context string")
    made = needles.generate(rows, multiplier=2)
    got = {r["_id"]: r for r in made.collect()}
    assert set(got) == {"a", "b"}
    for r in got.values():
        stripped = r["context"]
        for s in r["secrets"]:
            assert s["value"] in needles.FACTS[s["key"]]
            stripped = stripped.replace(f"The secret {s['key']} is {s['value']}. ", "")
        assert stripped in (long, long + " More.") and len(r["questions"]) == 2
    assert ids(needles.validate(made).where("valid").select("_id")) == ["a", "b"]
    assert {r["_id"]: r["context"] for r in needles.generate(rows.repartition(3), multiplier=2).collect()} == {k: v["context"] for k, v in got.items()}
    assert needles.generate(rows, multiplier=6).count() == 0
    seeded = needles.generate_seeded(rows, 1, seed=3)
    assert seeded.count() == 2 and ids(needles.validate(seeded).where("valid").select("_id")) == ["a", "b"]


def test_question_depth(spark):
    rows = spark.createDataFrame([(["0-20%"], 0, "q"), ([], 0, "the secret k1?"), ([], 0, "none")], "d array<string>, i int, q string")
    text = F.lit("x" * 50 + "The secret k1 is v1. " + "x" * 29)
    got = rows.select(needles.question_depth(F.col("d"), F.col("i"), F.col("q"), secrets(), text).alias("v"), "q").collect()
    assert {r["q"]: r["v"] for r in got} == {"q": "0-20%", "the secret k1?": "40-60%", "none": "unknown"}


def test_coverage_and_scores(spark):
    gt = spark.createDataFrame([("a", "x"), ("b", "abc")], "page_id string, text string")
    pred = spark.createDataFrame([("b", "abd"), ("c", "y")], "page_id string, text string")
    assert ids(joins.missing(gt, pred, ["page_id"])) == ["a"]
    assert ids(joins.missing(pred, gt, ["page_id"])) == ["c"]
    pages, summed = scoring.evaluate(pred, gt)
    assert [(r["page_id"], round(r["cer"], 3)) for r in pages.collect()] == [("b", 33.333)]
    assert summed.first()["cer_count"] == 1
    two = spark.createDataFrame([(0.0,), (10.0,)], "cer double")
    assert tuple(scoring.summary(two, ["cer"]).first()) == (5.0, 5.0, 0.0, 10.0, 2)
    splits = pred.withColumn("split", F.lit("adv_fontsize_7"))
    truth = gt.withColumn("split", F.lit("adv_fontsize_7"))
    assert jobs.evaluate_splits(splits, truth)[1].first()["cer_count"] == 1


def test_joins(spark, one):
    assert [one(joins.truth_split(F.lit(s))) for s in ("adv_fontsize_7", "adv_dpi_56")] == ["adv_fontsize_7", "clean"]
    q = spark.createDataFrame([("i", ["q1", "q2"], ["x"]), ("j", [], ["x"])], "_id string, questions array<string>, answers array<string>")
    assert [(r["question"], r["answer"]) for r in joins.question_rows(q).collect()] == [("q1", "x")]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, s int, v string")
    assert sorted((r["k"], r["v"]) for r in joins.last_of_key(rows, ["k"], "s").collect()) == [("a", "y"), ("b", "z")]
    files = spark.createDataFrame([("a_page_002.png",), ("a_page_001.png",), ("c_page_001.png",)], "name string")
    inst = spark.createDataFrame([("a",), ("b",)], "_id string")
    assert [tuple(r) for r in joins.pages_of(inst, files).collect()] == [("a", ["a_page_001.png", "a_page_002.png"])]
    n = joins.numbered(spark.range(100).repartition(7), "id").orderBy("id").collect()
    assert [r["row"] for r in n] == list(range(100))
    assert one(joins.nearest(F.array(F.lit(3), F.lit(7)), F.lit(5))) == 3
    assert one(joins.split_of(F.lit("/x/adv_dpi_56/images/a.png"))) == "adv_dpi_56"


def test_selection(spark, one):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    black = spark.createDataFrame([("a",)], "x string")
    assert ids(select.exclude_then_limit(rows, black, "id", 2, "id")) == ["b", "c"]
    assert ids(select.limit_then_exclude(rows, black, "id", 2, "id")) == ["b"]
    assert ids(select.first_rows(rows, 0, "id")) == ["a", "b", "c"]
    nulls = spark.createDataFrame([(None,), ("a",)], "id string")
    assert [r[0] for r in select.excluded(nulls, black, "id").collect()] == [None]
    texts = spark.createDataFrame([(i, "w " * (i % 3 + 1)) for i in range(10)] + [(10, "")], "_id int, text string")
    assert ids(select.longest_texts(texts, "_id", F.col("text"))) == [2, 5]
    known = spark.createDataFrame([(9,)], "_id int")
    assert ids(select.longest_texts(texts, "_id", F.col("text"), known=known)) == [2, 5, 9]
    domains = texts.withColumn("domain", F.when(F.col("_id") == 0, "d").otherwise("e"))
    assert ids(select.domain_or_longest(domains, "_id", F.col("text"), "d", 25.0)) == [0, 2, 5]
    assert select.domain_or_longest(domains, "_id", F.col("text"), "none", 25.0).count() == 0
    assert one(select.short_name(F.lit("Long Synthetic"), F.lit("0123456789"))) == "d4_01234567"
    assert one(select.short_name(F.lit("other"), F.lit("ab"))) == "dx_ab"
    assert one(select.task_path(F.lit("./data/x/y"), F.lit("t"))) == "./data/t/x/y"
    assert one(select.task_path(F.lit("./x"), F.lit("t"))) == "./x"
    inst = spark.createDataFrame([("1", "c", "d"), ("2", None, select.LEFT_OUT_DOMAIN), ("3", "c", select.LEFT_OUT_DOMAIN)], "_id string, context string, domain string")
    assert ids(select.final_exclusions(inst, F.lit(1))) == ["3"]
    assert tuple(select.exclusion_breakdown(inst, F.lit(64001)).first()) == (2, 1, 2, 1)


def test_slices(spark):
    rows = spark.createDataFrame([("success", True), ("success", True), ("success", False), ("error", False)], "status string, correct boolean")
    assert tuple(slices.overall(rows).first()) == (4, 2, 1, 1, 50.0)
    assert slices.overall(rows.limit(0)).first()["accuracy"] == 0
    levels = spark.createDataFrame([("easy", "short", True), ("easy", "long", False)], "difficulty string, length string, correct boolean")
    got = {(r["difficulty"], r["length"]): (r["total"], r["accuracy"]) for r in slices.by_difficulty_and_length(levels).collect()}
    assert len(got) == 15 and got["easy", None] == (2, 50.0) and got["easy", "short"] == (1, 100.0) and got["hard", "medium"] == (0, None)
    binned = spark.createDataFrame([("<8k", True)], "context_bin string, correct boolean")
    assert slices.by_axis(binned, "context_bin").count() == len(BIN_NAMES)
    tasks = spark.createDataFrame([("a", "existing"), ("a", "failed"), ("b", "completed")], "split string, state string")
    assert {r["split"]: (r["total"], r["new"], r["failed"]) for r in slices.progress(tasks).collect()} == {"a": (2, 1, 1), "b": (1, 1, 0), None: (3, 2, 1)}


def lines(spark):
    box = lambda n: (0, 0, 1, 1, "x" * n)
    schema = "unique_id string, image_paths array<string>, bboxes array<array<struct<x0:int,y0:int,x1:int,y1:int,text:string>>>"
    return spark.createDataFrame([("a", ["p/a_page_001.png"], [[box(1), box(2)], [box(3), box(10)]]), ("b", None, None)], schema)


def test_layout(spark):
    rows = lines(spark)
    assert tuple(layout_stats.totals(rows).first()) == (2, 2, 4, 1.0, 2.0)
    t = layout_stats.text_lengths(rows).first()
    assert (t["median"], round(t["p95"], 6)) == (2.5, 8.95)
    assert tuple(layout_stats.text_lengths(rows.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert [r["unique_id"] for r in layout_stats.most_boxes(rows, 1).collect()] == ["a"]
    docs = layout_stats.layout_documents(rows).collect()
    assert [len(d["layout_dets"]) for d in docs] == [2, 2] and docs[0]["page_info"]["image_path"] == "a_page_001.png"
    texts = layout_stats.identity_predictions(layout_stats.layout_documents(rows)).collect()
    assert sorted(tuple(r) for r in texts) == [("a_page_001", "x xx"), ("a_page_002", "xxx " + "x" * 10)]
    truth = layout_stats.layout_documents(rows, concatenate=True)
    pred = layout_stats.identity_predictions(truth)
    assert scoring.score_pages(pred, pred).where("cer <> 0").count() == 0
    assert layout_stats.first_pages(rows, 1).first()["bboxes"][0][0]["text"] == "x"


def make_stub():
    def stub():  # nested, so that it goes to workers by value
        def client(prompt, images, options):
            if "fail" in prompt:
                raise ConnectionError("no server")
            if "bad" in prompt:
                raise ValueError("bad")
            return f"<think>x</think> The answer is B {len(images)}"

        return client

    return stub


def test_inference(spark):
    stub = make_stub()
    rows = spark.createDataFrame(
        [("1", "ok", "B"), ("2", "fail", "B"), ("3", "bad", "A")], "_id string, question string, answer string"
    ).select("*", *[F.lit(c).alias(f"choice_{c}") for c in "ABCD"], F.lit("ctx").alias("context"), F.array(F.lit(b"x")).alias("images"))
    got = {r["instance_id"]: r for r in infer.choice_results(rows, stub).collect()}
    assert got["1"]["correct"] and got["1"]["num_images"] == 1 and got["1"]["extracted_answer"] == "B"
    assert (got["2"]["status"], got["3"]["status"]) == ("connection_error", "error")
    only = {r["instance_id"]: r for r in infer.choice_results(rows, stub, text_only=True).collect()}
    assert only["1"]["prompt"].startswith("Context:\nctx") and only["1"]["num_images"] == 0
    q = rows.select("_id", F.lit(0).alias("question_idx"), "question", F.lit("answer").alias("answer"), "images")
    assert {r["instance_id"]: r["correct"] for r in infer.needle_results(q, stub).collect()} == {"1": True, "2": False, "3": False}
    pages = spark.createDataFrame([("s", "p", b"x")], "split string, page_id string, content binary")
    assert infer.page_texts(pages, stub, "read", "glyph-1").first()["text"] == "The answer is B 1"


def test_recognised_items(spark, one):
    assert one(infer.polygon_of_text(F.lit("[[14 16]\n [20 16]\n [20 30]\n [14 30]]"))) == [[14, 16], [20, 16], [20, 30], [14, 30]]
    assert one(infer.polygon_of_text(F.lit("[1 2]"))) is None
    raw = spark.createDataFrame([("d/a.png", [["x ", " "], ["y"]], [[[[0.0, 1.0]], [[2.0, 3.0]]], [[[4.0, 5.0]]]])], "image_path string, word_texts array<array<string>>, word_boxes array<array<array<array<double>>>>")
    r = infer.word_items(raw).first()
    assert (r["image_name"], r["texts"], r["item_count"], r["confidences"]) == ("a.png", ["x", "y"], 2, [1.0, 1.0])
    assert tuple(infer.item_totals(infer.word_items(raw)).first()) == (1, 2, 2.0)
    assert one(infer.first_option(None, 0.5)) == 0.5


def test_render_plan_and_renderer(spark):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", "z"), (None, "q"), ("c", "w")], "_id string, context string")
    done, black = spark.createDataFrame([("b",)], "unique_id string"), spark.createDataFrame([("c",)], "id string")
    plan = jobs.render_plan(rows, done, black)
    assert [r["unique_id"] for r in plan.collect()] == ["a"]

    def maker():
        return lambda uid, parts, settings: [(b"png", [(0, 0, 1, 1, p)]) for p in parts]

    drawn = jobs.render(plan, maker, {})
    assert [tuple(r) for r in jobs.line_rows(drawn).select("unique_id", "image_paths").collect()] == [("a", ["a_page_001.png"])]


def test_reports(spark):
    inst = spark.createDataFrame([("a", "easy", "short", "x" * 100)], "_id string, difficulty string, length string, context string")
    results = spark.createDataFrame([("a", True, "success")], "instance_id string, correct boolean, status string")
    report = jobs.choice_report(results, inst)
    assert report["context"].where("total = 1").first()["context_bin"] == "<8k"
    assert report["levels"].where("difficulty = 'easy' and length = 'short'").first()["accuracy"] == 100
    with pytest.raises(ValueError, match="unknown format"):
        from pagewright.sources import sinks

        sinks.items(inst, "/nowhere", "xml")
