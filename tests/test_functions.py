import pytest
from pyspark.sql import functions as F

from pagewright.functions import answers as A
from pagewright.functions import layout as L
from pagewright.functions import markdown, metrics, ocr, perturb
from pagewright.functions import text as T

FENCE = "`" * 3


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.drop_fences, f"{FENCE}markdown\nHello\n{FENCE}\n", "Hello\n"),
        (T.limit_repeats, "______", "____"),
        (T.half_width, "ＡＢＣ　1！", "ABC 1!"),
        (T.clean, "  a \t\n b ", "a b"),
        (T.normalise_formula, r"$$\mathbf{X} = \left( a \right).$$", "{x}=(a)"),
        (T.normalise_formula, r"see \[ a + \tag{1} b \] end", "a+b"),
        (T.normalise_latex_table, r"\textcolor{red}{x}", r"\text"),
        (T.normalise_latex_table, r"\color{red}y", r"\y"),
        (T.normalise_html_table, "no table", ""),
        (T.normalise_html_table, '<table class="a"><thead><tr><th>x<span>y</span></th></tr></thead></table>', '<html><body><table border="1" ><tr><td>xy</td></tr></table></body></html>'),
        (T.normalise_html_table, "<table><tr><td>a&ref=b &copy; &#65; &lt;</td></tr></table>", '<html><body><table border="1" ><tr><td>a&amp;ref=b © A &lt;</td></tr></table></body></html>'),
        (T.nfkc, "ﬁ①", "fi1"),
        (T.count_words, "Hello, world! -- () 'x'", 4),
        (T.count_words, "", 0),
        (T.fold_ascii, "café", "caf?"),
        (A.after_thinking, "<think>q</think> B ", "B"),
        (A.after_thinking, "  B ", "  B "),
        (A.answer_letter, "The answer is B", "B"),
        (A.answer_letter, "(C)", "C"),
        (A.answer_letter, "I think a cat", "A"),
        (A.answer_letter, "Because", "B"),
        (A.answer_letter, "OPTIONAL", "A"),
        (A.answer_letter, "none", ""),
        (ocr.clean_output, "a\n\n\n\n\nb", "a\n\nb"),
        (ocr.clean_output, "a" + "\n" * 7 + "b", "a\n\n\n\nb"),
        (ocr.clean_output, "<center>a</center><|ref|>x\n<|/ref|><|det|>[1]<|/det|>", "a"),
        (ocr.clean_formulas, r"x \[ a \quad (1) \] y", r"x \[a\] y"),
        (L.category, "ABSTRACT", "title"),
        (L.category, "FIGURE 1", "title"),
        (L.category, "Figure 1: x", "figure_caption"),
        (L.category, "123", "text_block"),
        (L.category, "Text", "text_block"),
        (L.stem, "a/b/x_page_001.png", "x_page_001"),
        (markdown.inline, "a **b** `c<d` [t](u) _i_", 'a <b>b</b> <font name="Courier">c&lt;d</font> t <i>i</i>'),
        (perturb.font_weight, "x", "**x**"),
    ],
)
def test_scalar(one, f, given, want):
    assert one(f(F.col("x")), x=given) == want


def test_token_bins(one):
    got = [one(T.token_bin(F.lit(n))) for n in (7999, 8000, 31999, 32000, 63999, 64000)]
    assert got == ["<8k", "8k-16k", "24k-32k", "32k-48k", "48k-64k", ">=64k"]


@pytest.mark.parametrize(
    ("gt", "pred", "want"),
    [("kitten", "sitting", 42.857142857142854), ("abc", "abcd", 25.0), ("abc", "", 100.0), ("", "x", 100.0), ("", "", 0.0), ("café", "cafe", 25.0), ("a" * 5000, "a" * 4999 + "b", 0.02)],
)
def test_cer(one, gt, pred, want):
    assert one(metrics.cer(F.col("p"), F.col("g")), p=pred, g=gt) == pytest.approx(want)


def test_edit_distance_against_the_built_in(spark):
    import random

    r = random.Random(2)
    rows = [("".join(r.choices("abé ", k=r.randint(0, 40))), "".join(r.choices("abé ", k=r.randint(0, 40)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(metrics.distance("a", "b") != F.levenshtein("a", "b")).count() == 0


def test_bleu():
    assert metrics.bleu_of("a b c d e", "a b c d e") == pytest.approx(100)
    assert metrics.bleu_of("a", "a") == pytest.approx(100)
    assert metrics.bleu_of("x", "") == 0
    assert metrics.bleu_of("", "x") == 0
    # 4 of 5, 3 of 4, 2 of 3 and 1 of 2 n-grams.
    assert metrics.bleu_of("a b c d x", "a b c d e") == pytest.approx(100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    assert metrics.tokens_13a("Hello, world 3.5-4") == ["Hello", ",", "world", "3.5", "-", "4"]


def test_checks(one):
    assert one(A.choice_correct(F.lit("none"), F.lit("")))
    assert one(A.contains_answer(F.lit("1428"), F.lit("42")))
    assert not one(A.contains_answer(F.lit("ab"), F.lit("A"), case_sensitive=True))


def test_prompts(one):
    choices = A.choice_map(F.lit("x"), F.lit("y"), F.lit(None).cast("string"), F.lit("z"))
    assert one(A.choice_prompt(F.lit("Q?"), choices)) == "Q?\n\nA. x\nB. y\nC. \nD. z\n\n"
    assert one(A.choice_prompt(F.lit("Q?"), choices, "{choices}|{question}")).endswith("|Q?")
    assert one(A.with_context(F.lit("p"), F.lit("c"))) == "Context:\nc\n\np"
    assert one(A.with_context(F.lit("p"), F.lit(""))) == "p"
    with pytest.raises(KeyError):
        A.question_prompt(F.lit("q"), "{question} {choices}")


def test_boxes(one):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1", "text"), strict=True)])
    assert one(L.polygon(box(1, 2, 3, 4, ""))) == [1, 2, 3, 2, 3, 4, 1, 4]
    assert tuple(one(L.giant_box(F.array(box(10, 20, 30, 40, "a"), box(5, 25, 50, 60, "b"))))) == (5, 20, 50, 60, "a b")
    assert tuple(one(L.giant_box(F.slice(F.array(box(1, 1, 1, 1, "a")), 1, 0)))) == (0, 0, 0, 0, "")
    assert tuple(one(L.to_pixels(*map(F.lit, (2.5, 3.5, 2.5, 9.0)), dpi=72.0))) == (2, 4, 3, 9)
    assert one(L.to_pixels(F.lit(float("nan")), *map(F.lit, (3.5, 2.5, 9.0)), dpi=72.0)) is None


def test_pre_clean(one):
    assert one(L.pre_clean(F.lit(" a\n\nb­  c "), True)) == ["a b c"]
    assert one(L.pre_clean(F.lit("a  b<\nc d"), False)) == ["a&nbsp;&nbsp;b&lt;", "c d"]
    assert one(L.batches(F.array(*map(F.lit, "abc")), 2)) == ["a<br/>b", "c"]
    assert one(L.has_cjk(F.lit("x中"))) and not one(L.has_cjk(F.lit("x")))


def test_settings(one):
    config = F.create_map(*map(F.lit, ("line-height", "12", "font-size", "9")))
    empty = F.create_map().cast("map<string,string>")
    assert one(perturb.apply("reduced_font_size", config, font_size=4))["font-size"] == "6"
    assert one(perturb.apply("tighter_layout", config))["line-height"] == "9"
    assert one(perturb.apply("tighter_layout", empty))["line-height"] == "9"
    assert one(perturb.apply("line_height_compression", F.create_map(F.lit("line-height"), F.lit("10"))))["line-height"] == "8.0"
    assert one(perturb.apply("line_height_compression", empty)) == {}
    assert one(perturb.dense_text(config, 7)) == {"font-size": "7", "line-height": "8"}
    assert one(perturb.split_name(F.lit("jpeg_compression"))) == "adv_jpeg"
    assert one(L.merge_config(config, F.create_map(F.lit("font-size"), F.lit("5")))) == {"line-height": "12", "font-size": "5"}
    with pytest.raises(ValueError, match="unknown perturbation"):
        perturb.apply("nothing", config)


def test_look_alikes(one):
    assert one(perturb.look_alike(F.lit("nu"), F.lit(1), 1.0)) == "rili"
    assert one(perturb.look_alike(F.lit("nu"), F.lit(1), 0.0)) == "nu"
    assert one(perturb.look_alike(F.lit(""), F.lit(1), 1.0)) == ""


def test_typed_values(one):
    assert [tuple(one(perturb.typed_value(F.lit(x)))) for x in ("3", "0.5", "abc")] == [(3, None, None), (None, 0.5, None), (None, None, "abc")]


def test_markdown_segments(spark):
    text = f"# Title\none\ntwo\n\n> quote\n- item\n---\n{FENCE}\ncode\n{FENCE}\nlast\n{FENCE}\nlost"
    rows = markdown.segment(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("seq").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [
        ("heading", "Title"),
        ("paragraph", "one two"),
        ("quote", "quote"),
        ("item", "- item"),
        ("rule", ""),
        ("code", "code"),
        ("paragraph", "last"),
    ]


def test_images(spark):
    import numpy as np

    from pagewright.functions import images as I

    assert I.resize(np.arange(101 * 51).reshape(51, 101) % 256, 50, 25, "bilinear").shape == (25, 50)
    flat = np.full((6, 6), 7)
    for method in ("nearest", "bilinear", "bicubic", "lanczos"):
        assert (I.resize(flat, 3, 9, method) == 7).all()
    assert (I.gaussian_blur(flat, 1.0) == 7).all()
    page = np.full((10, 10), 255)
    page[4, 5] = 0
    assert I.crop(page, 1, 2, True, True).shape == (6, 7)
    rows = spark.createDataFrame([("a", 2, 2, 1, [0, 100, 200, 255]), ("bad", 3, 3, 1, [1])], "image_id string, height int, width int, channels int, data array<int>")
    got = {r["image_id"]: r for r in I.random_noise(rows, "salt_and_pepper", 1.0).collect()}
    assert set(got["a"]["data"]) <= {0, 255} and got["a"]["status"] == "success"
    assert got["bad"]["status"] == "error"
    again = {r["image_id"]: r for r in I.random_noise(rows.repartition(3), "salt_and_pepper", 1.0).collect()}
    assert again["a"]["data"] == got["a"]["data"]


def test_png_round_trip_and_overlay():
    import numpy as np

    from pagewright.functions import png

    r = np.random.default_rng(4)
    for shape in ((5, 7), (6, 4, 3), (3, 3, 4), (1, 1)):
        a = r.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(a)) == a).all()
    # Each of the five filters, by hand, on two rows of grey pixels.
    for kind, second in ((0, [9, 8, 7]), (1, [9, 255, 255]), (2, [8, 6, 4]), (3, [9 - 0, 8 - 5, 7 - 5]), (4, [8, 255, 255])):
        rows = np.array([[0, 1, 2, 3], [kind, *second]], np.uint8)
        assert png._unfiltered(rows, 1)[1].tolist() == [9, 8, 7], kind
    white = np.full((20, 30), 255, np.uint8)
    drawn = png.overlay(white, [(2, 3, 10, 12), (-5, 0, 40, 19)])
    assert drawn[3, 5].tolist() == [0, 0, 0] and drawn[12, 10].tolist() == [0, 0, 0] and drawn[0, 5].tolist() == [1, 3, 5]
    assert (png.overlay(white, []) == 255).all() and len({png.colour(i) for i in range(12)}) == 6
    assert (png.overlay(white, [(2, 3, 10, 12)] * 51)[5:11, 4:9] == 255).all()  # no numbers on so many boxes


def test_page_boxes(spark):
    rows = spark.sql("""SELECT array(array(named_struct('x0', 1D, 'y0', 2D, 'x1', 3D, 'y1', 4D, 'text', 'a'), named_struct('x0', 0D, 'y0', 3D, 'x1', 9.6D, 'y1', 3.5D, 'text', 'b '),
        named_struct('x0', double('nan'), 'y0', 0D, 'x1', 1D, 'y1', 1D, 'text', 'c'), named_struct('x0', 0D, 'y0', 0D, 'x1', 90D, 'y1', 90D, 'text', ' ')),
        array(named_struct('x0', double('inf'), 'y0', 0D, 'x1', 1D, 'y1', 1D, 'text', 'd')), array(named_struct('x0', -4D, 'y0', -4D, 'x1', -2D, 'y1', 0.2D, 'text', ' e '))) AS l""")
    got = rows.select(L.line_boxes(F.col("l"), 144.0).alias("b"), L.word_boxes(F.flatten("l"), 144.0).alias("w")).first()
    assert [tuple(x) for x in got["b"]] == [(0, 4, 19, 8, "a b c"), (0, 0, 1, 1, "e")]
    assert [x["text"] for x in got["w"]] == ["a", "b", "e"] and tuple(got["w"][0])[:4] == (2, 4, 6, 8)


def test_markdown_of_several_rows(spark):
    text = "a\n```\nx\n\n```\nb\n# H  \n> q\n  - i\n***\n\nc\n```\nlost"
    df = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None)], "id int, text string")
    rows = markdown.segment(df).orderBy("id", "seq").collect()
    want = [("code", 0, "x\n"), ("paragraph", 0, "a b"), ("heading", 1, "H"), ("quote", 0, "q"), ("item", 2, "- i"), ("rule", 0, ""), ("paragraph", 0, "c")]
    for i in (1, 2):
        assert [(r["kind"], r["level"], r["text"]) for r in rows if r["id"] == i] == want
    assert [r["seq"] for r in rows if r["id"] == 2] == list(range(7)) and len(rows) == 14


def test_longest_with_many_ties(spark):
    from pagewright.operators import select

    rows = spark.createDataFrame([(f"{i:03d}", "a b" if i % 3 else "a b c") for i in range(90)], "_id string, t string")
    got = sorted(r["_id"] for r in select.longest_texts(rows, "_id", F.col("t"), 50.0).collect())
    best = sorted(range(90), key=lambda i: (i % 3 != 0, i))[:45]
    assert got == sorted(f"{i:03d}" for i in best)
    assert select.longest_texts(rows, "_id", F.col("t"), 0.0).count() == 0 and select.longest_texts(rows, "_id", F.col("t"), 100.0).count() == 90


def test_answers_beyond_ascii(one):
    assert one(A.answer_letter(F.col("x")), x="\u00e9t\u00e9\uff08C\uff09") == "C"
    assert one(A.answer_letter(F.col("x")), x="\u3000b") == "B"
    assert one(T.clean(F.col("x")), x="\u00a0a\u2003\u2003b\u3000") == "a b"


def test_token_counts_are_the_library_s(spark):
    import base64

    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello, world", "\u00fcber \u4f60\u597d " * 50]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.token_counter(path, public_tokenizers.PATTERN)("t").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(library.encode_ordinary(t or "")) for i, t in enumerate(texts)}
