import pickle
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import ann, html_extract, langid

SOUNDS = {"aa": "kalo mite suna rako", "bb": "schu pfer ling tzau", "cc": "ção nhel eira mento"}


def speech(r, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def test_language(docs):
    r = random.Random(1)
    rows = [(i, speech(r, lang, 40), lang) for i, lang in enumerate(list(SOUNDS) * 40)]
    table = docs(rows)
    model = langid.fit(table.where(~langid.held_out()))
    assert model.langs == sorted(SOUNDS)
    got = {x["doc_id"]: x for x in langid.predict(table, model, [F.col("doc_id"), langid.held_out().alias("held_out")]).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert held and all(p == lang for p, lang in held) and all(0 <= x["score"] <= 1 for x in got.values())
    odd = {x["doc_id"]: x for x in langid.predict(docs([(1, None), (2, ""), (3, "12 !?"), (4, "schupfer " * 20000), (5, "çãonhel eiraxx mentonhel")]), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "bb", "cc"] and odd[1]["score"] == 0
    none = langid.fit(docs([(1, "x", None)]).withColumn("lang", F.lit(None).cast("string")))
    assert {x["lang_pred"] for x in langid.predict(docs([(1, "hello")]), none).collect()} == {"und"}
    assert langid.predict(docs([]), model).count() == 0


def test_backoff_prefers_words_then_longer_parts():
    model = langid.Model(["a", "b"], {"word": np.array([-1.0, -5.0])}, {"wor": np.array([-5.0, -1.0]), "w": np.array([-2.0, -2.0])}, 3, -16.0)
    s = langid.Scorer(model)
    assert s.word("word").argmax() == 0 and s.word("worx").argmax() == 1


def test_language_model_takes_little_memory():
    rng = np.random.default_rng(1)
    words = {f"word{i}": rng.random(4).astype(np.float32) for i in range(20_000)}
    model = langid.Model(list("abcd"), words, {x[:k]: v for x, v in words.items() for k in (1, 2, 3)}, 3, -16.0)
    plain, small = langid.Scorer(model), langid.Scorer(langid.packed(model))
    texts = ["word7 unseen wor", "", "x word19999"]
    for a, b in zip(plain.texts(texts), small.texts(texts), strict=True):
        assert list(a) == list(b)

    def taken(make):
        tracemalloc.start()
        kept = pickle.loads(pickle.dumps(make))
        size = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        return size, kept

    assert taken(langid.packed(model))[0] < 0.7 * taken(model)[0]
    assert langid.packed(langid.Model([], {}, {}, 5, -1.0)).words.get("x") is None


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>m</a></li></ul></nav>"
    "<div class='ad'>buy</div>{body}<footer>&copy; f</footer></body></html>"
)


def page(body):
    return PAGE.format(body=body)


def test_html(spark):
    article = "<article><h1>Head &amp; x</h1><p><b>One\n two<br><p>three&nbsp;four</p><div class='newsletter'>join</div><script>if(a<b){}</script><aside>s</aside></article><div class='comments'><article class='comment'>c</article></div>"
    plain = "<div id='content'><p>Only {0} text here that is long enough to weigh, number {0}.</p></div><div class='x'>Same everywhere</div>"
    rows = [(1, "http://a.org/1", page(article)), (2, "http://a.org/2", None), (3, None, "<p>bare"), (4, "http://a.org/2", ""), (4, "http://a.org/2", "")]
    rows += [(10 + i, "https://b.org/q", page(plain.format(i))) for i in range(6)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(table).collect()}
    assert got[1]["text"] == "Head & x\nOne two\nthree four" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["text"] == "bare" and got[4]["text"] == ""
    assert [got[10 + i]["text"] for i in range(6)] == [f"Only {i} text here that is long enough to weigh, number {i}." for i in range(6)]
    assert html_extract.extract(table).count() == len(rows) and html_extract.extract(table.limit(0)).count() == 0


def test_html_takes_constant_text_out_of_articles(spark):
    body = "<article><h1>Head {0}</h1><p>Text of page {0}.</p><p>Pass this on to a friend</p><div class='x'>Join 5,000 readers</div></article>"
    rows = [(i, f"http://c.org/{i}", page(body.format(i))) for i in range(6)]
    rows += [(10 + i, f"http://d.org/{i}", page(body.format(i).replace("article", "main"))) for i in range(4)]
    rows += [(20 + i, "http://e.org/same", page(body.format(0))) for i in range(4)]  # all of it is constant: nothing tells the text
    rows += [(30 + i, f"http://f.org/{i}", page(body.format(i))) for i in range(2)]  # too few pages for a template
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    full = "Head {0}\nText of page {0}.\nPass this on to a friend\nJoin 5,000 readers"
    for i, text in got.items():
        assert text == ("Head {0}\nText of page {0}." if i < 20 else full).format(0 if 20 <= i < 30 else i % 10)


def test_html_template_chooses_the_container(spark):
    extra = "<p>Promoted {0} times</p>"
    rows = []
    for i in range(6):
        words = f"Words of page {i} that go on for a while, as the text of a page does."
        # No article; deep containers, more than 64 of them, of which one has the text.
        rows.append((i, f"http://g.org/{i}", page(f"<div class='outer'><div class='col'><div class='txt'><p>{words}</p><p>{words * 6}</p></div></div>" + "".join(f"<div class='p{j}'><p>s{i}{j}</p></div>" for j in range(70)) + "</div>")))
        # Teasers are articles too, beside the one with the text.
        rows.append((10 + i, f"http://h.org/{i}", page(f"<div><article class='card'><p>See {i}</p></article></div><article class='full'><h1>H{i}</h1><p>{words}</p></article>{extra.format(i)}")))
        # The article's id differs from page to page, so its own tag is no part of the template.
        rows.append((20 + i, f"http://i.org/{i}", page(f"<div class='page'><article id='n{i}'><p>{words}</p></article><p>z{i}</p></div>")))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        words = f"Words of page {i} that go on for a while, as the text of a page does."
        assert got[i] == f"{words}\n{words * 6}" and got[10 + i] == f"H{i}\n{words}" and got[20 + i] == words
    blocks, _ = html_extract.read_page(rows[0][2])
    assert html_extract.main_blocks(blocks, set(), set())[1] is False


def test_html_long_page():
    blocks, _ = html_extract.read_page("<article>" + "<p>x y" * 50_000)
    assert len(blocks) == 50_000


def brute(rows, k=5):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in ok:
        if i % 50 == 0:
            near = [(-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in ok if j != i]
            out[i] = [j for _, j in sorted(near)[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(300)]  # a hot vector
    rows += [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (None, rows[0][1]), (950, [float("inf")] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got: dict = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0, leaf_rows=60, block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == set(want) and all([g[0] for g in v] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({g[1] for g in got[q]} & set(w)) for q, w in want.items())
    assert hits >= 0.95 * 5 * len(want)
    assert [g[1] for g in got[600]] == [7, 601, 602, 603, 604]


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], schema)
    assert [r["vec_id"] for r in ann.search(same, F.col("vec_id") == 3).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


def clusters(n, dim=16, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 4
    return centers[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))


def test_the_walk_leaves_most_leaves_of_clustered_vectors_unread(spark):
    x = clusters(6000)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = table.select("vec_id", F.col("embedding").alias("v"))
    # On a sample of 400 the tree must be fitted further, branch by branch.
    for sample in (6000, 400):
        picked = ann.unit(x[:: len(x) // sample])
        tree, visits = ann.build(own, picked, len(x), 5, 8, 50, 0.95, sample)
        leaves = int(tree.leaf.max()) + 1
        assert sorted(tree.leaf[tree.count == 0].tolist()) == list(range(leaves)) and leaves >= 60
        assert visits <= leaves // 3, (visits, leaves)
        assert set(ann.best_bins(tree, picked[0], leaves)) == set(range(leaves))
    got: dict = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0, leaf_rows=50, sample_rows=400, branch=8).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows)
    assert set(got) == set(want) and sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_calibration_does_not_count_the_query_itself():
    x = ann.unit(np.random.default_rng(0).normal(size=(3000, 64)))
    tree = ann.fit(x, 12, 60)
    visits, leaves = ann.calibrate(tree, x, 5, 0.95), int(tree.leaf.max()) + 1
    probe = np.arange(0, 3000, 15)
    near = x[probe] @ x.T
    near[np.arange(len(probe)), probe] = -2
    own = ann.assign(tree, x)
    hits = [np.isin(own[np.argsort(-near[i])[:5]], ann.best_bins(tree, x[q], visits)).mean() for i, q in enumerate(probe)]
    assert np.mean(hits) >= 0.95 and visits < leaves


def test_copies_do_not_flatter_the_calibration():
    x = ann.unit(np.random.default_rng(5).normal(size=(1500, 32)))
    tree = ann.fit(x, 12, 20)
    visits = ann.calibrate(tree, x, 5, 0.95)
    assert 1 < visits == ann.calibrate(tree, np.concatenate([x, np.repeat(x[:1], 1500, axis=0)]), 5, 0.95)


def test_queries_travel_once_to_a_block_not_to_each_leaf(spark):
    x = np.random.default_rng(4).normal(size=(4000, 24))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = ann.search(table, F.col("vec_id") % 50 == 0, leaf_rows=20)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(list(enumerate(x)))
    assert set(got) == set(want) and sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    last = store.executionsList().last()
    values, nodes, sent = store.executionMetrics(last.executionId()), store.planGraph(last.executionId()).allNodes(), []
    for node in (nodes.apply(i) for i in range(nodes.size())):
        if node.name() == "MapInArrow":
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            sent += [values.get(m.accumulatorId()).get() for m in metrics if m.name() == "number of output rows"]
    # 80 queries; 200 leaves, of which unstructured vectors visit more than half; 16 blocks and a few for leaves that fill one badly.
    assert len(sent) == 1 and 80 <= int(sent[0].replace(",", "")) <= 80 * 24


def test_both_ways_of_walking_agree():
    for x in (np.random.default_rng(1).normal(size=(3000, 32)), clusters(3000), np.ones((5, 3))):
        x = ann.unit(x)
        tree = ann.fit(x, 12, 10)
        leaves = int(tree.leaf.max()) + 1
        order = ann.walk_order(tree, x[:40])
        assert [ann.best_bins(tree, q, leaves) for q in x[:40]] == order.tolist()
        for visits in {1, leaves // 2, leaves} - {0}:
            seen = ann.visited_leaves(tree, x[:40], visits)
            assert (seen.sum(1) == visits).all() and all(row[o[:visits]].all() for row, o in zip(seen, order, strict=True))


def test_blocks_hold_whole_leaves_or_parts_of_one():
    lay = ann.lay_out(np.array([3, 0, 4, 25, 2, 9, 1, 10, 0]), 10)
    assert lay.lo.tolist() == [0, 3, 4, 5, 7] and lay.hi.tolist() == [3, 4, 5, 7, 9]
    assert lay.pieces.tolist() == [1, 3, 1, 1, 1] and lay.first.tolist() == [0, 1, 4, 5, 6]
    assert ann.lay_out(np.array([0]), 5).hi.tolist() == [1]


def test_a_tile_with_many_copies_and_repeated_ids():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 3000, axis=0), x[:4], x[:4]])
    vid = np.concatenate([rng.permutation(500), rng.integers(500, 2000, 3000), [7, 7, 8, 9], [7, 600, 8, 1]])
    leaf = rng.integers(0, 9, len(x))
    qid = np.unique(vid[rng.integers(0, len(vid), 1500)])
    q = x[[np.flatnonzero(vid == i)[0] for i in qid]].astype(np.float64)
    sees = rng.random((len(qid), 16)) < 0.7
    parts = list(ann.search_tile(q, qid, sees, np.full(len(qid), -np.inf), x, vid, leaf, 5))
    got: dict = {}
    for i, j, s in zip(*(np.concatenate(c) for c in zip(*parts, strict=True)), strict=True):
        got.setdefault(i, []).append((-s, j))
    rows = x.astype(np.float64)
    norm = np.sqrt((rows * rows).sum(1))
    for n, i in enumerate(qid):
        s = (rows * q[n]).sum(1) / (norm * np.sqrt((q[n] * q[n]).sum()))
        ok = np.flatnonzero(sees[n, leaf] & (vid != i))
        best = sorted(zip((-s[ok]).tolist(), vid[ok].tolist(), strict=True))[:5]
        assert [(round(a, 12), b) for a, b in got[i]] == [(round(a, 12), b) for a, b in best], i


def test_a_tile_tells_vectors_apart_that_single_precision_does_not():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=8) + 1e-6 * rng.normal(size=(1500, 8)), rng.normal(size=(300, 8))])
    ids, sees, none = np.arange(len(x)), np.ones((len(x), 8), bool), np.full(len(x), -np.inf)
    norm = np.sqrt((x * x).sum(1))
    parts = list(ann.search_tile(x, ids, sees, none, x, ids, ids % 3, 5))
    got: dict = {}
    for i, j, s in zip(*(np.concatenate(c) for c in zip(*parts, strict=True)), strict=True):
        got.setdefault(i, []).append((-s, j))
    for i in range(0, len(x), 7):
        s = (x * x[i]).sum(1) / (norm * norm[i])
        s[i] = -np.inf
        assert got[i] == sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5]


def test_floors_never_hide_a_neighbour():
    x = ann.unit(np.random.default_rng(7).normal(size=(400, 8)))
    ids, leaf = np.arange(400), np.arange(400) % 8
    sees = np.random.default_rng(8).random((400, 8)) < 0.5
    got = ann.floors(x, ids, sees, x, ids, leaf, 5)
    for i in range(400):
        s = np.sort((x @ x[i])[sees[i, leaf] & (ids != i)])
        assert got[i] <= s[-5] <= got[i] + 1e-8 if len(s) >= 5 else got[i] == -np.inf
    assert (ann.floors(x, ids, sees, x[:4], ids[:4], leaf[:4], 5) == -np.inf).all()


def test_a_language_whose_words_never_repeat_is_learned(docs):
    rows = [(i, f"kalo{i} mite{i}", "aa") for i in range(30)] + [(100 + i, f"schupf{i} lingt{i}", "bb") for i in range(30)]
    table = docs(rows).selectExpr("*", "'x' AS lang_pred")
    model = langid.fit(table)
    assert model.langs == ["aa", "bb"]
    got = langid.predict(table, model, [F.col("doc_id"), F.col("lang_pred"), F.col("score"), F.col("kept")])
    assert got.columns == ["doc_id", "kept", "lang_pred", "score"]
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] < 100 else "bb") for r in got.collect())
