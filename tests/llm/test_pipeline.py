import os

import pytest

pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as cp

    from pagewright.llm.common import save

    from .test_duplicates import brute_components, brute_repeats

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, seen = docs, {}
    for name, stage in cp.STAGES:
        after, _ = save(stage(spark, before, DATA))
        seen[name] = (before, after)
        if name != "packing":
            assert after.columns == list(cp.COLUMNS)
            assert after.where("n_chars <> length(text)").count() == 0
        before = after
    # Near duplicates and repeats against brute force, each on its own input.
    given, kept = seen["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    want, _ = brute_components(rows, cp.SHINGLE, cp.PERCENT)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}
    given, kept = seen["suffix_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in kept.collect()}
    for i, (n, removed, _, _) in brute_repeats(rows, cp.REPEAT_BYTES).items():
        assert sizes.get(i, 0) <= n - removed and sizes.get(i, 0) >= n - removed - 8 or removed == 0 and sizes[i] == n
    packed = seen["packing"][1]
    assert packed.select("doc_id").distinct().count() == seen["packing"][0].count()
    # Clean documents stay: whatever language identification drops has no clear language.
    assert seen["language_id"][1].count() == docs.count()


def test_empty_table(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_stages_with_nulls_repeats_ties_and_clashes(spark):
    import random

    import corpus_pipeline as cp

    from pagewright.llm.common import save

    r = random.Random(3)
    sounds = {"aa": "kalo mite suna rako", "bb": "schu pfer ling tzau"}
    speech = lambda lang, n: " ".join("".join(r.choices(sounds[lang].split(), k=r.randint(2, 4))) for _ in range(n))
    run = "\n".join(speech("aa", 6) for _ in range(4))
    rows = [(i, speech("aa" if i % 2 else "bb", 40), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 -- !", None), (103, " \n ", "aa")]
    rows += [(104, rows[0][1], "bb"), (104, rows[0][1], "bb"), (105, rows[1][1], None), (None, speech("bb", 40), None)]
    rows += [(110, speech("aa", 20) + "\n" + run, "aa"), (111, speech("aa", 20) + "\n" + run, None), (112, speech("bb", 30_000), "bb")]
    docs = spark.createDataFrame([(*x, None, None, "n", "s", "k") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, n_removed string, score string, k_id string")
    kept = {}
    for name, stage in cp.STAGES:
        docs, _ = save(stage(spark, docs, ""))
        kept[name] = docs
    ids = {name: sorted((x["doc_id"] for x in df.collect()), key=lambda i: (i is None, i)) for name, df in kept.items()}
    assert not {100, 101, 102, 103} & set(ids["language_id"]) and ids["language_id"].count(104) == 2 and None in ids["language_id"]
    text = {x["doc_id"]: x["text"] for x in kept["line_dedup"].collect()}
    assert text[110].endswith(run) and run not in text[111] and len(text[111]) > 0
    assert 104 not in ids["near_dedup"] and 105 not in ids["near_dedup"] and {0, 1, None} <= set(ids["near_dedup"])
    assert kept["suffix_dedup"].columns == list(cp.COLUMNS) and len(text[112]) > 100_000
    assert set(ids["packing"]) == set(ids["suffix_dedup"])
