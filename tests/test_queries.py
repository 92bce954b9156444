import hashlib
import os
import re

import duckdb
import pandas as pd
import pytest

from pagewright.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    fix = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(str(tuple(map(fix, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        want = db.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def test_paragraph_batches_keeps_runs_of_blanks(spark, tmp_path):
    texts = ["a b\nc", "  two  and   three\n & <x>", " \n".join(f"l{i}  " for i in range(70)), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["digest"]) for r in QUERIES["paragraph_batches"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").split("\n")
        lines = [re.sub(" {2,}", lambda m: "&nbsp;" * len(m[0]), x) for x in lines]
        n = -(-len(lines) // 30) if t is not None else 0
        assert got[i] == (n, hashlib.md5("<br/>".join(lines).encode()).hexdigest())


def test_html_table_norm_reads_whole_pages_and_urls(spark, tmp_path):
    url = "http://a.org/" + "x" * 300
    html = "<html><body><p>" + "y" * 500 + '</p><table class="b"><thead><tr><th>1</th></tr></thead></table><p>z</p></body></html>'
    rows = [(1, url, html), (2, url, "<p>no"), (3, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["table"], r["url_table"]) for r in QUERIES["html_table_norm"](spark, str(tmp_path)).collect()}
    plain = '<html><body><table border="1" ><tr><td>{}</td></tr></table></body></html>'
    assert got == {1: (plain.format(1), plain.format(url)), 2: ("", plain.format(url)), 3: (None, None)}
