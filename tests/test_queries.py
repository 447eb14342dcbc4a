"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from webgrain.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def test_the_whole_text_is_escaped(spark, tmp_path):
    import hashlib

    texts = {1: "a" * 400 + "<b> & *c* [d] #", 2: "", 3: None, 4: "\\`_" * 200}
    safe = {1: "a" * 400 + "&lt;b&gt; &amp; \\*c\\* \\[d\\] \\#", 2: "", 4: "\\\\\\`\\_" * 200}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.escaped_sha256 for r in catalogue.QUERIES["markdown_escape_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(safe[k].encode()).hexdigest() if k in safe else None for k in texts}


def test_titles_with_references_that_are_not_closed(spark, tmp_path):
    told = {1: "a &amp; b&amp", 2: "&amp;quot; &lt &copy; &copy", 3: "x&y &nbsp;&ampz; &middot;"}
    pages = [(k, "https://example.com/", f"<html><head><title>{t}</title></head><body><p>{'word ' * 30}</p></body></html>") for k, t in told.items()]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [(r.page_id, r.title) for r in catalogue.QUERIES["all_page_titles"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.ORACLES["all_page_titles"]).fetchall())


@pytest.mark.parametrize("name", ["page_titles", "all_page_titles"])
def test_titles_of_pages_that_are_not_closed_or_too_large(spark, tmp_path, name):
    title = "<title> A  title </title>"
    html = {
        1: title + "<article>" + "".join(f"<p><b>word {k}</p>" for k in range(600)) + "</article>",
        2: title + "<div>" * 600, 3: f"{title}<p>{'word ' * 450_000}", 4: "<h1>Head</h1><p>no title", 5: "<title> </title><h1>Head</h1>", 6: None,
        8: f"<title>{'long title ' * 200}</title><p>{'word ' * 30}",
        7: "<title>a &amp;amp; b&quot;\n&nbsp;&lt;i</title>" + "<div>" * 600,
    }
    spark.createDataFrame([(k, "https://example.com/", h) for k, h in html.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [(r.page_id, r.title) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.ORACLES[name]).fetchall())


def test_the_entry_module_works_without_the_optional_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['webgrain.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
