"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from pairloom.plans.stages import Stage, run_stages
from pairloom.sources import markup, records, tables


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"x","refs":[{"k":1},{"k":2}]}\n{"id":"y"}\n')
    df = records.read_records(spark, str(tmp_path / "a.json"), "id string, refs array<struct<k:int>>")
    assert [(r["id"], None if r["refs"] is None else len(r["refs"])) for r in df.orderBy("id").collect()] == [("x", 2), ("y", None)]
    assert sorted(r["k"] for r in records.flatten_pages(df, "refs").collect()) == [1, 2]




def test_html(spark):
    page = '<html><body><p>none</p><P class=x> MeSH Unique ID: old <b>D001</b></P><p>MeSH Unique ID: D2</p><ul><li><a class="x" href="/a">A</a><a href=\'http://o/b\'>B</a></ul></body></html>'
    df = spark.createDataFrame([("http://h/p", page), ("http://h/a", "<p>none</p>")], "url string, html string")
    assert {r[0] for r in df.select(markup.labelled_value("html", "MeSH Unique ID:")).collect()} == {"D001", ""}
    links = markup.page_links(df, "url", "html")
    assert [(r["place"], r["to_url"]) for r in links.orderBy("place").collect()] == [(0, "http://h/a"), (1, "http://o/b")]
    followed = markup.follow_links(links, df, "to_url", "url").collect()
    assert [(r["to_url"], r["html"]) for r in followed] == [("http://h/a", "<p>none</p>")]


def test_tables_and_catalog(spark, tmp_path):
    folder = str(tmp_path)
    assert tables.load_table(spark, folder, "drugs") is None
    tables.save_table(spark.range(3), folder, "drugs")
    assert tables.load_drugs(spark, folder).count() == 3
    known = tables.load_catalog(spark, folder, tables.PROCESSED_TABLES, views=True)
    assert known["drugs"].count() == 3 and known["trials"] is None
    assert spark.sql("select * from drugs").count() == 3


def test_materialize_reuses_unless_forced(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    folder = str(tmp_path)
    assert tables.materialize(spark, folder, "t", build).count() == 1
    assert tables.materialize(spark, folder, "t", build).count() == 1
    assert tables.materialize(spark, folder, "t", build, force=True).count() == 2


def test_stages(spark, tmp_path):
    stages = [Stage("a", [], lambda: spark.range(4)), Stage("b", ["a"], lambda a: a.filter("id > 1"))]
    folder = str(tmp_path)
    with pytest.raises(LookupError):
        run_stages(spark, folder, stages, only="b")
    assert run_stages(spark, folder, stages)["b"].count() == 2
    assert run_stages(spark, folder, stages, only="b", force=True)["b"].count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], {"k": 1})], "id int, l array<string>, m map<string,int>")
    tables.export_pairs(df, str(tmp_path), "pairs")
    back = spark.read.option("header", True).csv(f"{tmp_path}/pairs.csv").first()
    assert (back["l"], back["m"]) == ('["a"]', '{"k":1}')
    nodes = spark.createDataFrame([("d", "1")], "kind string, id string")
    edges = spark.createDataFrame([("d", "1", "in", "p", "2")], "src_kind string, src string, kind string, dst_kind string, dst string")
    tables.export_graph(nodes, edges, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").filter(F.col("kind") == "in").count() == 1


def test_links_in_every_form(spark):
    page = "<A HREF=/up>1</A><a class=x href='q'>2</a><a data-href='no' href=\"//cdn/z\">3</a><abbr href='no'></abbr><a\nhref=#t>5</a><a href=mailto:x>6</a><a>7</a>"
    df = spark.createDataFrame([("https://h/d/p?q=1#f", page), ("http://h", "<a href=r>x</a>")], "url string, html string")
    got = {(r["from_url"][:8], r["to_url"]) for r in markup.page_links(df, "url", "html").collect()}
    assert got == {
        ("https://", "https://h/up"), ("https://", "https://h/d/q"), ("https://", "https://cdn/z"), ("https://", "https://h/d/p#t"), ("https://", "mailto:x"), ("http://h", "http://h/r"),
    }


def test_sections_and_labels_are_taken_literally(spark):
    page = "<body>x</body><b>bold</b><p>a.b: first</p><p>aXb: second</p><h2>Some (list)</h2><ol></ol><ul><li>in</ul><ul>out</ul>"
    row = spark.createDataFrame([(page,)], "html string").select(
        markup.section("html", "b"), markup.section("html", "i"), markup.labelled_value("html", "a.b:"), markup.labelled_value("html", "a"), markup.after_heading("html", "Some (list)"),
    ).first()
    assert tuple(row) == ("bold", "", "first", "first", "<li>in")


def test_xml(spark):
    df = spark.createDataFrame([("<rows><row id='1'>x</row><row id='2'>y</row></rows>",), ("<rows/>",)], "x string")
    got = markup.xpath_columns(df, "x", {"all": "//row/text()", "second": "//row[@id='2']/text()"}).collect()
    assert [(r["all"], r["second"]) for r in got] == [(["x", "y"], ["y"]), ([], [])]
