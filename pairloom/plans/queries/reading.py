"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.text import first_part, last_part, last_word
from ...operators import graph
from ...operators.aggregates import shape_report
from ...operators.ordering import keep_first, key_batches
from ...operators.sets import stacked
from ...session import shared_dir
from ...sources import markup, records, tables
from ..registry import query
from ..stages import Stage, run_stages
from .common import PAIRS, pairs


@query("json_paths", "S2 P7", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
       CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS max_k, count(json_extract_string(props, '$.missing')) AS n_missing
FROM events GROUP BY event_type""")
def json_paths(t) -> DataFrame:
    props = records.parsed("props", "struct<k:bigint,missing:struct<x:string>>")
    read = t.events.select("event_type", props.alias("p")).select("event_type", "p.k", F.col("p.missing.x").alias("x"))
    return read.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"), F.count("x").alias("n_missing")
    )


@query("json_pages", "S1 S3", """
SELECT kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_id FROM (
  SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'customer', o_custkey FROM orders)
GROUP BY kind""")
def json_pages(t) -> DataFrame:
    page = F.to_json(F.struct(F.array(
        F.struct(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")),
        F.struct(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id")),
    ).alias("studies")))
    folder = f"{shared_dir(t.spark)}/answers-{uuid.uuid4().hex}"
    t.orders.select(page.alias("value")).write.text(folder)  # one JSON document a line, as answers are kept
    pages = records.read_records(t.spark, folder, "studies array<struct<kind:string,id:bigint>>")
    found = records.flatten_pages(pages, "studies")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"))


@query("xml_bindings", "S4 E3", """
SELECT 'C' || c_custkey AS code, 'N' || c_nationkey AS place, c_mktsegment AS label FROM customer""")
def xml_bindings(t) -> DataFrame:
    def bound(name: str, tag: str, value) -> list:
        return [F.lit(f'<binding name="{name}"><{tag}>'), value, F.lit(f"</{tag}></binding>")]

    base = F.lit("http://example.org/x/")
    xml = F.concat(
        F.lit('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><results><result>'),
        *bound("dis", "uri", F.concat(base, F.lit("C"), "c_custkey")), *bound("tn", "uri", F.concat(base, F.lit("N"), "c_nationkey")),
        *bound("lab", "literal", F.col("c_mktsegment")), F.lit("</result></results></sparql>"),
    )
    node = "//*[local-name()='binding'][@name='{}']/*[local-name()='{}']/text()"
    read = markup.xpath_columns(
        t.customer.select(xml.alias("xml")), "xml",
        {"codes": node.format("dis", "uri"), "places": node.format("tn", "uri"), "labels": node.format("lab", "literal")},
    )
    rows = read.select(F.explode(F.arrays_zip("codes", "places", "labels")).alias("z"))
    return rows.select(last_part("z.codes", "/").alias("code"), last_part("z.places", "/").alias("place"), F.col("z.labels").alias("label"))


HREF = r"""'(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'"""
HREFS = f"""list_transform(list_zip(regexp_extract_all(html, {HREF}, 1), regexp_extract_all(html, {HREF}, 2), regexp_extract_all(html, {HREF}, 3)), lambda x: coalesce(x[1], '') || coalesce(x[2], '') || coalesce(x[3], ''))"""


@query("html_links", "S5", f"""
SELECT page_id, url, len(links) AS n_links, links[1] AS first_link, links[-1] AS last_link,
       regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) AS title,
       regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset
FROM (SELECT page_id, url, html, {HREFS} AS links FROM pages)""")
def html_links(t) -> DataFrame:
    read = t.pages.withColumn("links", markup.hrefs("html"))
    return read.select(
        "page_id", "url", F.size("links").cast("bigint").alias("n_links"), F.try_element_at("links", F.lit(1)).alias("first_link"),
        F.try_element_at("links", F.lit(-1)).alias("last_link"), markup.section("html", "title").alias("title"),
        F.regexp_extract("html", '<meta charset="([^"]*)"', 1).alias("charset"),
    )


# The forms of a link, and markup around a list of them.
LINK_FORMS = ["/a", "b", "//cdn.example.org/c", "https://example.net/d?x=1", "#part", "mailto:x@example.org"]
LIST_PAGE = '<H2>Other</H2><UL><li><a href="/no">no</a></UL><h2>Wanted list</h2>\n<ul class=x>{}</ul><p>Id: </p><ul><a href="/late">late</a></ul>'


@query("section_links", "S5 S6", f"""
WITH f AS (SELECT unnest({LINK_FORMS}) AS href, generate_subscripts({LINK_FORMS}, 1) - 1 AS place),
p AS (SELECT url AS from_url, regexp_extract(url, '^([^?#]*)', 1) AS page, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages)
SELECT from_url, CAST(place AS INTEGER) AS place, href, CASE place WHEN 0 THEN root || href WHEN 1 THEN regexp_extract(page, '^(.*/)', 1) || href WHEN 2 THEN scheme || href
  WHEN 4 THEN page || href ELSE href END AS to_url FROM p, f""")
def section_links(t) -> DataFrame:
    """Links of the one list after a heading, of pages that write them in every way."""
    items = "".join(f"<li><A class='l' {name}={quote}{href}{quote}>x</A>" for href, name, quote in zip(LINK_FORMS, ["HREF", "href"] * 3, ['"', "'", "", '"', "'", '"']))
    pages = t.pages.select("url", markup.after_heading(F.lit(LIST_PAGE.format(items)), "Wanted list").alias("html"))
    return markup.page_links(pages, "url", "html")


@query("page_link_join", "S6 J1", f"""
WITH links AS (SELECT url, unnest({HREFS}) AS href, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages),
targets AS (
  SELECT address, min(page_id) AS target FROM (
    SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/' || split_part(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), ' ', 1) AS address FROM pages)
  GROUP BY address)
SELECT address AS to_url, target, length(p.html) AS target_size, count(*) AS n_links, count(DISTINCT links.url) AS n_pages
FROM links JOIN targets ON root || href = address JOIN pages p ON p.page_id = target GROUP BY ALL""")
def page_link_join(t) -> DataFrame:
    """A page is reached under its host and the first word of its heading, which is how the pages link."""
    links = markup.page_links(t.pages, "url", "html").select("from_url", "to_url")
    root = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    address = F.concat(root, F.lit("/"), first_part(markup.section("html", "h1"), " "))
    known = t.pages.select("page_id", F.length("html").cast("bigint").alias("target_size"), address.alias("address"))
    targets = keep_first(known, ["address"], "page_id").withColumnRenamed("page_id", "target")
    followed = markup.follow_links(links, targets, "to_url", "address")
    return followed.groupBy("to_url", "target", "target_size").agg(
        F.count("*").alias("n_links"), F.count_distinct("from_url").alias("n_pages")
    )


@query("labelled_value", "S5 E3", r"""
SELECT page_id, regexp_extract(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p\b[^>]*>\s*(the.*?)</p\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '(\S+)$', 1) AS last_word FROM pages""")
def labelled_value(t) -> DataFrame:
    return t.pages.select("page_id", markup.labelled_value("html", "the").alias("last_word"))


# The names of the catalog and the tables that stand for them.
STAND_INS = {"drugs": "part", "diseases": "supplier", "trials": "orders", "indications": "lineitem", "embeddings": "embeddings"}
WIDTHS = {"drugs": 6, "diseases": 4, "trials": 6, "indications": 11, "embeddings": 3}


@query("shape_report", "S9 S10 K4", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", NULL AS label, count(*) AS \"rows\", CAST({WIDTHS[n]} AS BIGINT) AS \"columns\" FROM {source}" for n, source in STAND_INS.items()
) + " UNION ALL SELECT 'trials', o_orderstatus, count(*), NULL FROM orders GROUP BY o_orderstatus")
def shapes(t) -> DataFrame:
    """A catalog written once, then read by name and by the loaders."""
    folder = f"{shared_dir(t.spark)}/catalog-{uuid.uuid4().hex}"
    for name, source in STAND_INS.items():
        tables.save_table(getattr(t, source), folder, name)
    found = tables.load_catalog(t.spark, folder, [*tables.PROCESSED_TABLES, "absent"])
    assert found.pop("absent") is None
    loaders = {"drugs": tables.load_drugs, "diseases": tables.load_diseases, "trials": tables.load_trials, "indications": tables.load_indications, "embeddings": tables.load_embeddings}
    typed = {name: loaders[name](t.spark, folder) for name in found}
    assert all(typed[name].schema == found[name].schema for name in found)
    return shape_report(typed, label=("trials", "o_orderstatus"))


@query("key_batches", "K3 O6 A6", """
WITH k AS (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 20 AS batch FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT batch, count(*) AS n, string_agg(o_custkey, ',' ORDER BY o_custkey) AS keys FROM k GROUP BY batch""")
def batches(t) -> DataFrame:
    made = key_batches(t.orders, "o_custkey", 20)
    return made.select("batch", F.size("keys").cast("bigint").alias("n"), F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("staged_build", "S7 S8 K1 K2", f"""
WITH {PAIRS}, n AS (SELECT l_partkey, count(*) AS suppliers FROM pairs GROUP BY 1)
SELECT suppliers, count(*) AS parts FROM n GROUP BY 1""")
def staged_build(t) -> DataFrame:
    folder = f"{shared_dir(t.spark)}/stages-{uuid.uuid4().hex}"
    stages = [
        Stage("pairs", [], lambda: pairs(t)),
        Stage("counts", ["pairs"], lambda p: p.groupBy("l_partkey").agg(F.count("*").alias("suppliers"))),
        Stage("report", ["counts"], lambda c: c.groupBy("suppliers").agg(F.count("*").alias("parts"))),
    ]
    return run_stages(t.spark, folder, stages)["report"]


@query("export_roundtrip", "S11", """
SELECT form, s_suppkey, s_name, '[' || s_nationkey || ',' || s_suppkey || ']' AS ids FROM supplier, (SELECT unnest(['csv', 'parquet']) AS form)""")
def export_roundtrip(t) -> DataFrame:
    folder = f"{shared_dir(t.spark)}/export-{uuid.uuid4().hex}"
    made = t.supplier.select("s_suppkey", "s_name", F.array(F.col("s_nationkey").cast("bigint"), "s_suppkey").alias("ids"))
    tables.export_pairs(made, folder, "suppliers")
    csv = t.spark.read.option("header", True).schema("s_suppkey bigint, s_name string, ids string").csv(f"{folder}/suppliers.csv")
    parquet = tables.flat_for_csv(t.spark.read.parquet(f"{folder}/suppliers.parquet"))
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(parquet.select(F.lit("parquet").alias("form"), "*"))


@query("graph_roundtrip", "S12", """
SELECT 'node' AS part, 'part' AS kind, CAST(p_partkey AS VARCHAR) AS a, NULL AS b, CAST(p_size AS DOUBLE) AS "value" FROM part
UNION ALL SELECT 'node', 'supplier', CAST(s_suppkey AS VARCHAR), NULL, s_acctbal FROM supplier
UNION ALL SELECT 'edge', 'sold', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), max(l_quantity) FROM lineitem GROUP BY l_partkey, l_suppkey""")
def graph_roundtrip(t) -> DataFrame:
    """Nodes and edges with attributes, written as a graph export and read back, each kind from its own folder."""
    folder = f"{shared_dir(t.spark)}/graph-{uuid.uuid4().hex}"
    nodes = stacked(graph.nodes(t.part, "part", "p_partkey", ["p_size"]), graph.nodes(t.supplier, "supplier", "s_suppkey", ["s_acctbal"]))
    sold = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("weight"))
    tables.export_graph(nodes, graph.pair_edges(sold, "part", "l_partkey", "sold", "supplier", "l_suppkey", "weight"), folder)
    read_nodes, read_edges = t.spark.read.parquet(f"{folder}/nodes"), t.spark.read.parquet(f"{folder}/edges")
    rows = read_nodes.select(F.lit("node").alias("part"), "kind", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.get("features", F.lit(0)).alias("value"))
    return rows.unionByName(read_edges.select(F.lit("edge").alias("part"), "kind", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("value")))


@query("last_words", "E3 E1", r"""
SELECT item_id, split_part(trim(text), ' ', 1) AS first_word, lower(regexp_extract(text, '(\S+)\s*$', 1)) AS last_word FROM benchmark""")
def last_words(t) -> DataFrame:
    return t.benchmark.select("item_id", first_part(F.trim("text"), " ").alias("first_word"), F.lower(last_word("text")).alias("last_word"))
