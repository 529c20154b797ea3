"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import arrays as A
from ...functions import dates as D
from ...functions import text as T
from ...operators import columns as C
from ...operators import filters as L
from ...operators import sets as U
from ...session import cut_lineage
from ..registry import query
from .common import date_text, r6


@query("rename_reorder", "P1 P3 P4 P5 P12 P14", """
SELECT p_partkey AS part_id, p_brand AS brand, p_name, p_type, p_size, '9999' AS first_date, CAST(NULL AS VARCHAR) AS note, p_partkey AS entity_id
FROM part""")
def rename_reorder(t) -> DataFrame:
    named = C.without(t.part, "p_retailprice").withColumnsRenamed({"p_partkey": "part_id", "p_brand": "brand"})
    made = C.first_columns(named, "part_id", "brand").withColumns({
        "first_date": F.lit("9999"), "note": F.lit(None).cast("string"), "entity_id": F.col("part_id"),
    })
    return made


@query("struct_unnest", "P6 P7", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority, o_custkey AS buyer
FROM orders""")
def struct_unnest(t) -> DataFrame:
    details = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    nested = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", details).alias("details"), F.struct(F.col("o_custkey").alias("buyer")).alias("who")
    )
    return C.unnest(nested, "details", "who")


@query("dtype_select", "P8", "SELECT c_name, c_custkey, c_nationkey, c_acctbal FROM customer")
def dtype_select(t) -> DataFrame:
    return C.select_types(t.customer, "number", keep=["c_name"])


@query("name_select", "P9", """
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) + 0.0 AS l_discount, round(sum(l_tax), 2) + 0.0 AS l_tax
FROM lineitem GROUP BY 1""")
def name_select(t) -> DataFrame:
    wanted = C.columns_like(t.lineitem, "^l_(ex|ta)") + C.columns_with_prefix(t.lineitem, "l_disc")
    return t.lineitem.groupBy("l_returnflag").agg(*[(F.round(F.sum(c), 2) + F.lit(0.0)).alias(c) for c in wanted])


@query("vector_columns", "P10", "SELECT vec_id, label, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS e_{i}" for i in range(64)) + " FROM embeddings")
def vector_columns(t) -> DataFrame:
    wide = C.numbered(t.embeddings, "embedding", "e_", 64)
    return wide.select("vec_id", "label", *[r6(F.col(c).cast("double")).alias(c) for c in C.columns_with_prefix(wide, "e_")])


@query("drop_invariant", "P11", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def drop_invariant(t) -> DataFrame:
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    same = base.withColumns({"unit": F.lit("piece"), "version": F.lit(3), "open": F.lit(True), "empty_or_one": F.when(F.col("l_quantity") > 25, 1)})
    return C.drop_invariant(same)


@query("shared_columns", "P13 U1", """
SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def shared_columns(t) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = t.supplier.select("s_name", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side"))
    return U.stacked(*C.shared_columns(a, b))


@query("predicates_text", "F1 F3 F4 F5 F8 F9 F11", """
SELECT p_type, count(*) AS n,
  count(*) FILTER (p_brand IN ('Brand#4', 'Brand#3')) AS coded, count(*) FILTER (lower(p_name) = 'small ring') AS same_name,
  count(*) FILTER (contains(lower(p_name), 'ring')) AS with_ring, count(*) FILTER (ends_with(lower(p_name), 'bolt')) AS ends_bolt,
  count(*) FILTER (contains(p_name, 'red') AND NOT contains(p_name, 'widget')) AS red_only,
  count(*) FILTER (starts_with(p_brand, 'Brand#1')) AS brand_one, count(*) FILTER (length(p_name) > 0) AS named,
  count(*) FILTER (list_contains(string_split(lower(p_name), ' '), 'ring')) AS word_ring
FROM part GROUP BY p_type""")
def predicates_text(t) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.groupBy("p_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("p_brand").isin("Brand#4", "Brand#3")).alias("coded"),
        F.count_if(T.equals_ignore_case("p_name", "SMALL Ring")).alias("same_name"),
        F.count_if(T.contains_ignore_case("p_name", "RING")).alias("with_ring"),
        F.count_if(T.ends_ignore_case("p_name", "Bolt")).alias("ends_bolt"),
        F.count_if(F.contains("p_name", F.lit("red")) & ~F.contains("p_name", F.lit("widget"))).alias("red_only"),
        F.count_if(T.has_prefix("p_brand", "Brand#1")).alias("brand_one"),
        F.count_if(T.non_empty("p_name")).alias("named"),
        F.count_if(T.any_equals_ignore_case(words, "Ring")).alias("word_ring"),
    )


CUSTOMER_FLAGS = """c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 3 - 1 AS INTEGER) END AS availability_type,
  CASE WHEN c_nationkey <> 0 THEN c_nationkey % 2 = 1 END AS withdrawn_flag FROM customer)"""


def customer_flags(t) -> DataFrame:
    return t.customer.select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, (F.col("c_custkey") % 3 - 1).cast("int")).alias("availability_type"),
        F.when(F.col("c_nationkey") != 0, F.col("c_nationkey") % 2 == 1).alias("withdrawn_flag"),
    )


@query("available_open", "P2 F7", f"""
WITH {CUSTOMER_FLAGS} SELECT c_custkey, availability_type, withdrawn_flag FROM c
WHERE coalesce(availability_type > 0, false) OR (availability_type IS NULL AND withdrawn_flag = false) OR withdrawn_flag IS NULL""")
def available_open(t) -> DataFrame:
    return L.available(customer_flags(t), rule="open").drop("c_mktsegment")


@query("available_strict", "P2", f"""
WITH {CUSTOMER_FLAGS} SELECT c_custkey, availability_type, withdrawn_flag FROM c WHERE availability_type > 0 AND NOT withdrawn_flag""")
def available_strict(t) -> DataFrame:
    return L.available(customer_flags(t), rule="strict").drop("c_mktsegment")


@query("complete_rows", "F12 E14", f"""
WITH {CUSTOMER_FLAGS} SELECT c_mktsegment, count(*) AS n, count(*) FILTER (availability_type IS NOT NULL) AS with_type,
  count(*) FILTER (availability_type IS NOT NULL AND withdrawn_flag IS NOT NULL) AS complete FROM c GROUP BY 1""")
def complete_rows(t) -> DataFrame:
    base = customer_flags(t)
    sizes = base.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(T.present_flag("availability_type")).alias("with_type"))
    whole = base.dropna("any").groupBy("c_mktsegment").agg(F.count("*").alias("complete"))
    return sizes.join(whole, "c_mktsegment")


def nested_lines(t) -> DataFrame:
    """Lines as nested records, stored once: what is sold and when it moves, each a struct, and the key."""
    amounts = F.struct("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    moves = F.struct("l_shipdate", "l_returnflag", "l_linestatus")
    return cut_lineage(t.lineitem.select("l_orderkey", "l_linenumber", F.struct(amounts.alias("amounts"), moves.alias("moves")).alias("line")))


@query("nested_range", "F6 S2", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 30 AND l_extendedprice <= 30000""")
def nested_range(t) -> DataFrame:
    """Ranges over paths two structs deep: only the fields on the paths are read, and both ranges reach the scan."""
    kept = L.in_ranges(nested_lines(t), {"line.amounts.l_quantity": (30, None), "line.amounts.l_extendedprice": (None, 30000)})
    return kept.select("l_orderkey", "l_linenumber", "line.amounts.l_quantity", "line.amounts.l_extendedprice")


@query("date_range", "F13", """
SELECT o_orderkey, d AS order_date FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '9999' ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders)
WHERE (d > '1996' AND d < '1999') OR d = '9999'""")
def date_range(t) -> DataFrame:
    dated = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "9999").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("order_date"))
    return dated.filter(D.in_date_range("order_date", "1996", "1999", keep_missing=True))


@query("top_categories", "F9 F10", """
SELECT DISTINCT code FROM (SELECT 'C' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS code FROM nation
UNION ALL SELECT 'C' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '.' || n_nationkey FROM nation) WHERE starts_with(code, 'C') AND length(code) <= 3""")
def top_categories(t) -> DataFrame:
    top = F.concat(F.lit("C"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0"))
    codes = t.nation.select(F.explode(F.array(top, F.concat_ws(".", top, F.col("n_nationkey")))).alias("code"))
    return codes.filter(T.is_top_category("code", "C")).distinct()


@query("membership", "F2 J7", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def membership(t) -> DataFrame:
    wanted = t.orders.filter(F.col("o_totalprice") > 400000)
    return L.members_of(t.customer.select("c_custkey", "c_name"), "c_custkey", wanted, "o_custkey")


@query("overlap_members", "F15", """
SELECT doc_id FROM (SELECT doc_id, string_split(lower(text), ' ') AS words FROM documents)
WHERE list_has_any(words, (SELECT list(DISTINCT w) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION ALL SELECT unnest(string_split(lower(text), ' ')) FROM benchmark)))""")
def overlap_members(t) -> DataFrame:
    docs = t.documents.select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    names = t.part.select(F.lower("p_name").alias("n")).union(t.benchmark.select(F.lower("text")))
    words = names.select(F.explode(F.split("n", " ")).alias("w")).distinct()
    return L.overlapping(docs, "doc_id", "words", words, "w").select("doc_id")


@query("score_outliers", "F14", """
WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS score FROM lineitem)
SELECT * FROM s WHERE l_partkey IN (SELECT l_partkey FROM s WHERE score > 95000)""")
def score_outliers(t) -> DataFrame:
    scored = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("score")
    )
    return L.beyond(scored, "score", 95000, "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber", "score")


@query("text_functions", "E1 E2 E3 E5 E6 E22", """
SELECT c_custkey, replace(replace(lower(c_name), '#', ':'), '0', '_') AS swapped, split_part(c_name, '#', 2) AS number, split_part(c_name, '#', 1) AS word,
  concat_ws(' ', c_mktsegment, c_name) AS joined, c_mktsegment || coalesce(CAST(nullif(c_nationkey % 4, 0) AS VARCHAR), 'None') AS tag,
  nullif(c_nationkey % 4, 0) AS tag_phase, c_mktsegment AS tag_outcome,
  CASE WHEN length(c_mktsegment) > 8 THEN left(c_mktsegment, 8) || '...' ELSE c_mktsegment END AS cropped
FROM customer""")
def text_functions(t) -> DataFrame:
    phase = F.nullif(F.col("c_nationkey") % 4, F.lit(0))
    tagged = t.customer.withColumn("tag", T.outcome_tag("c_mktsegment", phase))
    return tagged.select(
        "c_custkey", T.swap_text(F.lower("c_name"), {"#": ":", "0": "_"}).alias("swapped"), T.last_part("c_name", "#").alias("number"),
        T.first_part("c_name", "#").alias("word"), T.joined(F.array("c_mktsegment", "c_name")).alias("joined"), "tag",
        T.tag_phase("tag").alias("tag_phase"), T.tag_outcome("tag").alias("tag_outcome"), T.cropped("c_mktsegment", 8).alias("cropped"),
    )


@query("number_parsing", "E7 E8 E9", """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'p < ' || (o_orderkey % 100) || '.5' WHEN 'O' THEN (o_orderkey % 9 + 1) || 'E-' || (o_orderkey % 7 + 1)
  ELSE 'NS' END AS p, 'PHASE' || left(o_orderpriority, 1) AS code, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS num FROM orders)
SELECT o_orderkey, TRY_CAST(regexp_replace(p, '[^0-9.]', '', 'g') AS DOUBLE) AS digits, round(TRY_CAST(nullif(regexp_extract(p, '([0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE), 9) AS scientific,
  CAST(right(code, 1) AS INTEGER) AS phase, TRY_CAST(num AS DOUBLE) AS num FROM x""")
def number_parsing(t) -> DataFrame:
    key = F.col("o_orderkey")
    p = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("p < "), key % 100, F.lit(".5")))
        .when(F.col("o_orderstatus") == "O", F.concat(key % 9 + 1, F.lit("E-"), key % 7 + 1))
        .otherwise("NS")
    )
    code = F.concat(F.lit("PHASE"), F.left("o_orderpriority", F.lit(1)))
    num = F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select(
        "o_orderkey", T.p_value(p).alias("digits"), F.round(T.p_value(p, "scientific"), 9).alias("scientific"), T.last_digit(code).alias("phase"),
        T.to_number(num).alias("num"),
    )


@query("date_parsing", "E10 E11 E12", """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m')
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN '9999' ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS d,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END AS approval FROM orders)
SELECT o_orderkey, d, CASE WHEN d <> '9999' THEN CAST(left(d, 4) AS INTEGER) END AS year, coalesce(CAST(approval AS VARCHAR), '9999') AS approval_text,
  CASE WHEN d <> '9999' THEN d WHEN approval IS NOT NULL THEN CAST(approval AS VARCHAR) ELSE '0000' END AS first_date FROM x""")
def date_parsing(t) -> DataFrame:
    odd_or_none = F.when(F.col("o_orderkey") % 2 == 0, "9999").otherwise(date_text("o_orderdate"))
    d = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM")).otherwise(odd_or_none)
    )
    approval = F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate").cast("double"))
    dated = t.orders.select("o_orderkey", d.alias("d"), D.year_text(approval).alias("approval_text"))
    return dated.select("o_orderkey", "d", D.date_year("d").alias("year"), "approval_text", D.first_date_or("d", "approval_text").alias("first_date"))


@query("status_dates", "E15 S2", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '9999' ELSE strftime(o_orderdate, '%Y-%m') END AS first_date,
  CASE WHEN o_orderstatus = 'P' THEN '0000' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS last_date FROM orders""")
def status_dates(t) -> DataFrame:
    month, day = F.date_format("o_orderdate", "yyyy-MM"), date_text("o_orderdate")
    dated = F.struct(
        month.alias("statusVerifiedDate"), F.struct(day.alias("date"), F.lit("ACTUAL").alias("type")).alias("startDateStruct"),
        F.struct(F.lit("x").alias("type")).alias("updateDateStruct"), F.col("o_orderstatus").alias("overallStatus"),
    )
    plain = F.to_json(F.struct(F.col("o_orderstatus").alias("overallStatus"), F.lit("1900").alias("version")))
    status = F.when(F.col("o_orderstatus") == "P", plain).otherwise(F.to_json(dated))
    dates = t.orders.select("o_orderkey", D.dates_among(D.open_fields(status)).alias("dates"))
    return dates.select("o_orderkey", D.earliest_date("dates").alias("first_date"), D.latest_date("dates").alias("last_date"))


@query("code_maps", "E13 E14 E19", """
SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN 'achiral' WHEN 1 THEN 'single_enantiomer' WHEN 0 THEN 'mixture' END AS chirality,
  CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 0 END AS flag, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 1 ELSE 0 END AS present FROM part""")
def code_maps(t) -> DataFrame:
    letter = F.when(F.col("p_type") == "SMALL", "Y").when(F.col("p_type") == "LARGE", "n")
    return t.part.select(
        "p_partkey", T.recoded(F.col("p_size") % 4, T.CHIRALITY_NAMES).alias("chirality"), T.flag_number(letter).alias("flag"),
        T.present_flag(letter).alias("present"),
    )


@query("nested_references", "E16 E17 E18 E20", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'A' THEN l_suppkey || ',' || l_orderkey WHEN 'N' THEN CAST(l_partkey AS VARCHAR) END AS last_ids,
  CASE l_returnflag WHEN 'A' THEN l_partkey || ',' || l_suppkey || ',' || l_orderkey WHEN 'N' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS all_ids,
  CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 1 ELSE 0 END AS n_ids,
  CASE WHEN l_linestatus = 'O' THEN l_suppkey || ',' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END AS nested
FROM lineitem""")
def nested_references(t) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    trial = lambda ids: F.struct(F.lit("ClinicalTrials").alias("ref_type"), ids.alias("ref_id"))
    other = F.struct(F.lit("FDA").alias("ref_type"), F.lit("x").alias("ref_id"))
    both = F.array(trial(text("l_partkey")), other, trial(F.concat_ws(",", text("l_suppkey"), text("l_orderkey"))))
    refs = F.when(F.col("l_returnflag") == "A", both).when(F.col("l_returnflag") == "N", F.array(trial(text("l_partkey")), other)).otherwise(F.array(other))
    xref = lambda c, src: F.struct(text(c).alias("id"), F.lit(src).alias("source"))
    one = F.struct(F.array(xref("l_suppkey", "UniProt"), xref("l_partkey", "PDB")).alias("xrefs"))
    none = F.struct(F.lit(None).cast("array<struct<id:string,source:string>>").alias("xrefs"))
    components = F.when(F.col("l_linestatus") == "O", F.array(one, none, one)).otherwise(F.array(one, none))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", refs.alias("refs"), components.alias("components"))
    ids = A.all_references("refs", "ClinicalTrials")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(A.last_reference("refs", "ClinicalTrials"), ",").alias("last_ids"),
        F.array_join(ids, ",").alias("all_ids"), A.length_or_zero(ids).alias("n_ids"),
        F.array_join(A.nested_values("components", lambda c: c["xrefs"], lambda x: x["source"] == "UniProt", lambda x: x["id"]), ",").alias("nested"),
    )


@query("reference_worklist", "E18 A6 E23", """
SELECT DISTINCT unnest(CASE l_returnflag WHEN 'A' THEN [l_partkey, l_suppkey, l_orderkey] WHEN 'N' THEN [l_partkey] ELSE [] END) AS id FROM lineitem""")
def reference_worklist(t) -> DataFrame:
    ids = (
        F.when(F.col("l_returnflag") == "A", F.array("l_partkey", "l_suppkey", "l_orderkey"))
        .when(F.col("l_returnflag") == "N", F.array("l_partkey")).otherwise(F.array().cast("array<bigint>"))
    )
    return U.ids_of(t.lineitem.select(F.array_distinct(ids).alias("ids")), "ids")


@query("array_set_ops", "U4 X2 E20 E21", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  len(list_intersect(a, b)) AS shared, len(list_distinct(a || b)) AS joint, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard,
  len(list_distinct(a || b)) AS members
FROM (SELECT *, list_distinct([l_partkey % 5, l_suppkey % 5, l_orderkey % 5]) AS a, list_distinct([l_linenumber % 5, l_orderkey % 3]) AS b FROM lineitem)""")
def array_set_ops(t) -> DataFrame:
    a = F.array(F.col("l_partkey") % 5, F.col("l_suppkey") % 5, F.col("l_orderkey") % 5)
    b = F.array((F.col("l_linenumber") % 5).cast("bigint"), F.col("l_orderkey") % 3)
    both = t.lineitem.withColumns({"a": a, "b": b})
    m = F.create_map(F.lit("x"), F.col("a"), F.lit("y"), F.col("b"))
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.shared_count("a", "b").cast("bigint").alias("shared"),
        A.union_count("a", "b").cast("bigint").alias("joint"), F.round(A.jaccard("a", "b"), 6).alias("jaccard"),
        F.size(A.map_members(m)).cast("bigint").alias("members"),
    )


@query("rendered_params", "E24", "SELECT p_partkey, 'brand = ' || p_brand || ',size = ' || p_size || ',type = ' || p_type AS params FROM part")
def rendered_params(t) -> DataFrame:
    m = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    return t.part.select("p_partkey", T.rendered_params(m).alias("params"))
