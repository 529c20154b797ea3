"""Evidence, labels and the pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import trials as R
from ...operators.ordering import keep_first
from ...operators.joins import repeated_items
from ...session import dealt
from ..registry import query
from .common import PAIRS, PART_NATIONS, ROWS_A_TASK, SUPPLIER_NATIONS, pairs, part_nations, r6, supplier_nations


def outcome_sql(median: str, below: str, above: str, lowest: str) -> str:
    conflict = f"({lowest} < 0.05::DOUBLE AND {above} > 0.5::DOUBLE)"
    return f"""CASE WHEN {median} IS NULL THEN NULL
  WHEN {median} <= 0.05::DOUBLE OR ({median} <= 0.1::DOUBLE AND {below} >= 0.5::DOUBLE AND NOT {conflict}) THEN 'success'
  WHEN {median} <= 0.2::DOUBLE OR ({median} <= 0.5::DOUBLE AND {below} >= 0.1::DOUBLE AND {below} < 0.5::DOUBLE) OR {conflict} THEN 'unknown'
  WHEN {median} > 0.2::DOUBLE AND {below} < 0.1::DOUBLE THEN 'fail' END"""


@query("child_outcome", "A12 B1 E7 E19 O6", f"""
WITH p AS (SELECT l_orderkey, round((l_discount + l_tax) * (l_linenumber - 1) / 2, 4) + 0.0 AS p FROM lineitem),
s AS (SELECT l_orderkey, median(p) AS m, count(*) FILTER (p < 0.05::DOUBLE) / count(*) AS q, count(*) FILTER (p > 0.2::DOUBLE) / count(*) AS a, min(p) AS lo, count(*) AS n FROM p GROUP BY 1)
SELECT l_orderkey, round(m, 6) AS median, round(q, 6) AS below, round(a, 6) AS above, lo AS lowest, n AS "values", {outcome_sql('m', 'q', 'a', 'lo')} AS outcome FROM s""")
def child_outcome(t) -> DataFrame:
    p = F.round((F.col("l_discount") + F.col("l_tax")) * (F.col("l_linenumber") - 1) / 2, 4) + F.lit(0.0)
    made = R.outcomes_from_rows(t.lineitem.select("l_orderkey", p.alias("p")), "l_orderkey", "p")
    return made.select("l_orderkey", r6("median").alias("median"), r6("below").alias("below"), r6("above").alias("above"), "lowest", "values", "outcome")


TRIALS = f"""raw AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_custkey % 4 <> 0 AS has_results,
    [CAST('0.' || lpad(CAST(o_orderkey * 7 % 100 AS VARCHAR), 3, '0') AS DOUBLE), CAST('0.' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS DOUBLE), CAST('0.' || (o_orderkey % 9) AS DOUBLE)] AS p FROM orders),
trials AS (SELECT 'NCT' || o_orderkey AS nct_id, o_orderstatus AS status,
    CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN NULL ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END AS phase,
    strftime(o_orderdate, '%Y-%m') AS first_date, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS last_date, strftime(o_orderdate, '%Y-%m') AS start_date,
    strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS end_date, CASE WHEN o_orderstatus = 'P' THEN 'money' END AS why_stopped, has_results,
    CASE WHEN has_results THEN p END AS p FROM raw),
stats AS (SELECT *, CASE WHEN has_results THEN list_sort(p)[2] END AS median, len(list_filter(p, lambda x: x < 0.05::DOUBLE)) / 3 AS below, len(list_filter(p, lambda x: x > 0.2::DOUBLE)) / 3 AS above,
    list_min(p) AS lowest FROM trials),
labelled AS (SELECT *, {outcome_sql('median', 'below', 'above', 'lowest')} AS success FROM stats)"""


def trial_records(t) -> DataFrame:
    """Orders dressed up as nested trial records."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    end = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), "yyyy-MM-dd")
    status = F.to_json(F.struct(
        F.col("o_orderstatus").alias("overallStatus"), F.struct(month.alias("date")).alias("startDateStruct"),
        F.struct(end.alias("date"), F.lit("ESTIMATED").alias("type")).alias("completionDateStruct"),
        F.struct(F.lit("x").alias("type")).alias("primaryCompletionDateStruct"), F.when(F.col("o_orderstatus") == "P", "money").alias("whyStopped"),
    ))
    digit = F.left("o_orderpriority", F.lit(1))
    phases = F.when(digit == "1", F.array(F.lit("NA"))).otherwise(F.array(F.lit("NA"), F.lit("EARLY_PHASE1"), F.concat(F.lit("PHASE"), digit)))
    design = F.when(digit != "5", F.struct(phases.alias("phases")))

    def measure(*texts) -> F.Column:
        return F.struct(F.array(*[F.struct(x.alias("pValue")) for x in texts]).alias("analyses"))

    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    nothing = F.lit(None).cast("string")
    measures = F.array(
        measure(F.concat(F.lit("<0."), text(F.col("o_orderkey") * 7 % 100, 3)), F.lit("0.9")),
        measure(nothing, F.lit("0.5")),
        F.struct(F.lit(None).cast("array<struct<pValue:string>>").alias("analyses")),
        measure(F.concat(F.lit("p = 0."), text(F.col("o_custkey") % 60, 2))),
        measure(F.concat(F.lit("0."), text(F.col("o_orderkey") % 9, 1))),
        measure(F.lit("NS")),
    )
    # An order is a few bytes in its file, but much to write out and to parse.
    orders = dealt(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), ROWS_A_TASK // 8)
    return orders.select(
        (F.col("o_custkey") % 4 != 0).alias("hasResults"),
        F.struct(
            F.struct(F.concat(F.lit("NCT"), "o_orderkey").alias("nctId")).alias("identificationModule"), status.alias("statusModule"), design.alias("designModule")
        ).alias("protocolSection"),
        F.struct(F.struct(measures.alias("outcomeMeasures")).alias("outcomeMeasuresModule")).alias("resultsSection"),
    )


@query("trial_flatten", "B2 B1 P7 E15 E16 E7 E8 A12 A16", f"""
WITH {TRIALS} SELECT nct_id, status, phase, first_date, last_date, start_date, end_date, why_stopped, has_results,
  CASE WHEN has_results THEN array_to_string(list_transform(p, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') END AS p_values, median AS median_p_value, success FROM labelled""")
def trial_flatten(t) -> DataFrame:
    flat = R.flatten_trials(trial_records(t))
    text = F.array_join(F.transform("p_values", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",")
    return flat.withColumn("p_values", text)


EVIDENCE = f"""{TRIALS},
links AS (SELECT DISTINCT p_brand AS brand, l_suppkey, 'NCT' || l_orderkey AS nct_id FROM lineitem JOIN part ON l_partkey = p_partkey),
found AS (SELECT brand, l_suppkey, nct_id, success, phase, first_date, last_date FROM links LEFT JOIN labelled USING (nct_id)),
evidence AS (SELECT brand, l_suppkey, coalesce(string_agg(success || coalesce(CAST(phase AS VARCHAR), 'None'), ',' ORDER BY success || coalesce(CAST(phase AS VARCHAR), 'None')), '') AS evidence,
  coalesce(min(first_date), '9999') AS first_date, coalesce(max(last_date), '0000') AS last_date, max(phase) FILTER (success IS NOT NULL) AS top FROM found GROUP BY 1, 2),
votes AS (SELECT e.*, (SELECT count(*) FROM found f WHERE f.brand = e.brand AND f.l_suppkey = e.l_suppkey AND f.phase = e.top AND f.success = 'success') AS wins,
  (SELECT count(*) FROM found f WHERE f.brand = e.brand AND f.l_suppkey = e.l_suppkey AND f.phase = e.top AND f.success = 'fail') AS losses,
  CASE WHEN l_suppkey % 7 = 0 THEN '4.0' WHEN l_suppkey % 7 = 1 THEN NULL ELSE '2.0' END AS max_phase FROM evidence e)"""


def evidence(t) -> DataFrame:
    """Pairs of brand and supplier with the evidence of the orders that link them."""
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    links = t.lineitem.select("l_partkey", "l_suppkey", F.concat(F.lit("NCT"), "l_orderkey").alias("nct_id")).join(brands, "l_partkey")
    tasks = max(2, -(-t.lineitem.count() // ROWS_A_TASK))
    trials = keep_first(R.flatten_trials(trial_records(t)).repartition(tasks, "nct_id"), ["nct_id"], "first_date", "status")
    return R.pair_evidence(links, ["brand", "l_suppkey"], "nct_id", trials, tasks=tasks)


@query("pair_evidence", "J13 A9 A10 B3 E6 E23 O7", f"WITH {EVIDENCE} SELECT brand, l_suppkey, evidence, first_date, last_date FROM evidence")
def pair_evidence(t) -> DataFrame:
    return evidence(t).withColumn("evidence", F.array_join(R.evidence_list("evidence"), ","))


@query("pair_label", "A13 B5 E19", f"""
WITH {EVIDENCE}, seen AS (SELECT * REPLACE (CASE WHEN last_date < '2001-10' THEN last_date ELSE '2021' END AS last_date) FROM votes)
SELECT brand, l_suppkey, max_phase, top AS top_phase, CAST(wins AS INTEGER) AS wins, CAST(losses AS INTEGER) AS losses, last_date,
  CASE WHEN max_phase = '4.0' THEN true WHEN top >= 3 AND wins > 2 * losses THEN true WHEN losses > 2 * wins THEN false WHEN last_date < '2020' THEN false END AS overall_success
FROM seen""")
def pair_label(t) -> DataFrame:
    recent = F.when(F.col("last_date") < "2001-10", F.col("last_date")).otherwise("2021")
    key = F.col("l_suppkey") % 7
    made = evidence(t).withColumns({"last_date": recent, "max_phase": F.when(key == 0, "4.0").when(key != 1, "2.0")})
    labelled = R.label_pairs(made, max_phase="max_phase")
    return labelled.select("brand", "l_suppkey", "max_phase", "top_phase", "wins", "losses", "last_date", "overall_success")


@query("first_date_fallback", "A1 J4 E11 E12 B4", """
WITH f AS (SELECT l_partkey, l_suppkey, min(CASE WHEN l_returnflag = 'A' THEN '9999' ELSE strftime(l_shipdate, '%Y-%m') END) AS d FROM lineitem GROUP BY 1, 2),
y AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 1950 + p_size END AS approval FROM part)
SELECT l_partkey, l_suppkey, CASE WHEN d <> '9999' THEN d WHEN approval IS NOT NULL THEN CAST(approval AS VARCHAR) ELSE '0000' END AS first_trial_date
FROM f LEFT JOIN y ON l_partkey = p_partkey""")
def first_date_fallback(t) -> DataFrame:
    dated = t.lineitem.select(
        "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "9999").otherwise(F.date_format("l_shipdate", "yyyy-MM")).alias("first_date")
    )
    years = t.part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 3 != 0, 1950 + F.col("p_size")).cast("double").alias("first_approval"))
    return R.first_dates(dated, ["l_partkey", "l_suppkey"], "first_date", years, "l_partkey", "first_approval")


@query("drug_flatten", "B6 P1 P2 P4 P5 P6 E1 E13 E14 J14", """
WITH d AS (SELECT p_partkey, p_name, CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_partkey % 3 - 1 AS INTEGER) END AS a, CASE WHEN p_size <> 7 THEN p_size % 5 = 0 END AS w, p_size, p_type, p_retailprice FROM part),
k AS (SELECT l_partkey, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS act, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT l_partkey, act, string_agg(repeat('S' || l_suppkey || ' ', n), '' ORDER BY 'S' || l_suppkey) AS v FROM k GROUP BY 1, 2),
g AS (SELECT l_partkey, string_agg(act || ':' || v, ';' ORDER BY act) AS targets FROM m GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS drug_id, lower(p_name) AS drug_name, a AS availability_type, w AS withdrawn_flag, CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS biotherapeutic,
  CASE p_size % 4 - 1 WHEN 2 THEN 'achiral' WHEN 1 THEN 'single_enantiomer' WHEN 0 THEN 'mixture' END AS chirality,
  CASE WHEN p_size > 10 THEN p_retailprice END AS mass, CASE WHEN p_size < 40 THEN upper(p_name) END AS smiles, targets
FROM d LEFT JOIN g ON p_partkey = l_partkey WHERE coalesce(a > 0, false) OR (a IS NULL AND w = false) OR w IS NULL""")
def drug_flatten(t) -> DataFrame:
    drugs = t.part.select(
        F.col("p_partkey").cast("string").alias("molecule_chembl_id"), F.upper("p_name").alias("pref_name"),
        F.when(F.col("p_type") != "PROMO", (F.col("p_partkey") % 3 - 1).cast("int")).alias("availability_type"),
        F.when(F.col("p_size") != 7, F.col("p_size") % 5 == 0).alias("withdrawn_flag"), F.when(F.col("p_type") == "SMALL", "x").alias("biotherapeutic"),
        (F.col("p_size") % 4 - 1).alias("chirality"), F.when(F.col("p_size") > 10, F.struct(F.col("p_retailprice").alias("mass"))).alias("molecule_properties"),
        F.when(F.col("p_size") < 40, F.struct(F.upper("p_name").alias("smiles"))).alias("molecule_structures"), F.lit("gone").alias("helm_notation"),
    )
    mechanisms = t.lineitem.select(
        F.col("l_partkey").cast("string").alias("molecule_chembl_id"), F.nullif("l_returnflag", F.lit("N")).alias("action_type"),
        F.array(F.concat(F.lit("S"), "l_suppkey")).alias("uniprot_ids"),
    )
    flat = R.flatten_drugs(drugs, mechanisms, drop=["helm_notation"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("targets")), lambda e: F.concat(
        e["key"], F.lit(":"), F.array_join(F.transform(repeated_items(e["value"]), lambda v: F.concat(v, F.lit(" "))), ""))), ";")
    return flat.withColumn("targets", text)


@query("disease_flatten", "B7 E16 O5 P4", """
WITH s AS (SELECT s_suppkey, s_name, unnest([1, 2, 3]) AS i, unnest([s_acctbal, 4000.5, s_nationkey * 300.25]) AS score FROM supplier),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, i) AS place FROM s)
SELECT 'E' || s_suppkey AS disease_id, lower(s_name) AS disease_name, string_agg('P' || i || 'a,P' || i || 'c', ',' ORDER BY place) AS targets FROM k WHERE place <= 2 GROUP BY s_suppkey, s_name""")
def disease_flatten(t) -> DataFrame:
    def row(i: int, score) -> F.Column:
        ids = F.array(*[F.struct(F.lit(f"P{i}{x}").alias("id"), F.lit(src).alias("source")) for x, src in [("a", "uniprot_swissprot"), ("b", "ensembl"), ("c", "uniprot_swissprot")]])
        return F.struct(F.struct(F.lit(f"T{i}").alias("id"), ids.alias("proteinIds")).alias("target"), score.cast("double").alias("score"))

    rows = F.array(row(1, F.col("s_acctbal")), row(2, F.lit(4000.5)), row(3, F.col("s_nationkey") * 300.25))
    diseases = t.supplier.select(
        F.concat(F.lit("E"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("text").alias("description"), F.struct(rows.alias("rows")).alias("associatedTargets")
    )
    return R.flatten_diseases(diseases, top=2).select("disease_id", "disease_name", F.array_join("disease_targets", ",").alias("targets"))


@query("target_components", "E16 F8 F11 J1", """
WITH tc AS (SELECT s_suppkey, CASE WHEN s_nationkey % 4 < 2 THEN 'U' || s_suppkey || ',U' || s_suppkey || 'b' ELSE 'U' || s_suppkey END AS ids FROM supplier WHERE s_nationkey % 3 <> 0 AND s_nationkey % 4 <> 3)
SELECT l_partkey, l_suppkey, ids FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN tc ON l_suppkey = s_suppkey""")
def target_components(t) -> DataFrame:
    n = F.col("s_nationkey")
    xref = lambda suffix, src: F.struct(F.concat(F.lit("U"), "s_suppkey", F.lit(suffix)).alias("xref_id"), F.lit(src).alias("xref_src_db"))
    component = lambda *x: F.struct(F.array(*x).alias("target_component_xrefs"))
    other = component(xref("z", "PDB"))
    components = (
        F.when(n % 4 < 2, F.array(component(xref("", "UniProt"), xref("q", "GO")), other, component(xref("b", "UniProt"))))
        .when(n % 4 == 2, F.array(other, component(xref("", "UniProt")))).otherwise(F.array(other))
    )
    targets = t.supplier.select(
        F.col("s_suppkey").alias("target_chembl_id"), F.when(n % 3 != 0, "SINGLE PROTEIN").otherwise("ORGANISM").alias("target_type"), components.alias("target_components")
    )
    found = R.target_components(targets)
    return pairs(t).withColumnRenamed("l_suppkey", "target_chembl_id").join(found, "target_chembl_id").select(
        "l_partkey", F.col("target_chembl_id").alias("l_suppkey"), F.array_join("uniprot_ids", ",").alias("ids")
    )


MATRIX = f"""{PART_NATIONS}, {SUPPLIER_NATIONS},
a AS (SELECT l_partkey, list(nation) AS n FROM part_nations GROUP BY 1), b AS (SELECT l_suppkey, list(nation) AS n FROM supplier_nations GROUP BY 1),
facts AS (SELECT l_partkey, l_suppkey, CASE WHEN max(l_quantity) > 10 THEN max(l_quantity) > 30 END AS success, round(avg(l_tax), 6) + 0.0 AS mean_tax FROM lineitem GROUP BY 1, 2)"""


@query("feature_matrix", "B10 J3 X1 P8 P11 O7 F12", f"""
WITH {MATRIX}
SELECT l_partkey, l_suppkey, success, p_size, p_retailprice, p_size > 25 AS is_big, s_acctbal, mean_tax,
  round(len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)), 6) AS path_similarity
FROM facts JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN a USING (l_partkey) JOIN b USING (l_suppkey) WHERE success IS NOT NULL""")
def feature_matrix(t) -> DataFrame:
    facts = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"), r6(F.avg("l_tax")).alias("mean_tax"))
    labelled = facts.select("l_partkey", "l_suppkey", F.when(F.col("q") > 10, F.col("q") > 30).alias("success"))
    left = t.part.select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("is_big"), F.lit(1).alias("version")
    ).join(part_nations(t), "l_partkey")
    right = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal").join(supplier_nations(t), "l_suppkey")
    made = R.assemble_features(
        labelled, left, right, facts.select("l_partkey", "l_suppkey", "mean_tax"), "l_partkey", "l_suppkey", "success", "part_nations", "supplier_nations"
    )
    return made.withColumn("path_similarity", F.round("path_similarity", 6))


@query("condensed_pairs", "B11 J4 U4 X1 X2 E20", f"""
WITH {PAIRS}, {PART_NATIONS}, {SUPPLIER_NATIONS},
a AS (SELECT l_partkey, list(nation) AS n FROM part_nations GROUP BY 1), b AS (SELECT l_suppkey, list(nation) AS n FROM supplier_nations JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 1000 GROUP BY 1),
known AS (SELECT l_partkey, l_suppkey, max(l_returnflag) AS max_phase FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, max_phase, max_phase IS NOT NULL AS is_known, len(a.n) AS n_left_targets, coalesce(len(b.n), 0) AS n_right_targets,
  coalesce(len(list_intersect(a.n, b.n)), 0) AS n_shared_targets, coalesce(round(len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)), 6), 0) AS target_jaccard
FROM pairs LEFT JOIN a USING (l_partkey) LEFT JOIN b USING (l_suppkey) LEFT JOIN known USING (l_partkey, l_suppkey)""")
def condensed_pairs(t) -> DataFrame:
    known = t.lineitem.filter(F.col("l_quantity") > 30).groupBy("l_partkey", "l_suppkey").agg(F.max("l_returnflag").alias("max_phase"))
    solvent = t.supplier.filter(F.col("s_acctbal") > 1000).select(F.col("s_suppkey").alias("l_suppkey"))
    right = supplier_nations(t).join(solvent, "l_suppkey")
    made = R.condensed_pairs(pairs(t), part_nations(t), right, known, "l_partkey", "l_suppkey", "part_nations", "supplier_nations")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_left_targets", "n_right_targets", "n_shared_targets")]
    return made.select("l_partkey", "l_suppkey", "max_phase", "is_known", *counts, F.round("target_jaccard", 6).alias("target_jaccard"))
