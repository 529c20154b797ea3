"""Features, similarity and projections."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.arrays import norm
from ...functions.text import joined
from ...operators import features as X
from ...operators.columns import numbered
from ...operators.filters import beyond, members_of
from ...operators.sets import stacked
from ...operators.setjoin import alike
from ...operators.similarity import nearest
from ...session import cut_lineage, dealt
from ..registry import query
from .common import PAIRS, PART_NATIONS, SUPPLIER_NATIONS, pairs, part_nations, r6, supplier_nations


@query("multi_hot", "X3", "SELECT l_partkey, " + ", ".join(
    f"CAST(count(*) FILTER (l_returnflag || l_linestatus = '{c}') > 0 AS INTEGER) AS cat_{c}" for c in ["AF", "AO", "NF", "NO", "RF", "RO"]) + " FROM lineitem GROUP BY 1")
def multi_hot(t) -> DataFrame:
    sets = t.lineitem.groupBy("l_partkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("cats"))
    return X.multi_hot(sets, "cats", ["AF", "AO", "NF", "NO", "RF", "RO"])


@query("multi_hot_rows", "X3", """
WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 30), i AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS place FROM (SELECT DISTINCT l_suppkey FROM o))
SELECT p_partkey, coalesce(string_agg(place, ',' ORDER BY place), '') AS indices FROM part LEFT JOIN (SELECT * FROM o JOIN i USING (l_suppkey)) ON p_partkey = l_partkey GROUP BY 1""")
def multi_hot_rows(t) -> DataFrame:
    """As many classes as there are suppliers, so rows are lists of indices instead of columns."""
    sold = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("ids"))
    rows, _ = X.multi_hot_rows(t.part.select("p_partkey").join(sold, "p_partkey", "left"), "p_partkey", "ids")
    return rows.select("p_partkey", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


@query("one_hot_rows", "X4", """
WITH n AS (SELECT p_partkey, nullif(p_name, (SELECT min(p_name) FROM part)) AS name FROM part), i AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS place FROM (SELECT DISTINCT name FROM n WHERE name IS NOT NULL))
SELECT p_partkey, place AS "index" FROM n LEFT JOIN i USING (name)""")
def one_hot_rows(t) -> DataFrame:
    least = t.part.agg(F.min("p_name")).scalar()
    rows, _ = X.one_hot_rows(t.part.select("p_partkey", F.nullif(F.col("p_name"), least).alias("name")), "p_partkey", "name")
    return rows


@query("one_hot_baseline", "X4", "SELECT p_partkey, " + ", ".join(
    f"coalesce(CAST(ty = '{v}' AS INTEGER), 0) AS ty__{v}" for v in ["LARGE", "MEDIUM", "PROMO", "STANDARD"])
    + ", CAST(ty IS NULL AS INTEGER) AS ty__nan FROM (SELECT p_partkey, nullif(p_type, 'SMALL') AS ty FROM part)")
def one_hot_baseline(t) -> DataFrame:
    return X.one_hot(t.part.select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("ty")), "ty", ["LARGE", "MEDIUM", "PROMO", "STANDARD", "ECONOMY"])


@query("token_counts", "X5", """
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_-]+')) AS term FROM documents) GROUP BY 1, 2""")
def token_counts(t) -> DataFrame:
    return X.token_counts(documents_by_id(t), "doc_id", "text")


def documents_by_id(t) -> DataFrame:
    """Texts are shuffled once instead of their tokens, which are then counted in place."""
    return dealt(t.documents.select("doc_id", "text"), DOCUMENTS_A_TASK, "doc_id")


@query("token_tfidf", "X5 X6 E5", """
WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_-]+')) AS term FROM documents) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT doc_id, term, tf, df, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS raw FROM c JOIN d USING (term))
SELECT doc_id, term, tf, df, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""")
def token_tfidf(t) -> DataFrame:
    n = t.documents.agg(F.count("*")).scalar()
    weights = X.tfidf(X.token_counts(documents_by_id(t), "doc_id", "text"), "doc_id", n)
    return weights.withColumn("weight", r6("weight"))


def entity_texts(t) -> DataFrame:
    """Both sides of the pairs as one corpus of id lists written out as text."""
    codes = lambda c: joined(F.transform(c, lambda n: F.concat(F.lit("N-"), n)))
    left = part_nations(t).select(F.concat(F.lit("part-"), "l_partkey").alias("entity"), codes("part_nations").alias("text"))
    right = supplier_nations(t).select(F.concat(F.lit("supplier-"), "l_suppkey").alias("entity"), codes("supplier_nations").alias("text"))
    return stacked(left, right)


@query("svd_scores", "X5 X6 X7 P10 U1")
def svd_scores(t) -> DataFrame:
    weights = X.tfidf(X.token_counts(entity_texts(t), "entity", "text"), "entity")
    scores, values, _ = X.truncated_svd(weights, "entity", "term", 50)
    return numbered(scores.withColumn("latent", F.transform("latent", lambda x: r6(x))), "latent", "path_", len(values))


@query("svd_plane", "X7", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity / 50) AS a, max(l_extendedprice / 100000) AS b FROM lineitem GROUP BY 1, 2, 3, 4),
g AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM x),
e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS v FROM g),
w AS (SELECT ab / sqrt(ab * ab + (v - aa) ** 2) AS p, (v - aa) / sqrt(ab * ab + (v - aa) ** 2) AS q FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a * p + b * q, 5) + 0.0 AS first, round(abs(b * p - a * q), 5) + 0.0 AS second FROM x, w""")
def svd_plane(t) -> DataFrame:
    """A matrix of two columns, whose components have a closed form."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cells = F.array(*[F.struct(F.lit(n).alias("term"), c.alias("weight")) for n, c in (("a", F.col("l_quantity") / 50), ("b", F.col("l_extendedprice") / 100000))])
    entries = t.lineitem.select(F.concat_ws("-", *keys).alias("row"), F.explode(cells).alias("c")).groupBy("row", "c.term").agg(F.max("c.weight").alias("weight"))
    scores, _, _ = X.truncated_svd(entries, "row", "term", 2)
    named = t.lineitem.select(*keys, F.concat_ws("-", *keys).alias("row")).distinct().join(scores, "row")
    return named.select(*keys, (F.round(F.get("latent", F.lit(0)), 5) + F.lit(0.0)).alias("first"), (F.round(F.abs(F.get("latent", F.lit(1))), 5) + F.lit(0.0)).alias("second"))


@query("svd_spectrum", "X7", """
WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice / 100000 * pow(0.8, datediff('month', DATE '1992-01-01', o_orderdate)) AS w FROM orders),
v AS (SELECT month, sqrt(sum(w * w)) AS value, row_number() OVER (ORDER BY sum(w * w) DESC) AS component FROM m GROUP BY 1)
SELECT o_orderkey, CAST(component AS INTEGER) AS component, round(w, 5) AS score, round(value, 5) AS value FROM m JOIN v USING (month) WHERE component <= 5""")
def svd_spectrum(t) -> DataFrame:
    """Every order weighs on its month alone: the columns are orthogonal, so the values are their lengths. There are more months than vectors
    in the iteration, which has to find the first five."""
    months = F.floor(F.months_between(F.trunc("o_orderdate", "month"), F.lit("1992-01-01").cast("date")))
    entries = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_totalprice") / 100000 * F.pow(F.lit(0.8), months)).alias("weight"))
    scores, values, _ = X.truncated_svd(entries, "o_orderkey", "month", 5)
    cells = scores.select("o_orderkey", F.posexplode("latent").alias("at", "score")).where("abs(score) > 1e-9")
    known = F.array(*[F.lit(float(v)) for v in values])
    return cells.select("o_orderkey", (F.col("at") + 1).alias("component"), (F.round("score", 5) + F.lit(0.0)).alias("score"), F.round(F.get(known, "at"), 5).alias("value"))


@query("explained_variance", "X8", """
WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*) / (count(*) - 1.0::DOUBLE) AS f FROM lineitem)
SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio, round(sqrt(f * (1 + r) / 2), 6) AS loading, true AS strong FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6), round(sqrt(f * (1 - r) / 2), 6), true FROM r""")
def explained_variance(t) -> DataFrame:
    """Two standardized columns: the ratios are (1 +- r) / 2, the loadings of both columns on an axis the root of its ratio."""
    rows = X.standardized(line_features(t, ["l_quantity", "l_extendedprice"]))
    _, ratios, loadings = X.principal_components(rows, 2, vector="scaled")
    strong = X.strong_loadings(loadings, ["l_quantity", "l_extendedprice"])
    found = [(i + 1, float(ratios[i]), float(np.abs(loadings[0, i])), len(strong) == 2) for i in range(2)]
    made = t.spark.createDataFrame(found, "component int, ratio double, loading double, strong boolean")
    return made.select("component", F.round("ratio", 6).alias("ratio"), F.round("loading", 6).alias("loading"), "strong")


def vectors(t) -> DataFrame:
    return t.embeddings.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("pca_scores", "X8 P10")
def pca_scores(t) -> DataFrame:
    scored, _, _ = X.principal_components(X.standardized(vectors(t)), 5, vector="scaled")
    return numbered(scored.select("vec_id", "label", "components"), "components", "pc_", 5)


@query("pca_outliers", "X16 F14")
def pca_outliers(t) -> DataFrame:
    scored, _, _ = X.principal_components(X.standardized(vectors(t)), 2, vector="scaled")
    spread = scored.select("vec_id", "label", F.abs(F.get("components", F.lit(0))).alias("away"))
    return beyond(spread, "away", 2.5, "vec_id")


@query("plane_outliers", "X16 X8 F14", """
WITH s AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
z AS (SELECT l_suppkey, n, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS a, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS b FROM s),
o AS (SELECT l_suppkey FROM z WHERE abs(a + (SELECT sign(corr(a, b)) FROM z) * b) / sqrt(2) > 1.5)
SELECT l_suppkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM o) GROUP BY 1""")
def plane_outliers(t) -> DataFrame:
    """Suppliers far out on the first axis of two standardized columns, whose direction is known, and their lines."""
    sides = t.lineitem.groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    scored, _, _ = X.principal_components(X.standardized(X.assembled(sides, ["n", "q"])), 1, vector="scaled")
    far = scored.select("l_suppkey", F.abs(F.get("components", F.lit(0))).alias("away")).where("away > 1.5")
    lines = members_of(t.lineitem.select("l_suppkey", "l_quantity"), "l_suppkey", far.select("l_suppkey"))
    return lines.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("standardize", "X9", """
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS balance,
  round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6) + 0.0 AS nation FROM customer""")
def standardize(t) -> DataFrame:
    rows = X.assembled(t.customer.withColumn("n", F.col("c_nationkey").cast("double")), ["c_acctbal", "n"])
    from pyspark.ml.functions import vector_to_array

    scaled = X.standardized(rows.select("c_custkey", "features")).select("c_custkey", vector_to_array("scaled").alias("s"))
    return scaled.select("c_custkey", r6(F.get("s", F.lit(0))).alias("balance"), r6(F.get("s", F.lit(1))).alias("nation"))


def nearest_sql(distance: str, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS other_id, round({distance}, 6) + 0.0 AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, other_id) AS INTEGER) AS rank FROM d) WHERE rank <= {k}"""


def neighbours(t, k: int, metric: str, **how) -> DataFrame:
    other = t.embeddings.withColumnRenamed("vec_id", "other_id")
    return nearest(t.embeddings, other, "vec_id", "other_id", "embedding", "embedding", k, metric, exclude_same=True, **how)


@query("cosine_topk", "X10 J12 O4", nearest_sql("1 - list_cosine_similarity(a.v, b.v)", 5))
def cosine_topk(t) -> DataFrame:
    return neighbours(t, 5, "cosine")


@query("nearest_euclidean", "X12", nearest_sql("list_distance(a.v, b.v)", 10))
def nearest_euclidean(t) -> DataFrame:
    return neighbours(t, 10, "euclidean")


@query("nearest_manhattan", "X12 M9", nearest_sql("list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))", 7))
def nearest_manhattan(t) -> DataFrame:
    return neighbours(t, 7, "manhattan")


@query("nearest_cells", "X12 X10 J12", nearest_sql("list_distance(a.v, b.v)", 3))
def nearest_cells(t) -> DataFrame:
    """Many cells, rings and blocks, as large tables have them: both rounds and every bound are at work."""
    return neighbours(t, 3, "euclidean", pivots=16, block=64)


@query("text_vectors", "X11", """
WITH c AS (SELECT doc_id, list_transform(string_split(lower(text), ''), lambda x: unicode(x)) AS c FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 256)) AS place FROM c WHERE len(c) >= 3),
n AS (SELECT doc_id, place, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, CAST(place AS INTEGER) AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM n""")
def text_vectors(t) -> DataFrame:
    made = X.text_vectors(t.documents.select("doc_id", "text"), "text")
    return made.select("doc_id", F.posexplode("vector").alias("place", "weight")).where("weight > 0").select("doc_id", "place", r6("weight").alias("weight"))


class LetterCounts:
    """An encoder that counts some letters and the length of a text."""

    def __init__(self, letters: str = "aeo"):
        self.letters = letters

    def __call__(self, texts):
        return [[*[text.count(c) for c in self.letters], len(text)] for text in texts]


@query("encoded_names", "X11", """
WITH x AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x FROM part)
SELECT p_partkey, (length(x) - length(replace(x, 'a', '')))::DOUBLE AS a, (length(x) - length(replace(x, 'e', '')))::DOUBLE AS e, (length(x) - length(replace(x, 'o', '')))::DOUBLE AS o, length(x)::DOUBLE AS size FROM x""")
def encoded_names(t) -> DataFrame:
    """An encoder of one's own, built once per worker; many parts share a text."""
    made = X.text_vectors(t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), "text", LetterCounts)
    return made.select("p_partkey", *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(["a", "e", "o", "size"])])


#: Structures whose fingerprints one task makes and unfolds.
STRUCTURES_A_TASK = 1 << 14
#: Documents whose tokens one task counts.
DOCUMENTS_A_TASK = 1 << 12


def structures(t) -> DataFrame:
    return dealt(t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")), STRUCTURES_A_TASK)


@query("structure_bits", "X13", """
WITH c AS (SELECT p_partkey, list_transform(string_split(concat_ws(' ', p_name, p_type, p_brand), ''), lambda x: unicode(x)) AS c FROM part)
SELECT DISTINCT p_partkey, CAST(unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 2048)) AS INTEGER) AS bit FROM c WHERE len(c) >= 3""")
def structure_bits(t) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    made = X.fingerprints(structures(t), "text").select("p_partkey", F.posexplode(vector_to_array("fingerprint")).alias("bit", "set"))
    return made.where("set > 0").select("p_partkey", "bit")


@query("tanimoto_pairs", "X13", """
WITH c AS (SELECT p_partkey, list_transform(string_split(concat_ws(' ', p_name, p_type, p_brand), ''), lambda x: unicode(x)) AS c FROM part),
s AS (SELECT p_partkey, list_sort(list_distinct(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 2048))) AS bits FROM c WHERE len(c) >= 3),
d AS (SELECT min(p_partkey) AS k, count(*) AS n, bits FROM s GROUP BY bits),
p AS (SELECT a.k AS "left", b.k AS "right", a.n AS n_left, b.n AS n_right, len(list_intersect(a.bits, b.bits))::INTEGER AS shared, len(a.bits) + len(b.bits) AS sizes
  FROM d a JOIN d b ON a.k < b.k AND least(len(a.bits), len(b.bits)) >= 0.75 * greatest(len(a.bits), len(b.bits)))
SELECT "left", "right", n_left, n_right, shared, round(shared / (sizes - shared)::DOUBLE, 6) AS similarity FROM p WHERE shared >= 0.75 * (sizes - shared)""")
def tanimoto_pairs(t) -> DataFrame:
    """All pairs of different fingerprints that share three quarters of their bits, each under its smallest part."""
    return alike(structure_bits(t), "p_partkey", "bit", 0.75).withColumn("similarity", r6("similarity"))


@query("fingerprint_components", "X13 X8 P10")
def fingerprint_components(t) -> DataFrame:
    scored, _, _ = X.principal_components(X.fingerprints(structures(t), "text"), 100, vector="fingerprint")
    return numbered(scored.select("p_partkey", "components"), "components", "FP_", 100, start=1)


@query("lda_axis", "X14")
def lda_axis(t) -> DataFrame:
    two = vectors(t).withColumn("side", (F.col("label") >= 5).cast("int"))
    return X.discriminant_axis(two, "features", "side")[0].select("vec_id", "side", "discriminant")


@query("pls_axes", "X15")
def pls_axes(t) -> DataFrame:
    return X.pls_axes(vectors(t), "features", "label", 2)[0].select("vec_id", "label", "pls_0", "pls_1")


def weights_sql(corpus: str) -> str:
    """TF-IDF weights of a corpus of (entity, nation) rows."""
    return f"""c AS ({corpus}), d AS (SELECT nation, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT entity, nation, ln((1 + (SELECT count(DISTINCT entity) FROM c))::DOUBLE / (1 + df)) + 1 AS raw FROM c JOIN d USING (nation)),
w AS (SELECT entity, nation, raw / sqrt(sum(raw * raw) OVER (PARTITION BY entity)) AS weight FROM r)"""


CORPUS = "SELECT 'part-' || l_partkey AS entity, nation FROM part_nations UNION ALL SELECT 'supplier-' || l_suppkey, nation FROM supplier_nations"


@query("latent_similarity", "X7 X6 X10 U1", f"""
WITH {PAIRS}, {PART_NATIONS}, {SUPPLIER_NATIONS}, {weights_sql(CORPUS)},
s AS (SELECT a.entity AS a, b.entity AS b, sum(a.weight * b.weight) AS v FROM w a JOIN w b USING (nation)
  WHERE starts_with(a.entity, 'part-') AND starts_with(b.entity, 'supplier-') GROUP BY 1, 2)
SELECT 'part-' || l_partkey AS "left", 'supplier-' || l_suppkey AS "right", round(coalesce(v, 0), 6) + 0.0 AS similarity
FROM pairs LEFT JOIN s ON a = 'part-' || l_partkey AND b = 'supplier-' || l_suppkey""")
def latent_similarity(t) -> DataFrame:
    """With 50 components for the 25 nations, latent vectors keep every product of the TF-IDF rows."""
    weights = X.tfidf(X.token_counts(entity_texts(t), "entity", "text"), "entity")
    scores = cut_lineage(X.truncated_svd(weights, "entity", "term", 50)[0])
    asked = pairs(t).select(F.concat(F.lit("part-"), "l_partkey").alias("left"), F.concat(F.lit("supplier-"), "l_suppkey").alias("right"))
    found = X.pair_cosine(asked, scores.withColumnRenamed("entity", "left"), scores.withColumnRenamed("entity", "right"), "left", "right", "latent", "latent")
    return found.withColumn("similarity", r6("similarity"))


@query("component_lengths", "X8 X9", """
WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT vec_id, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM e)
SELECT vec_id, round(sqrt(sum(z * z)), 6) AS length FROM z GROUP BY 1""")
def component_lengths(t) -> DataFrame:
    """All components together keep the length of every standardized row."""
    scored, _, _ = X.principal_components(X.standardized(vectors(t)), 64, vector="scaled")
    return scored.select("vec_id", r6(norm("components")).alias("length"))


def line_features(t, names: list[str], *more) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return X.assembled(t.lineitem.select(*keys, *names, *more), names)


@query("lda_plane", "X14", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, l_extendedprice AS b, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
m AS (SELECT avg(a) AS a, avg(b) AS b, avg(a) FILTER (y = 1) - avg(a) FILTER (y = 0) AS da, avg(b) FILTER (y = 1) - avg(b) FILTER (y = 0) AS db, count(*) AS n FROM x),
c AS (SELECT y, avg(a) AS a, avg(b) AS b FROM x GROUP BY 1),
s AS (SELECT sum((x.a - c.a) ** 2) / (count(*) - 2) AS aa, sum((x.b - c.b) ** 2) / (count(*) - 2) AS bb, sum((x.a - c.a) * (x.b - c.b)) / (count(*) - 2) AS ab FROM x JOIN c USING (y)),
w AS (SELECT (bb * da - ab * db) / (aa * bb - ab * ab) AS wa, (aa * db - ab * da) / (aa * bb - ab * ab) AS wb, m.a, m.b, aa, bb, ab FROM m, s),
u AS (SELECT *, sqrt(wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb) AS len FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((x.a - u.a) * wa + (x.b - u.b) * wb) / len, 4) + 0.0 AS discriminant FROM x, u""")
def lda_plane(t) -> DataFrame:
    rows = line_features(t, ["l_quantity", "l_extendedprice"], (F.col("l_returnflag") == "R").cast("int").alias("y"))
    scored, _ = X.discriminant_axis(rows, "features", "y")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round("discriminant", 4) + F.lit(0.0)).alias("discriminant"))


@query("pls_plane", "X15", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS a,
  (l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER () AS b, (l_linenumber - avg(l_linenumber) OVER ()) / stddev_samp(l_linenumber) OVER () AS c,
  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS y FROM lineitem),
w1 AS (SELECT sum(a * y) AS a, sum(b * y) AS b, sum(c * y) AS c FROM x), n1 AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM w1),
t1 AS (SELECT x.*, (x.a * n1.a + x.b * n1.b + x.c * n1.c) / l AS t FROM x, n1),
p1 AS (SELECT sum(a * t) / sum(t * t) AS a, sum(b * t) / sum(t * t) AS b, sum(c * t) / sum(t * t) AS c, sum(y * t) / sum(t * t) AS y FROM t1),
x2 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t, t1.a - t * p1.a AS a, t1.b - t * p1.b AS b, t1.c - t * p1.c AS c, t1.y - t * p1.y AS y FROM t1, p1),
w2 AS (SELECT sum(a * y) AS a, sum(b * y) AS b, sum(c * y) AS c FROM x2), n2 AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM w2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(t, 4) + 0.0 AS pls_0, round((x2.a * n2.a + x2.b * n2.b + x2.c * n2.c) / l, 4) + 0.0 AS pls_1 FROM x2, n2""")
def pls_plane(t) -> DataFrame:
    rows = X.assembled(t.lineitem.withColumn("line", F.col("l_linenumber").cast("double")), ["l_quantity", "l_discount", "line"])
    scored, _ = X.pls_axes(rows, "features", "l_extendedprice", 2)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("pls_0", "pls_1")])
