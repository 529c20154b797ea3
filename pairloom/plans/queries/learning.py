"""Classifiers, evaluation and interpretation, on the labelled documents and the trade graph."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.arrays import dot
from ...operators import boosting as B
from ...operators import evaluate as V
from ...operators import graph as N
from ...operators import models as M
from ...operators.ordering import stratified_folds, stratified_split, time_split
from ...operators.similarity import nearest, vote_of_neighbours
from ...operators.sets import stacked
from ...session import cut_and_spread, cut_lineage, shared_dir
from ..registry import query
from .common import PART_NATIONS, SUPPLIER_NATIONS, r6
from .linking import token_edges, trade_graph

SCORED = """scored AS (SELECT l.doc_id, l.quality, l.toxic, n_chars, round(n_chars / (n_chars + 1500.0), 2) AS score,
  CASE WHEN round(n_chars / (n_chars + 1500.0), 2) >= 0.4 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(t) -> DataFrame:
    """Labelled documents with a closed-form score (many ties) and the class it predicts."""
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 2)
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("score", score)
    return rows.withColumn("predicted", (F.col("score") >= 0.4).cast("int"))


@query("confusion", "V1", f"WITH {SCORED} SELECT quality, predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion(t) -> DataFrame:
    return V.confusion(scored(t), "quality", "predicted")


@query("classification_scores", "V2", f"""
WITH {SCORED}, c AS (SELECT count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality = 0 AND predicted = 1) AS fp,
  count(*) FILTER (quality = 1 AND predicted = 0) AS fn, count(*) FILTER (quality = 0 AND predicted = 0) AS tn FROM scored)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_scores(t) -> DataFrame:
    found = V.scores(scored(t), "quality", "predicted")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


POINTS = f"""{SCORED}, g AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM scored GROUP BY 1),
k AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY score DESC))"""


@query("roc_curve", "V3", f"WITH {POINTS} SELECT score AS threshold, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr FROM k")
def roc_curve(t) -> DataFrame:
    return V.roc_curve(scored(t), "score", "quality").select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("pr_curve", "V4", f"""WITH {POINTS} SELECT score AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / ap, 6) AS recall FROM k""")
def pr_curve(t) -> DataFrame:
    made = V.precision_recall_curve(scored(t), "score", "quality")
    return made.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("ranking_metrics", "V3 V4", f"""WITH {POINTS} SELECT round(sum(n * (tp - p / 2.0)) / (max(ap)::DOUBLE * max(an)), 6) AS roc_auc,
  round(sum(p * (tp / (tp + fp))) / max(ap), 6) AS average_precision, round(max(ap) / (max(ap) + max(an)), 6) AS positive_rate FROM k""")
def ranking_metrics(t) -> DataFrame:
    found = V.ranking_metrics(scored(t), "score", "quality")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("case_table", "V8 E19", f"""
WITH {SCORED}, c AS (SELECT *, CASE WHEN quality = predicted THEN 'T' ELSE 'F' END || CASE WHEN predicted = 1 THEN 'P' ELSE 'N' END AS cs FROM scored)
SELECT doc_id, quality, predicted, cs AS "case", CASE WHEN cs IN ('TP', 'TN') THEN 1 ELSE 0 END AS correct, {', '.join(f"CASE WHEN cs = '{x}' THEN 1 ELSE 0 END AS {x}" for x in ('TP', 'TN', 'FP', 'FN'))} FROM c""")
def case_table(t) -> DataFrame:
    return V.case_table(scored(t).select("doc_id", "quality", "predicted"), "quality", "predicted")


@query("case_correlations", "V9 A17", f"WITH {SCORED}, c AS (SELECT *, CAST(quality = predicted AS INTEGER) AS ok FROM scored) " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(corr({f}, ok), 6) AS correct, round(corr({f}, quality * predicted), 6) AS \"TP\", round(corr({f}, (1 - quality) * (1 - predicted)), 6) AS \"TN\", "
    f"round(corr({f}, (1 - quality) * predicted), 6) AS \"FP\", round(corr({f}, quality * (1 - predicted)), 6) AS \"FN\" FROM c" for f in ("n_chars", "toxic")))
def case_correlations(t) -> DataFrame:
    made = V.case_correlations(V.case_table(scored(t), "quality", "predicted"), ["n_chars", "toxic"])
    return made.select("feature", *[F.round(c, 6).alias(c) for c in V.CASE_FLAGS])


@query("case_distributions", "V10 A20", f"WITH {SCORED} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(quality = predicted AS INTEGER) AS correct, count(*) AS n, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS deviation, "
    f"CAST(min({f}) AS DOUBLE) AS low, CAST(max({f}) AS DOUBLE) AS high, CAST(quantile_disc({f}, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc({f}, 0.5) AS DOUBLE) AS q2, CAST(quantile_disc({f}, 0.75) AS DOUBLE) AS q3 FROM scored GROUP BY 2" for f in ("n_chars", "toxic")))
def case_distributions(t) -> DataFrame:
    made = V.case_distributions(V.case_table(scored(t), "quality", "predicted"), ["n_chars", "toxic"])
    return made.select("feature", "correct", "n", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"), "low", "high", *[F.get("quartiles", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])


FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share"]


def document_features(t) -> DataFrame:
    """Labelled documents with a few numbers about their whole text."""
    size = F.greatest(F.length("text"), F.lit(1))
    stats = t.documents.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / size).alias("digit_share"),
        (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / size).alias("upper_share"),
    )
    return t.labels.select("doc_id", F.col("quality").cast("double").alias("quality")).join(stats, "doc_id")


FOLDS = 5


def folded(t) -> DataFrame:
    """Labelled documents with a fold each, written once, as every fit reads them."""
    return cut_and_spread(stratified_folds(cut_lineage(document_features(t)), "quality", FOLDS, "doc_id"))


@query("model_logreg", "M1 M2 M10 M11 O12 A18")
def model_logreg(t) -> DataFrame:
    """The whole grid of one model."""
    return M.summary(t.spark, [M.grid_search(folded(t), "logreg", FEATURES, "quality", "fold")])


LIMITS = [200, 900, 2500, 9000]


@query("rule_search", "M10 M11 O12 E24", """
WITH r AS (SELECT l.doc_id, quality, n_chars, (row_number() OVER (PARTITION BY quality ORDER BY l.doc_id) - 1) * 5 // count(*) OVER (PARTITION BY quality) AS fold FROM labels l JOIN documents USING (doc_id)),
c AS (SELECT least, fold, count(*) FILTER (quality = 1 AND n_chars >= least) AS tp, count(*) FILTER (quality = 0 AND n_chars >= least) AS fp, count(*) FILTER (quality = 1 AND n_chars < least) AS fn
  FROM r, (SELECT unnest([200, 900, 2500, 9000]) AS least) GROUP BY ALL),
m AS (SELECT least, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)) AS m, stddev_pop(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)) AS s FROM c GROUP BY 1)
SELECT 'least = ' || least AS params, round(m, 6) AS mean_score, round(s, 6) AS std_score, m = max(m) OVER () AS best,
  CASE WHEN m = max(m) OVER () THEN (SELECT count(*) FROM r WHERE n_chars >= least) END AS n_good FROM m""")
def rule_search(t) -> DataFrame:
    """The search over fixed rules in the place of models: folds, scores, means, deviations, the winner and what it predicts after the refit."""
    rows = cut_lineage(t.labels.select("doc_id", F.col("quality").cast("double").alias("quality")).join(t.documents.select("doc_id", "n_chars"), "doc_id"))
    train = cut_lineage(stratified_folds(rows, "quality", FOLDS, "doc_id"))
    rules = [Pipeline(stages=[SQLTransformer(statement=f"SELECT *, CAST(n_chars >= {least} AS DOUBLE) AS prediction FROM __THIS__")]) for least in LIMITS]
    found = M.search_pipelines(train, "logreg", [{"least": least} for least in LIMITS], rules, "quality", "fold")
    best = M.summary(t.spark, [found]).select("params", F.lit(True).alias("best")).withColumn("n_good", F.lit(found.best.transform(train).where("prediction = 1").count()).cast("long"))
    tried = t.spark.createDataFrame([(f"least = {r['params']['least']}", r["mean_score"], r["std_score"]) for r in found.rows], "params string, mean_score double, std_score double")
    return tried.join(best, "params", "left").select("params", r6("mean_score").alias("mean_score"), r6("std_score").alias("std_score"), F.coalesce("best", F.lit(False)).alias("best"), "n_good")


CELLS = """x AS (SELECT CASE WHEN l_extendedprice > 60000 THEN 'high' WHEN l_extendedprice > 30000 THEN 'mid' ELSE 'low' END AS price, (l_extendedprice * (1 - l_discount) + 1000 * l_quantity > 70000)::INT AS y FROM lineitem),
n AS (SELECT count(*) AS n, sum(y) AS n1, stddev_samp((price = 'mid')::INT) AS s_mid, stddev_samp((price = 'high')::INT) AS s_high FROM x),
g AS (SELECT price, count(*) AS k, sum(y) AS k1, sum(y) * (SELECT n / (2.0::DOUBLE * n1) FROM n) AS w1, (count(*) - sum(y)) * (SELECT n / (2.0::DOUBLE * (n - n1)) FROM n) AS w0 FROM x GROUP BY 1)"""


def price_model(t):
    """A logistic model with balanced classes and next to no penalty on three classes of prices, a column for all but the first."""
    worth = F.col("l_extendedprice") * (1 - F.col("l_discount")) + 1000 * F.col("l_quantity")
    price = F.when(F.col("l_extendedprice") > 60000, "high").when(F.col("l_extendedprice") > 30000, "mid").otherwise("low")
    rows = t.lineitem.select((worth > 70000).cast("int").alias("y"), price.alias("price"))
    rows = cut_lineage(rows.withColumns({c: (F.col("price") == c).cast("double") for c in ("mid", "high")}))
    stages = [*M.preprocessing(["mid", "high"]), *M.classifier("logreg", {"C": 1e9}, rows.count(), "y", "class_weight")]
    return Pipeline(stages=stages).fit(rows), rows


@query("logit_cells", "M1 M2 M12 M13 A18", f"WITH {CELLS} SELECT price, k AS n, k1::BIGINT AS positives, round(w1 / (w1 + w0), 3) AS score FROM g")
def logit_cells(t) -> DataFrame:
    """One coefficient a class of prices, so the fitted chance of a class is its weighted share of positives: the optimum in closed form.
    The model is saved and loaded in between."""
    model, rows = price_model(t)
    path = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    M.save_model(model, path)
    scored = M.score_table(M.load_model(path), rows, ["price", "y"])
    return scored.groupBy("price").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.round(F.avg("score"), 3).alias("score"))


@query("logit_importance", "V11", f"""WITH {CELLS}, o AS (SELECT max(ln(w1 / w0)) FILTER (price = 'low') AS low, max(ln(w1 / w0)) FILTER (price = 'mid') AS mid, max(ln(w1 / w0)) FILTER (price = 'high') AS high FROM g)
SELECT 'mid' AS feature, round(abs(mid - low) * s_mid, 3) AS importance FROM o, n UNION ALL SELECT 'high', round(abs(high - low) * s_high, 3) FROM o, n""")
def logit_importance(t) -> DataFrame:
    """Absolute coefficients of standardized columns: differences of log odds between classes, times the columns' deviations."""
    model, _ = price_model(t)
    return V.model_importance(t.spark, model, ["mid", "high"]).select("feature", F.round("importance", 3).alias("importance"))


@query("model_trees", "M3 M4 M5 M10 M11")
def model_trees(t) -> DataFrame:
    """The published grids are ``models.GRIDS``: that of ``xgb`` in full but for the numbers of trees, small ones of the kinds that are fitted one by one."""
    train = folded(t)
    return M.summary(t.spark, [
        M.grid_search(train, "rf", FEATURES, "quality", "fold", {"n_estimators": [20], "max_depth": [5], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]}),
        M.grid_search(train, "gb", FEATURES, "quality", "fold", {"n_estimators": [10], "max_depth": [3], "learning_rate": [0.1]}),
        M.grid_search(train, "xgb", FEATURES, "quality", "fold", M.GRIDS["xgb"] | {"n_estimators": [4, 12]}),
    ])


CELL_ROUND = "SELECT x1, x2, n, pos, m - rate * (n / (1 + exp(-m)) - pos) / (n / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) + 1) AS m, rate FROM "


@query("boosted_cells", "M5", f"""
WITH x AS (SELECT *, (l_extendedprice > 50000)::INT AS x1, (l_quantity > 25)::INT AS x2, l_extendedprice * (1 - l_discount) + 1000 * l_quantity > 70000 AS y FROM lineitem),
c AS (SELECT x1, x2, count(*) AS n, count(*) FILTER (y) AS pos, 0.0::DOUBLE AS m, 0.5::DOUBLE AS rate FROM x GROUP BY 1, 2),
r1 AS ({CELL_ROUND} c), r2 AS ({CELL_ROUND} r1), r3 AS ({CELL_ROUND} r2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 6) AS margin FROM x JOIN r3 USING (x1, x2)""")
def boosted_cells(t) -> DataFrame:
    """Three trees of depth two on two 0/1 features: every combination ends in a leaf of its own, whose value has a closed form."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    worth = F.col("l_extendedprice") * (1 - F.col("l_discount")) + 1000 * F.col("l_quantity")
    rows = cut_lineage(t.lineitem.select(
        *keys, (worth > 70000).cast("int").alias("y"), (F.col("l_extendedprice") > 50000).cast("int").alias("x1"), (F.col("l_quantity") > 25).cast("int").alias("x2")))
    model = B.grow(rows, None, ["x1", "x2"], "y", [B.Choice(trees=3, depth=2, rate=0.5, positive_weight=1.0)])[0]
    return model.transform(rows).select(*keys, r6("margin").alias("margin"))


@query("kernel_values", "M7 M8", """
WITH x AS (SELECT c_nationkey AS n, avg(c_acctbal) / 5000 AS a, count(*) / 50.0::DOUBLE AS b FROM customer GROUP BY 1)
SELECT x.n AS "left", y.n AS "right", round(exp(-0.5::DOUBLE * ((x.a - y.a) ** 2 + (x.b - y.b) ** 2)), 5) AS rbf, round((0.5::DOUBLE * (x.a * y.a + x.b * y.b)) ** 3, 5) AS poly
FROM x JOIN x y ON x.n < y.n""")
def kernel_values(t) -> DataFrame:
    """Products of features equal the kernels where every row is a landmark."""
    sides = t.customer.groupBy("c_nationkey").agg((F.avg("c_acctbal") / 5000).alias("a"), (F.count("*") / 50).alias("b"))
    made = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(sides)
    for kernel in ("rbf", "poly"):
        made = M.KernelFeatures("x", kernel, kernel, 3, "auto").fit(made).transform(made)
    made = cut_lineage(made.select("c_nationkey", vector_to_array("rbf").alias("rbf"), vector_to_array("poly").alias("poly")))
    other = made.toDF("right", "rbf_r", "poly_r")
    pairs = made.withColumn("right", F.explode(F.sequence(F.col("c_nationkey") + 1, F.greatest(F.col("c_nationkey") + 1, F.lit(24)))))  # nation keys are 0 to 24
    return pairs.join(other, "right").select(F.col("c_nationkey").alias("left"), "right", F.round(dot("rbf", "rbf_r"), 5).alias("rbf"), F.round(dot("poly", "poly_r"), 5).alias("poly"))


@query("model_margins", "M6 M7 M8 M10")
def model_margins(t) -> DataFrame:
    """A small grid of each kind of margin classifier; the published ones are ``models.GRIDS``."""
    train = folded(t)
    return M.summary(t.spark, [
        M.grid_search(train, "svm_linear", FEATURES, "quality", "fold", {"C": [1], "max_iter": [30]}),
        M.grid_search(train, "svm_poly", FEATURES, "quality", "fold", {"C": [1], "degree": [2], "gamma": ["scale"], "max_iter": [30]}),
        M.grid_search(train, "svm_rbf", FEATURES, "quality", "fold", {"C": [1], "gamma": ["auto"], "max_iter": [30]}),
    ])


@query("model_knn", "M9 M10 X12")
def model_knn(t) -> DataFrame:
    """A small grid of nearest neighbours; the published one is in ``models.GRIDS``."""
    grid = {"n_neighbors": [5, 20], "weights": ["uniform", "distance"], "p": [2]}
    return M.summary(t.spark, [M.knn_search(folded(t), "doc_id", FEATURES, "quality", "fold", grid)])


def fitted(t):
    """A logistic model fitted on the first 85% of the documents by id, and the rest."""
    parts = time_split(cut_lineage(document_features(t)), "doc_id")
    train, test = (cut_and_spread(parts.filter(F.col("part") == part)) for part in ("train", "test"))
    stages = [*M.preprocessing(FEATURES), *M.classifier("logreg", {"C": 1.0}, train.count(), "quality", "class_weight")]
    return Pipeline(stages=stages).fit(train), test


@query("score_table", "M12 M13 O9 V2")
def score_table(t) -> DataFrame:
    model, test = fitted(t)
    path = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    M.save_model(model, path)
    return M.score_table(M.load_model(path), test, ["doc_id", "quality"])


@query("nearest_scores", "M9 M12 M13", """
WITH e AS (SELECT vec_id, CAST(label >= 5 AS INTEGER) AS side, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE vec_id % 4 <> 0 GROUP BY i),
z AS (SELECT vec_id, any_value(side) AS side, list((x - m) / s ORDER BY i) AS v FROM e JOIN s USING (i) GROUP BY vec_id),
d AS (SELECT q.vec_id, p.vec_id AS other, p.side, round(list_sum(list_transform(list_zip(q.v, p.v), lambda c: abs(c[1] - c[2]))), 6) AS d FROM z q JOIN z p ON q.vec_id % 4 = 0 AND p.vec_id % 4 <> 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS place FROM d) WHERE place <= 5)
SELECT vec_id, CAST(sum(side) >= 3 AS INTEGER) AS prediction, round(sum(side) / 5, 6) AS score FROM k GROUP BY 1""")
def nearest_scores(t) -> DataFrame:
    """A nearest-neighbour model on all dimensions, fitted on three quarters of the vectors, saved, loaded and applied to the others."""
    columns = [f"e{i}" for i in range(64)]
    rows = cut_lineage(t.embeddings.select("vec_id", (F.col("label") >= 5).cast("int").alias("side"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)]))
    model = M.NearestModel.fit_on(rows.where("vec_id % 4 <> 0"), "vec_id", columns, "side", 5, "uniform", 1)
    path = f"{shared_dir(t.spark)}/nearest-{uuid.uuid4().hex}"
    M.save_model(model, path)
    found = M.score_table(M.load_model(path, t.spark), rows.where("vec_id % 4 = 0"), ["vec_id"])
    return found.withColumn("score", F.round("score", 6))


@query("perm_importance", "V5")
def perm_importance(t) -> DataFrame:
    model, test = fitted(t)
    return V.permutation_importance(model, test, FEATURES, "quality", "doc_id")


@query("partial_dependence", "V6")
def partial_dependence(t) -> DataFrame:
    model, test = fitted(t)
    return V.partial_dependence(model, test, "n_chars", V.dependence_grid(test, "n_chars"))


@query("partial_dependence_2d", "V7")
def partial_dependence_2d(t) -> DataFrame:
    model, test = fitted(t)
    names = ("n_chars", "upper_share")
    return V.partial_dependence_2d(model, test, names, tuple(V.dependence_grid(test, n) for n in names))


@query("model_importance", "V11")
def model_importance(t) -> DataFrame:
    model, _ = fitted(t)
    return V.model_importance(t.spark, model, FEATURES)


def token_hops(t) -> DataFrame:
    """Part and supplier vectors from two rounds over token edges only: what is to be predicted is not in them."""
    edges = N.with_reverse(cut_lineage(token_edges(t)))
    _, sides = trade_graph(t)
    tokens = edges.where(F.col("dst_kind") == "nation").select(F.lit("nation").alias("kind"), F.col("dst").alias("id"), F.array(F.lit(1.0)).alias("features")).distinct()
    return N.propagate(edges, stacked(sides, tokens), 2)


@query("token_hops", "G10 G11", f"""
WITH {PART_NATIONS}, {SUPPLIER_NATIONS}, p AS (SELECT p_partkey AS k, sqrt(p_size) AS a FROM part), s AS (SELECT s_suppkey AS k, sqrt(s_acctbal + 2000) AS a FROM supplier),
n1 AS (SELECT nation, avg(a) AS a FROM part_nations JOIN p ON l_partkey = p.k GROUP BY 1), m1 AS (SELECT nation, avg(a) AS a FROM supplier_nations JOIN s ON l_suppkey = s.k GROUP BY 1),
n AS (SELECT nation, coalesce(n1.a, 0) + coalesce(m1.a, 0) AS a FROM n1 FULL JOIN m1 USING (nation))
SELECT 'part' AS kind, CAST(l_partkey AS VARCHAR) AS id, round(avg(a), 6) AS second FROM part_nations JOIN n USING (nation) GROUP BY l_partkey
UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), round(avg(a), 6) FROM supplier_nations JOIN n USING (nation) GROUP BY l_suppkey""")
def token_hop_means(t) -> DataFrame:
    reached = token_hops(t).where("kind <> 'nation'").select("kind", "id", F.get("features", F.lit(4)).alias("second"))
    linked = token_edges(t).select(F.col("src_kind").alias("kind"), F.col("src").alias("id")).distinct()
    return reached.join(linked, ["kind", "id"], "left_semi").withColumn("second", r6("second"))


@query("link_classifier", "G10 G11 M13 V2")
def link_classifier(t) -> DataFrame:
    """Pairs are split first; weights, penalty and coefficients come from the training part, scores from the other."""
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg((F.max("l_quantity") > 30).cast("double").alias("success"))
    named = pairs.withColumn("pair", F.concat_ws("-", "l_partkey", "l_suppkey"))
    linked = cut_lineage(N.link_features(stratified_split(named, "success", "pair"), "part", "l_partkey", "supplier", "l_suppkey", token_hops(t)))
    train, test = linked.where("part = 'train'"), linked.where("part = 'test'")
    model = Pipeline(stages=M.classifier("logreg", {"C": 1.0}, train.count(), "success", "class_weight")).fit(train)
    return V.scores(M.score_table(model, test, ["success"]), "success", "prediction")


@query("link_rule", "G10 G11 V2 O10", f"""
WITH {PART_NATIONS}, {SUPPLIER_NATIONS}, p AS (SELECT p_partkey AS k, sqrt(p_size) AS a FROM part), s AS (SELECT s_suppkey AS k, sqrt(s_acctbal + 2000) AS a FROM supplier),
n1 AS (SELECT nation, avg(a) AS a FROM part_nations JOIN p ON l_partkey = p.k GROUP BY 1), m1 AS (SELECT nation, avg(a) AS a FROM supplier_nations JOIN s ON l_suppkey = s.k GROUP BY 1),
n AS (SELECT nation, coalesce(n1.a, 0) + coalesce(m1.a, 0) AS a FROM n1 FULL JOIN m1 USING (nation)),
l AS (SELECT l_partkey, avg(a) AS second FROM part_nations JOIN n USING (nation) GROUP BY 1), r AS (SELECT l_suppkey, avg(a) AS second FROM supplier_nations JOIN n USING (nation) GROUP BY 1),
q AS (SELECT l_partkey, l_suppkey, (max(l_quantity) > 30)::INT AS success FROM lineitem GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY success ORDER BY md5(l_partkey || '-' || l_suppkey || ':42'), l_partkey || '-' || l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY success) AS k FROM q),
t AS (SELECT success, (round(l.second, 6) > round(r.second, 6))::INT AS predicted FROM i JOIN l USING (l_partkey) JOIN r USING (l_suppkey) WHERE i.i >= floor(k * 0.85::DOUBLE)),
c AS (SELECT count(*) FILTER (success = 1 AND predicted = 1) AS tp, count(*) FILTER (success = 0 AND predicted = 1) AS fp, count(*) FILTER (success = 1 AND predicted = 0) AS fn, count(*) AS n, count(*) FILTER (success = predicted) AS ok FROM t)
SELECT n, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""")
def link_rule(t) -> DataFrame:
    """The link model's way with a fixed rule in place of the fitted one: pairs split by class, vectors of both ends side by side, scores of the held-out pairs."""
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg((F.max("l_quantity") > 30).cast("int").alias("success"))
    named = cut_lineage(pairs.withColumn("pair", F.concat_ws("-", "l_partkey", "l_suppkey")))
    test = stratified_split(named, "success", "pair").where("part = 'test'")
    ends = vector_to_array("features")
    linked = N.link_features(test, "part", "l_partkey", "supplier", "l_suppkey", token_hops(t)).select("success", (r6(F.get(ends, F.lit(4))) > r6(F.get(ends, F.lit(10)))).cast("int").alias("predicted"))
    linked = cut_lineage(linked)
    found = V.scores(linked, "success", "predicted")
    return found.select(F.lit(linked.count()).cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


# A fixed scoring rule in the place of a fitted model, so that what is done with a model can be checked exactly.
RULE_SCORE = "n_chars / (n_chars + 1500.0D) * (1.0D - 0.5D * toxic)"


def rule() -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {RULE_SCORE} AS probability, CAST({RULE_SCORE} >= 0.4D AS INT) AS prediction FROM __THIS__")


def rule_rows(t) -> DataFrame:
    sizes = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return t.labels.select("doc_id", "quality", F.col("toxic").cast("double").alias("toxic")).join(sizes, "doc_id")


RULE_ROWS = """x AS (SELECT l.doc_id, quality, CAST(toxic AS DOUBLE) AS toxic, CAST(n_chars AS DOUBLE) AS n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def rule_sql(chars: str = "n_chars", toxic: str = "toxic") -> str:
    return f"({chars} / ({chars} + 1500.0::DOUBLE) * (1.0::DOUBLE - 0.5::DOUBLE * {toxic}))"


@query("rule_scores", "M13", f"""
WITH {RULE_ROWS} SELECT doc_id, quality, CAST({rule_sql()} >= 0.4 AS INTEGER) AS prediction, round({rule_sql()}, 6) AS score FROM x""")
def rule_scores(t) -> DataFrame:
    return M.score_table(rule(), rule_rows(t), ["doc_id", "quality"]).withColumn("score", F.round("score", 6))


REPEATS = 10

F1 = "coalesce(2.0 * count(*) FILTER (quality = 1 AND p = 1) / nullif(2 * count(*) FILTER (quality = 1 AND p = 1) + count(*) FILTER (quality <> p), 0), 0)"


@query("rule_importance", "V5 V2 O6", f"""
WITH {RULE_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS i, count(*) OVER () AS n FROM x),
base AS (SELECT {F1} AS f FROM (SELECT quality, CAST({rule_sql()} >= 0.4 AS INTEGER) AS p FROM x)),
g AS (SELECT k, (i + 1 + (k * 104729 + 42) % (n - 1)) % n AS i, n_chars AS dc, toxic AS dt FROM r, range({REPEATS}) s(k)),
v AS (SELECT 'n_chars' AS feature, k, quality, CAST({rule_sql('dc', 'toxic')} >= 0.4 AS INTEGER) AS p FROM r JOIN g USING (i)
  UNION ALL SELECT 'toxic', k, quality, CAST({rule_sql('n_chars', 'dt')} >= 0.4 AS INTEGER) FROM r JOIN g USING (i)),
e AS (SELECT feature, k, (SELECT f FROM base) - {F1} AS d FROM v GROUP BY 1, 2)
SELECT feature, round(avg(d), 6) AS importance, round(stddev_pop(d), 6) AS deviation FROM e GROUP BY 1""")
def rule_importance(t) -> DataFrame:
    found = V.permutation_importance(rule(), rule_rows(t), ["n_chars", "toxic"], "quality", "doc_id", repeats=REPEATS)
    return found.select("feature", F.round("importance", 6).alias("importance"), F.round("deviation", 6).alias("deviation"))


SIZES = [float(100 * i) for i in range(1, 41)]


@query("rule_dependence", "V6", f"""
WITH {RULE_ROWS}, g AS (SELECT unnest({SIZES}::DOUBLE[]) AS v) SELECT v AS "value", round(avg({rule_sql('v')}), 6) AS score FROM x, g GROUP BY 1""")
def rule_dependence(t) -> DataFrame:
    return V.partial_dependence(rule(), rule_rows(t), "n_chars", SIZES).withColumn("score", F.round("score", 6))


@query("rule_dependence_each", "V6", f"""
WITH {RULE_ROWS}, g AS (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS v) SELECT doc_id, v AS "value", round({rule_sql('n_chars', 'v')}, 6) AS score FROM x, g""")
def rule_dependence_each(t) -> DataFrame:
    rows = rule_rows(t)
    made = V.partial_dependence(rule(), rows, "toxic", V.dependence_grid(rows, "toxic"), "doc_id")
    return made.withColumn("score", F.round("score", 6))


@query("rule_dependence_2d", "V7", f"""
WITH {RULE_ROWS}, g AS (SELECT unnest({SIZES}::DOUBLE[]) AS a), h AS (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS b)
SELECT a AS value_a, b AS value_b, round(avg({rule_sql('a', 'b')}), 6) AS score FROM x, g, h GROUP BY 1, 2""")
def rule_dependence_2d(t) -> DataFrame:
    made = V.partial_dependence_2d(rule(), rule_rows(t), ("n_chars", "toxic"), (SIZES, [0.0, 1.0]))
    return made.withColumn("score", F.round("score", 6))


@query("imputed_features", "M1 X9", """
WITH h AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, CAST(c_nationkey AS DOUBLE) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer),
m AS (SELECT c_custkey, coalesce(balance, (SELECT avg(balance) FROM h)) AS balance, nation, segment FROM h),
top AS (SELECT segment FROM h WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)
SELECT c_custkey, round((balance - avg(balance) OVER ()) / stddev_samp(balance) OVER (), 6) + 0.0 AS balance, round((nation - avg(nation) OVER ()) / stddev_samp(nation) OVER (), 6) + 0.0 AS nation,
  coalesce(segment, (SELECT segment FROM top)) AS segment FROM m""")
def imputed_features(t) -> DataFrame:
    holed = t.customer.select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
    )
    ready = Pipeline(stages=M.preprocessing(["balance", "nation"], text=["segment"])).fit(holed).transform(holed)
    scaled = ready.select("c_custkey", "segment", vector_to_array("features").alias("f"))
    return scaled.select("c_custkey", r6(F.get("f", F.lit(0))).alias("balance"), r6(F.get("f", F.lit(1))).alias("nation"), "segment")


@query("neighbour_votes", "M9 X12", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label >= 5 AS INTEGER) AS side FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS other_id, b.side, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other_id) AS place FROM d) WHERE place <= 7)
SELECT vec_id, CAST(sum(side / distance) > sum((1 - side) / distance) AS INTEGER) AS prediction, round(sum(side / distance) / sum(1 / distance), 6) AS probability FROM k GROUP BY 1""")
def neighbour_votes(t) -> DataFrame:
    points = t.embeddings.select(F.col("vec_id").alias("other_id"), "embedding", (F.col("label") >= 5).cast("int").alias("side"))
    near = nearest(t.embeddings, points, "vec_id", "other_id", "embedding", "embedding", 7, "euclidean", exclude_same=True)
    voted = vote_of_neighbours(near, points, "vec_id", "other_id", "side", "distance")
    return voted.withColumn("probability", F.round("probability", 6))
