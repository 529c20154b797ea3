"""The corpus pipeline: language, quality, near duplicates, decontamination and tokens, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, language, pieces, quality, simhash
from pairloom.llm.queries import PREDICT_FROM, language_model, quality_classifier, table, tokenizer_path
from pairloom.session import configure, cut_lineage

#: Rows that go to a Python worker at once: few, as workers that are kept from stage to stage hold the models of several.
BATCH_ROWS = 2000
#: Documents whose shuffled texts are written as one file at least, where there are more files than cores.
DOCS_A_FILE = 4096
#: A text stays if its best language holds at least this share among all languages.
LEAST_SHARE = 0.5


def _configured(spark: SparkSession) -> SparkSession:
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, texts that no learnt language knows (it would need more bits than raw bytes have), and texts of a few
    bytes whose best language falls short of LEAST_SHARE.
    """
    _configured(spark)
    return language.kept(docs, language_model(docs), LEAST_SHARE)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier takes to be of low quality."""
    _configured(spark)
    return quality.kept(docs, quality_classifier(docs, table(spark, sf_dir, "labels")), PREDICT_FROM)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of exact and near copies the document with the smallest id, one without an id only if none has one.

    Rows are told apart by id and text, so an id may name several texts or be null; rows that agree in both are one.
    """
    _configured(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_t": F.xxhash64(text), "_u": F.xxhash64(F.lit(1), text)})
    rows = simhash.near_rows(docs)
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "t", "u")
    others = rows.where(~own.eqNullSafe(F.col("lead"))).select(F.col("doc_id").alias("_id"), "t", "u")
    same = keyed["doc_id"].eqNullSafe(others["_id"]) & (keyed["_t"] == others["t"]) & (keyed["_u"] == others["u"])
    left = keyed.join(others, same, "left_anti").dropDuplicates(["doc_id", "_t", "_u"]).drop("_t", "_u")
    return left.coalesce(max(spark.sparkContext.defaultParallelism, -(-docs.count() // DOCS_A_FILE)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    _configured(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left, with a check that they decode to its text."""
    _configured(spark)
    encoded = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("language", keep_known_language),
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("pieces", encode_pieces),
]

#: SQL has no trained models, fingerprints or tokenizers; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = _configured(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir.rstrip("/")))
    return docs
