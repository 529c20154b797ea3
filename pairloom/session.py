"""Session settings, the shared folder, and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on; all of them can be changed at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where the join feeds a grouping on the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


ARCHIVE = "pairloom-package"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session and send the package to its Python workers."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if not any(f.endswith(f"{ARCHIVE}.zip") for f in context.listFiles):
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='pairloom-')}/{ARCHIVE}", "zip", package.parent, package.name))
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pairloom") -> SparkSession:
    """A local session for tests and the bench; on a cluster pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="pairloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


# Folders of cut tables, by application, in the order they were written.
_WRITTEN: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them from there.

    Nothing upstream runs again, whatever executors are lost; and unlike a raw checkpoint the stored table is
    columnar and has a known size, so later steps read only what they need and joins can be planned on it.
    The table stays until ``release`` or the ``lineage_scope`` around it deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Slim rows (a few numbers) of a cut table that are worth a file, and that are worth a task where there are more files than cores.
ROWS_A_FILE, ROWS_A_TURN = 1 << 15, 1 << 18


def cut_slim(df: DataFrame, rows: int, per_file: int = ROWS_A_FILE, heavy: bool = False) -> DataFrame:
    """``cut_lineage`` for about ``rows`` rows: a file per ``per_file`` rows up to one a core; larger tables get files that are larger by ROWS_A_TURN / ROWS_A_FILE.

    The tasks of the last step are taken together. If that step is ``heavy``, its tasks stay as they are and its rows are dealt out anew.

    The last shuffle has as many partitions as the input needs where it is largest; a small table would be written as so many files of a few rows,
    each of which costs its executor more than its rows do, and rounds that pass tables on write such a set each.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_file)
    files = max(1, min(files, max(cores, files * ROWS_A_FILE // ROWS_A_TURN)))
    return cut_lineage(df.repartition(files) if heavy else df.coalesce(files))


#: Rows of a small table that are worth a task of their own where every row costs much work.
ROWS_A_TASK = 500


def cut_and_spread(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for a table that is small in bytes but read for much work a row, such as by a fit: it is dealt out to all cores.

    Spark plans tasks by bytes, which would leave such a table to one.
    """
    stored = cut_lineage(df)
    tasks = min(stored.count() // ROWS_A_TASK, df.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(stored.repartition(tasks)) if tasks > stored.rdd.getNumPartitions() else stored


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt out, by the keys if any, to tasks of about ``rows`` rows each, however many there are; at least two tasks.

    For a table whose rows are small in bytes but unfold to much or are held by the task that groups or sorts them: Spark plans tasks by bytes. Rows are
    counted for it, so ``df`` should be little more than a stored table.
    """
    return df.repartition(max(2, -(-df.count() // rows)), *keys)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the cut tables of this application but the ``keep`` oldest; results that still read them must have been stored."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = written[keep:]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del written[keep:]
    return len(gone)


@contextmanager
def lineage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``cut_lineage`` wrote inside; store or collect results before leaving."""
    before = len(_WRITTEN.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)
