"""Lineage cuts."""

from pairloom import session


def test_small_tables_are_dealt_out_for_much_work(spark):
    """A table that Spark would read in one task; few rows stay together."""
    rows = spark.range(0, 20 * session.ROWS_A_TASK, 1, 1).withColumnRenamed("id", "x")
    stored = session.cut_and_spread(rows)
    assert stored.rdd.getNumPartitions() == min(20, spark.sparkContext.defaultParallelism)
    assert sorted(r["x"] for r in stored.collect()) == list(range(20 * session.ROWS_A_TASK))
    assert session.cut_and_spread(rows.limit(session.ROWS_A_TASK)).rdd.getNumPartitions() == 1


def test_few_rows_make_few_files(spark):
    """However many partitions the last shuffle has; the rows are the same, in tasks taken together or dealt out anew."""
    many = spark.range(0, 1000, 1, 1).repartition(50, "id")
    for heavy in (False, True):
        stored = session.cut_slim(many, 1000, heavy=heavy)
        assert len(stored.inputFiles()) == 1 and sorted(r["id"] for r in stored.collect()) == list(range(1000))
    cores = spark.sparkContext.defaultParallelism
    assert len(session.cut_slim(many, 1000, 100).inputFiles()) == min(10, cores)
    assert len(session.cut_slim(many, 1000, 10, heavy=True).inputFiles()) == max(100 * session.ROWS_A_FILE // session.ROWS_A_TURN, cores)
