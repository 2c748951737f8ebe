"""Rows of the null group meet in one label of a task, however many batches it reads."""

from pricelens.operators.intervals import intervals
from pyspark.sql import functions as F


def shuffled(spark) -> int:
    """Records that all stages so far have handed on."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_null_group_is_one_label(spark):
    n = 200_000
    x = spark.range(n).select(F.col("id").alias("match_id"), F.when(F.col("id") % 2 == 0, "L").alias("league"), (F.col("id") % 7).cast("double").alias("v"))
    before = shuffled(spark)
    got = intervals(x, {"v": F.col("v")}, "match_id", ["league"], draws=10).collect()
    assert {r.league: r.v_n for r in got} == {None: n // 2, "L": n // 2}
    # Rows, then two labels a task with one block of draws and one row of means each, then few.
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert shuffled(spark) - before <= n + tasks * 2 * 2 + 100
