"""Generated methods of headline plans stay small enough for the JVM to compile them (8,000 bytes of code)."""

import pytest

from pricelens import plans

SF = "/root/testdata/sf0.001"


def method_sizes(spark, df):
    debug = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]


@pytest.mark.parametrize("name", ["a1_log_loss", "a5_ece", "a12_value_rate", "a15_method_comparison", "d2_devig_multiplicative", "d3_devig_power", "d4_devig_shin", "d6_round_consensus", "d7_closing_last_value", "d11_best_edge", "p1_kickoff_utc", "j4_asof_backward"])
def test_methods_can_be_compiled(spark, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else plans show their code only once they run
    try:
        sizes = method_sizes(spark, plans.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000, sizes
