from pyspark.sql import functions as F

from attest.llm import fingerprint


def test_terms_that_come_once_need_no_inverse(spark):
    """t is 0 for them, so the table's second part is not looked at; others take it from there."""
    gamma = fingerprint.gamma_quantiles()
    n = len(gamma)
    rows = spark.createDataFrame([(1, 0.0, gamma + [None] * n + gamma), (1, 0.0, gamma * 3), (1, 0.5, gamma + [None] * n + gamma)], "h long, log_weight double, gamma array<double>")
    got = [list(r) for r in rows.select(*fingerprint.samples(F.col("h"), F.col("log_weight"), F.col("gamma"), 4)).collect()]
    assert got[0] == got[1] and None not in got[0] and len(set(got[0])) == 4
    assert got[2] == [None] * 4
