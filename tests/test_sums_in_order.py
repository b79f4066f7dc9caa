"""Means of doubles that don't hang on how rows are dealt out."""

from pyspark.sql import functions as F

from profilis.functions.stats import summed_in_order


def test_sums_go_by_the_order_given(spark):
    values = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16, 0.7, 39 / 60, 0.55] * 5
    rows = [(c, i, x) for c in range(40) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "client_id long, i int, x double").orderBy(F.rand(7)).repartition(7)
    summed = summed_in_order(df, ["client_id"], "i", F.col("x"), "upto")
    found = {r[1] for r in summed.groupBy("client_id").agg(F.max_by("upto", "i") / F.count("*")).collect()}
    want = 0.0
    for x in values:
        want += x
    assert found == {want / len(values)}
    assert len({r[1] for r in df.groupBy("client_id").agg(F.avg("x")).collect()}) > 1
