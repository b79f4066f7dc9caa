"""Events that all parts of a profile read."""

from pyspark.sql import functions as F

from profilis.plans import rendering_queries

DATA = "/root/testdata/sf0.001"


def test_parts_of_profiles_exchange_no_events(spark):
    events, _, _ = rendering_queries.profile_inputs(spark, DATA)
    per = events.groupBy("client_id").agg(F.count("*").alias("n"), F.max("brand").alias("brand"), F.max("url").alias("url"))
    assert "Exchange" not in per._jdf.queryExecution().executedPlan().toString()
    assert per.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
