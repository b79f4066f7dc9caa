"""Compact numeric metrics of a client."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import days_between, weekday
from profilis.functions.stats import entropy, r6, top_k


def burst_score(events: DataFrame) -> DataFrame:
    """Variance over mean of a client's 24 hourly counts, empty hours included."""
    h = events.groupBy("client_id", F.hour("timestamp").alias("h")).agg(F.count("*").alias("n"))
    s, q = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return h.groupBy("client_id").agg(r6((q / 24 - F.pow(s / 24, F.lit(2))) / (s / 24)).alias("burst"))


def time_of_day_variance(events: DataFrame) -> DataFrame:
    """One minus the length of the mean direction of the hours."""
    a = 2 * pi * F.hour("timestamp") / 24
    length = F.sqrt(F.pow(F.avg(F.cos(a)), F.lit(2)) + F.pow(F.avg(F.sin(a)), F.lit(2)))
    return events.groupBy("client_id").agg(r6(1 - length).alias("tod_var"))


def weekday_entropy(events: DataFrame) -> DataFrame:
    d = events.groupBy("client_id", weekday("timestamp").alias("d")).agg(F.count("*").alias("n"))
    return entropy(d, ["client_id"], "h").select("client_id", r6(F.col("h")).alias("weekday_entropy"))


def price_entropy(events: DataFrame) -> DataFrame:
    p = events.where("price_bucket > 0").groupBy("client_id", "price_bucket").agg(F.count("*").alias("n"))
    return entropy(p, ["client_id"], "h").select("client_id", r6(F.col("h")).alias("price_entropy"))


def price_shift(events: DataFrame) -> DataFrame:
    """Percent by which the mean price bought differs from the mean price put in the cart."""
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("price_bucket")))
    per = events.groupBy("client_id").agg(mean("product_buy").alias("b"), mean("add_to_cart").alias("a")).where("a > 0 and b is not null")
    return per.select("client_id", r6(100 * (F.col("b") - F.col("a")) / F.col("a")).alias("price_shift_percent"))


def cyclic_means(events: DataFrame) -> DataFrame:
    h, d = 2 * pi * F.hour("timestamp") / 24, 2 * pi * F.weekday("timestamp") / 7
    return events.groupBy("client_id").agg(*[r6(F.avg(f(x))).alias(n) for n, f, x in (("hour_sin", F.sin, h), ("hour_cos", F.cos, h), ("day_sin", F.sin, d), ("day_cos", F.cos, d))])


def favourites(events: DataFrame) -> DataFrame:
    """Most frequent sku and category, least id on ties."""

    def mode(c: str) -> DataFrame:
        counts = events.where(F.col(c).isNotNull()).groupBy("client_id", c).agg(F.count("*").alias("n"))
        return counts.groupBy("client_id").agg(F.min_by(c, F.struct(-F.col("n"), c)).alias(c))

    return mode("sku").join(mode("category_id"), "client_id", "full")


def recency_rank(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Share of buyers whose last purchase is no longer ago than a client's last event.

    Only the table of distinct days (bounded by the span of time) goes to every task.
    """
    per = events.groupBy("client_id").agg(F.max("timestamp").alias("l"), F.max(F.when(F.col("event_type") == "product_buy", F.col("timestamp"))).alias("b"))
    per = per.select("client_id", days_between(conf.now, F.col("l")).alias("days"), days_between(conf.now, F.col("b")).alias("buy_days"))
    days = per.where("buy_days is not null").groupBy("buy_days").agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.orderBy("buy_days").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy())
    steps = days.select(F.col("buy_days").alias("day"), run.alias("share"))
    table = steps.agg(F.array_sort(F.collect_list(F.struct("day", "share"))).alias("steps"))
    upto = F.filter("steps", lambda s: s["day"] <= F.col("days"))
    share = F.when(F.size(upto) > 0, F.element_at(upto, -1)["share"]).otherwise(F.lit(0.0))
    return per.join(F.broadcast(table)).select("client_id", F.col("days").cast("bigint").alias("days"), r6(share).alias("recency_rank"))


def cluster_shares(events: DataFrame, clusters: DataFrame, k: int = 3) -> DataFrame:
    """Shares of a client's events in sku clusters, the k largest."""
    c = events.join(clusters, "sku").groupBy("client_id", "cluster").agg(F.count("*").alias("n"))
    c = c.withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy("client_id"))))
    return top_k(c, ["client_id"], [F.desc("n"), F.asc("cluster")], k)
