"""Segments of clients as profiles name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import days_between
from profilis.functions.stats import quantiles


def profile_segments(events: DataFrame, conf: EngineConf = CONF, least: int = 10) -> DataFrame:
    """client_id and its segments, sorted: buyers and browsers by activity, frequency of purchases,
    price ratio and loyalty to categories.

    Active means five page visits and a last event within 30 days, of now (absolute) or of the
    last event of all (relative). Price segments are cut at the 0.33 and 0.66 quantiles of
    the bought / added ratio and need more than ``least`` ratios; a client that only adds has
    ratio 0. Loyalty is the share of the most visited category.
    """
    kind, p = F.col("event_type"), F.col("price_bucket")
    mean = lambda k: F.coalesce(F.avg(F.when(kind == k, p)), F.lit(0.0))
    per = events.groupBy("client_id").agg(
        F.count_if(kind == "product_buy").alias("b"), F.count_if(kind == "page_visit").alias("v"), F.max("timestamp").alias("last"), mean("add_to_cart").alias("added"), mean("product_buy").alias("paid")
    )
    views = events.where((kind == "page_visit") & F.col("category_id").isNotNull()).groupBy("client_id", "category_id").agg(F.count("*").alias("n"))
    loyal = views.groupBy("client_id").agg((F.max("n") / F.sum("n")).alias("loyalty"), F.count("*").alias("n_cats"))
    per = per.withColumn("ratio", F.when(F.col("added") > 0, F.col("paid") / F.col("added"))).join(loyal, "client_id", "left").na.fill(0, ["loyalty", "n_cats"])
    ends = per.agg(F.max("last").alias("end"), F.count("ratio").alias("n_ratios"), F.max("n_cats").alias("any_cats"))  # one row
    whole = per.join(F.broadcast(ends))
    low, high = quantiles(per, "ratio", [0.33, 0.66])
    b, loyalty, ratio = F.col("b"), F.col("loyalty"), F.col("ratio")
    active = lambda end: (F.col("v") >= 5) & (days_between(end, F.col("last")) <= 30)
    absolute, relative = active(conf.now), active(F.col("end"))
    who = F.when(b > 0, "buyers").otherwise("browsers")
    named = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    priced, seen = F.col("n_ratios") > least, F.col("any_cats") > 0
    names: list[Column] = [
        F.when(b > 0, "buyers").otherwise("non_buyers"),
        F.when(absolute, named("active_", who, "_absolute")),
        F.when(relative, named("active_", who, "_relative")).otherwise(named("inactive_", who, "_relative")),
        F.when(b == 1, "one_time_buyers").when(b.between(2, 5), "occasional_buyers").when(b > 5, "frequent_buyers"),
        F.when(priced & (ratio < F.lit(low)), "price_sensitive").when(priced & (ratio > F.lit(high)), "price_insensitive").when(priced & ratio.isNotNull(), "price_moderate"),
        F.when(seen & (loyalty >= 0.75), "category_loyal").when(seen & (loyalty <= 0.4) & (F.col("n_cats") >= 3), "category_explorer").when(seen & (loyalty > 0.4), "moderate_explorer"),
    ]
    return whole.select("client_id", F.array_sort(F.array_compact(F.array(*names))).alias("segments"))
