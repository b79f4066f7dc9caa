"""Counts by type and time, recency, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import daypart, day_name, days_between, micros, weekday
from profilis.functions.stats import guarded, r6


def of_type(kind: str):
    return F.col("event_type") == kind


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("client_id", "event_type").agg(F.count("*").alias("n"))


def global_event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("n_clients"))


def buyer_share(events: DataFrame) -> DataFrame:
    per = events.groupBy("client_id").agg(F.max(of_type("product_buy").cast("int")).alias("buys"))
    return per.agg(F.count("*").alias("n_users"), F.sum("buys").alias("n_buyers"), r6(F.avg("buys")).alias("buyer_share"))


def _peaks(events: DataFrame, unit: str, value) -> DataFrame:
    per = events.groupBy("client_id", value.cast("int").alias(unit)).agg(F.count("*").alias("n"))
    return per.withColumn("top", F.max("n").over(W.partitionBy("client_id"))).withColumn("is_peak", F.col("n") >= 0.8 * F.col("top"))


def hour_peaks(events: DataFrame) -> DataFrame:
    """Hours with at least 0.8 of the busiest hour's events."""
    return _peaks(events, "hour", F.hour("timestamp")).where("is_peak").select("client_id", "hour", "n")


def daypart_dominance(events: DataFrame) -> DataFrame:
    """The third of the day with most peak hours; the earlier named wins ties."""
    counts = hour_peaks(events).groupBy("client_id").agg(*[F.count_if(daypart(F.col("hour")) == p).alias(p) for p in ("Morning", "Afternoon", "Evening")])
    m, a, e = (F.col(x) for x in ("Morning", "Afternoon", "Evening"))
    return counts.select("client_id", F.when((m >= a) & (m >= e), "Morning").when(a >= e, "Afternoon").otherwise("Evening").alias("daypart"))


def weekday_activity(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Events per weekday (Monday 1), its name, whether it is a peak.

    With conf.compat_weekday names are one day late, as a known older labelling had them.
    """
    per = _peaks(events, "weekday", weekday("timestamp"))
    label = F.col("weekday") % 7 + 1 if conf.compat_weekday else F.col("weekday")
    return per.select("client_id", "weekday", day_name(label).alias("day"), "n", "is_peak")


def weekend_tag(events: DataFrame) -> DataFrame:
    """weekday- or weekend-dominant by the peak days."""
    peaks = weekday_activity(events).where("is_peak").groupBy("client_id").agg(F.count_if(F.col("weekday") >= 6).alias("weekend"), F.count_if(F.col("weekday") < 6).alias("week"))
    return peaks.select("client_id", F.when(F.col("week") > F.col("weekend"), "weekday").when(F.col("weekend") > F.col("week"), "weekend").otherwise("mixed").alias("tag"))


def recency_status(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Days since the last event, purchase and cart addition, with a status."""
    last = events.groupBy("client_id").agg(F.max("timestamp").alias("l"), F.max(F.when(of_type("product_buy"), F.col("timestamp"))).alias("b"), F.max(F.when(of_type("add_to_cart"), F.col("timestamp"))).alias("c"))
    d = last.select("client_id", *[days_between(conf.now, F.col(x)).cast("bigint").alias(n) for x, n in (("l", "days_since_last"), ("b", "days_since_buy"), ("c", "days_since_cart"))])
    n = F.col("days_since_last")
    return d.withColumn("status", F.when(n <= 7, "very_recent").when(n <= 30, "moderately_recent").when(n <= 90, "lapsed").otherwise("inactive"))


def active_days(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Events and active days of the last 30 days, active ratio, and share of the last 14 days."""
    recent = lambda d: micros(conf.now) - micros("timestamp") <= d * 86_400_000_000
    per = events.groupBy("client_id").agg(
        F.count_if(recent(30)).alias("events_30d"), F.countDistinct(F.when(recent(30), F.to_date("timestamp"))).alias("days_30d"), F.min("timestamp").alias("first"),
        F.avg(recent(14).cast("double")).alias("share"),
    )
    observed = F.greatest(F.lit(1), F.least(F.lit(30), days_between(conf.now, F.col("first"))))
    return per.select("client_id", "events_30d", "days_30d", r6(F.col("days_30d") / observed).alias("active_ratio"), r6(F.col("share")).alias("share_14d"), (F.col("share") > 0.5).alias("recent_heavy"))


def funnel_counts(events: DataFrame) -> DataFrame:
    names = {"page_visit": "views", "search_query": "searches", "add_to_cart": "carts", "product_buy": "buys", "remove_from_cart": "removes"}
    return events.groupBy("client_id").agg(*[F.count_if(of_type(k)).alias(v) for k, v in names.items()])


def funnel_rates(events: DataFrame) -> DataFrame:
    f = funnel_counts(events).withColumn("starts", F.col("views") + F.col("searches"))
    rate = lambda n, d: r6(guarded(F.col(n), F.col(d)))
    return f.select("client_id", "starts", "carts", "buys", rate("carts", "starts").alias("cart_rate"), rate("buys", "carts").alias("buy_rate"), rate("buys", "starts").alias("overall_rate"), ((F.col("buys") > 0) & (F.col("carts") == 0)).alias("direct_buys"))


def funnel_stage(events: DataFrame) -> DataFrame:
    f = funnel_counts(events)
    stage = F.when(F.col("buys") > 0, "Conversion").when(F.col("carts") > 0, "Consideration").when((F.col("searches") > 0) | (F.col("views") > 5), "Research").when(F.col("views") > 0, "Awareness").otherwise("Inactive")
    return f.select("client_id", stage.alias("stage"))


def cart_abandon(events: DataFrame) -> DataFrame:
    f = funnel_counts(events).where("carts > 0").withColumn("ratio", F.col("buys") / F.col("carts"))
    return f.select("client_id", r6(F.col("ratio")).alias("ratio"), F.when(F.col("ratio") < 0.2, "high_abandon").when(F.col("ratio") > 0.8, "high_conversion").alias("tag"))


def search_intent(events: DataFrame) -> DataFrame:
    """Searches, distinct and repeated queries, the most frequent query (least text on ties)."""
    q = events.where(of_type("search_query") & F.col("query").isNotNull()).groupBy("client_id", "query").agg(F.count("*").alias("n"))
    return q.groupBy("client_id").agg(
        F.sum("n").alias("n_searches"), F.count("*").alias("n_queries"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.min_by("query", F.struct(-F.col("n"), "query")).alias("top_query"), F.max("n").alias("top_n"),
    )


def lifetime_span(events: DataFrame) -> DataFrame:
    per = events.groupBy("client_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return per.select("client_id", days_between(F.col("b"), F.col("a")).cast("bigint").alias("lifetime_days"))
