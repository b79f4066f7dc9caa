"""Recency-weighted propensities, purchases, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.conf import CONF, EVENT_WEIGHTS, EngineConf
from profilis.functions.dates import days_between, micros, recency_weight
from profilis.functions.stats import guarded, r6, top_k


def event_weight(kind: Column) -> Column:
    out = F.lit(1)
    for name, weight in EVENT_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def scored(events: DataFrame, item: str, conf: EngineConf = CONF, weighted: bool = False) -> DataFrame:
    """Per client and item: recency score, count, days since the last event."""
    weight = recency_weight(conf.now, F.col("timestamp"))
    if weighted:
        weight = weight * event_weight(F.col("event_type"))
    per = events.where(F.col(item).isNotNull()).groupBy("client_id", item).agg(F.sum(weight).alias("s"), F.count("*").alias("n"), F.max("timestamp").alias("last"))
    return per.select("client_id", item, r6(F.col("s")).alias("score"), "n", days_between(conf.now, F.col("last")).cast("bigint").alias("days_since"))


def top_scores(events: DataFrame, item: str, k: int = 5, conf: EngineConf = CONF, weighted: bool = False) -> DataFrame:
    return top_k(scored(events, item, conf, weighted), ["client_id"], [F.desc("score"), F.asc(item)], k)


def coverage(events: DataFrame, item: str, listed: DataFrame) -> DataFrame:
    """Share of a listed set of items that a client touched."""
    n = listed.agg(F.count("*").alias("listed"))
    seen = events.join(listed, item, "left_semi").groupBy("client_id").agg(F.countDistinct(item).alias("seen"))
    return seen.join(F.broadcast(n)).select("client_id", "seen", r6(F.col("seen") / F.col("listed")).alias("coverage"))


def category_propensity(events: DataFrame, k: int = 5, conf: EngineConf = CONF) -> DataFrame:
    return top_scores(events, "category_id", k, conf).select("client_id", "category_id", "score", "rank")


def category_breadth(events: DataFrame) -> DataFrame:
    """Distinct categories, the category bought most (least id on ties) and its share."""
    c = events.where("category_id is not null").groupBy("client_id", "category_id").agg(F.count_if(F.col("event_type") == "product_buy").alias("buys"))
    per = c.groupBy("client_id").agg(F.count("*").alias("breadth"), F.sum("buys").alias("total"), F.max("buys").alias("top"), F.min_by("category_id", F.struct(-F.col("buys"), "category_id")).alias("cat"))
    return per.select("client_id", "breadth", F.when(F.col("total") > 0, F.col("cat")).alias("focus_category"), r6(guarded(F.col("top"), F.col("total"))).alias("focus_share"))


def repeat_purchase(events: DataFrame) -> DataFrame:
    """Skus bought more than once and the most bought of them."""
    b = events.where("event_type = 'product_buy' and sku is not null").groupBy("client_id", "sku").agg(F.count("*").alias("n")).where("n > 1")
    return b.groupBy("client_id").agg(F.count("*").alias("repeat_skus"), F.min_by("sku", F.struct(-F.col("n"), "sku")).alias("top_sku"), F.max("n").alias("top_n"))


def brand_affinity(events: DataFrame) -> DataFrame:
    """The brand with most distinct skus among a client's events (least name on ties)."""
    b = events.where("brand is not null and sku is not null").select("client_id", "brand", "sku").distinct().groupBy("client_id", "brand").agg(F.count("*").alias("n"))
    return top_k(b, ["client_id"], [F.desc("n"), F.asc("brand")], 1).drop("rank")


def churn_signals(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Purchases, days since the last one and risk, mean interval in whole days, unusual gap, price sum."""
    w = W.partitionBy("client_id").orderBy("timestamp", "event_id")
    b = events.where("event_type = 'product_buy'").withColumn("interval", days_between(F.col("timestamp"), F.lag("timestamp").over(w)))
    per = b.groupBy("client_id").agg(F.count("*").alias("n_buys"), F.max("timestamp").alias("last"), F.avg("interval").alias("mean"), F.sum("price_bucket").alias("ltv"))
    days = days_between(conf.now, F.col("last"))
    bought = per.select(
        "client_id", "n_buys", days.cast("bigint").alias("buy_recency"), F.when(days >= conf.churn_days, "high").otherwise("low").alias("risk"), r6(F.col("mean")).alias("mean_interval"),
        F.coalesce((F.col("mean") > 0) & (days > 2 * F.col("mean")), F.lit(False)).alias("unusual_gap"), "ltv",
    )
    return events.select("client_id").distinct().join(bought, "client_id", "left").withColumn("risk", F.coalesce("risk", F.lit("no_purchase")))


def post_purchase(events: DataFrame) -> DataFrame:
    """Events after each client's last purchase, and what they are."""
    last = F.max(F.when(F.col("event_type") == "product_buy", micros("timestamp"))).over(W.partitionBy("client_id"))
    e = events.select("client_id", "event_type", micros("timestamp").alias("at"), last.alias("last")).where("last is not null")
    after = F.col("at") > F.col("last")
    per = e.groupBy("client_id").agg(F.count_if(after).alias("n_after"), F.count_if(after & (F.col("event_type") == "add_to_cart")).alias("carts"), F.count_if(after & (F.col("event_type") == "page_visit")).alias("views"))
    return per.select("client_id", "n_after", F.when(F.col("carts") > 0, "cart_activity").when(F.col("views") > 0, "browsing").when(F.col("n_after") > 0, "other").otherwise("no_activity").alias("tag"))
