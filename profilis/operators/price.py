"""Price, popularity and category behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import days_between, micros
from profilis.functions.stats import entropy, guarded, quantiles, r6, top_k
from profilis.operators.sessions import session_table


def _price(kind: str) -> Column:
    return F.when(F.col("event_type") == kind, F.col("price_bucket"))


def price_stats(events: DataFrame) -> DataFrame:
    """Range, mean, deviation of price buckets; coefficient of variation of purchases, tags."""
    p, b = F.col("price_bucket"), _price("product_buy")
    per = events.groupBy("client_id").agg(F.count(p).alias("n"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("avg"), F.stddev_samp(p).alias("std"), guarded(F.stddev_samp(b), F.avg(b)).alias("cv")).where("n > 0")
    width = F.col("max") - F.col("min")
    return per.select(
        "client_id", "n", F.col("min").alias("min_price"), F.col("max").alias("max_price"), r6(F.col("avg")).alias("mean_price"), r6(F.col("std")).alias("std_price"), r6(F.col("cv")).alias("buy_cv"),
        F.when(width > 30, "wide").when(width < 10, "narrow").alias("width_tag"), F.when(F.col("cv") < 0.15, "consistent").when(F.col("cv") > 0.4, "varied").alias("cv_tag"),
    )


def price_sensitivity(events: DataFrame) -> DataFrame:
    """Mean price bought over mean price put in the cart; whether abandoned ones are dearer."""
    e = events.where("price_bucket is not null and sku is not null and event_type in ('add_to_cart', 'product_buy')")
    # per client and sku first, so that "never bought" needs no join
    per_sku = e.groupBy("client_id", "sku").agg(*[F.count(_price(k)).alias(n) for k, n in (("add_to_cart", "a"), ("product_buy", "b"))], F.max("price_bucket").alias("p"))
    total = lambda c, when=None: F.sum(F.when(when, F.col(c)) if when is not None else F.col(c))
    left = F.col("b") == 0
    per = per_sku.groupBy("client_id").agg(
        (F.sum(F.col("b") * F.col("p")) / F.sum("b")).alias("bought"), (F.sum(F.col("a") * F.col("p")) / F.sum("a")).alias("added"),
        (F.sum(F.when(left, F.col("a") * F.col("p"))) / total("a", left)).alias("abandoned"),
    )
    ratio = F.col("bought") / F.col("added")
    return per.where("bought is not null and added is not null").select(
        "client_id", r6(ratio).alias("ratio"), F.when(ratio < 0.8, "high").when(ratio > 1.2, "low").otherwise("moderate").alias("sensitivity"),
        F.coalesce(F.col("abandoned") > 1.2 * F.col("bought"), F.lit(False)).alias("abandons_dearer"),
    )


def price_segments(events: DataFrame, least: int = 10) -> DataFrame:
    """Terciles of the bought / added price ratio. Clients without purchases have ratio 0 and
    take part; there are no segments with ``least`` valid ratios or fewer."""
    per = events.groupBy("client_id").agg(F.coalesce(F.avg(_price("product_buy")), F.lit(0.0)).alias("b"), F.coalesce(F.avg(_price("add_to_cart")), F.lit(0.0)).alias("a"))
    ratios = per.where("a > 0").select("client_id", (F.col("b") / F.col("a")).alias("ratio"))
    low, high = quantiles(ratios, "ratio", [0.33, 0.66])
    valid = ratios.agg(F.count("*").alias("valid"))  # one row
    segment = F.when(F.col("ratio") <= F.lit(low), "price_sensitive").when(F.col("ratio") >= F.lit(high), "premium").otherwise("balanced")
    return ratios.join(F.broadcast(valid)).where(F.col("valid") > least).select("client_id", r6(F.col("ratio")).alias("ratio"), segment.alias("segment"))


def rfm(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Days since the last purchase, purchases in 90 days, mean bucket bought."""
    recent = micros(conf.now) - micros("timestamp") <= 90 * 86_400_000_000
    b = events.where("event_type = 'product_buy'").groupBy("client_id").agg(F.max("timestamp").alias("last"), F.count_if(recent).alias("frequency"), F.avg("price_bucket").alias("m"))
    return b.select("client_id", days_between(conf.now, F.col("last")).cast("bigint").alias("recency"), "frequency", r6(F.col("m")).alias("monetary"))


# -- popularity ---------------------------------------------------------------------
def popularity(events: DataFrame, item: str) -> DataFrame:
    """Views, carts, purchases, funnel rates and score of each item.

    Scores weigh 1, 3 and 10; if there is no view at all, carts weigh 2 and views nothing.
    """
    kinds = (("page_visit", "views"), ("add_to_cart", "carts"), ("product_buy", "buys"))
    per = events.where(F.col(item).isNotNull()).groupBy(item).agg(*[F.count_if(F.col("event_type") == k).alias(n) for k, n in kinds])
    total = per.agg(F.coalesce(F.sum("views"), F.lit(0)).alias("all_views"))
    score = F.when(F.col("all_views") > 0, F.col("views") + 3 * F.col("carts") + 10 * F.col("buys")).otherwise(2 * F.col("carts") + 10 * F.col("buys"))
    rate = lambda n, d: r6(guarded(F.col(n), F.col(d), 0.0))
    return per.join(F.broadcast(total)).select(item, "views", "carts", "buys", rate("carts", "views").alias("view_to_cart"), rate("buys", "carts").alias("cart_to_buy"), rate("buys", "views").alias("view_to_buy"), score.alias("score"))


def popularity_edges(scores: DataFrame) -> DataFrame:
    """Quartile edges of the scores: one row."""
    q = quantiles(scores, "score", [0.25, 0.5, 0.75])
    return scores.sparkSession.range(1).select(*[r6(F.lit(x)).alias(f"q{i}") for i, x in enumerate(q, 1)])


def popularity_quantiles(scores: DataFrame, item: str) -> DataFrame:
    """Q1 to Q4 of each item's score; Q0 where the score is missing."""
    s = F.col("score")
    label = F.when(s.isNull() | F.isnan(s.cast("double")), "Q0").when(s <= F.col("q1"), "Q1").when(s <= F.col("q2"), "Q2").when(s <= F.col("q3"), "Q3").otherwise("Q4")
    return scores.join(F.broadcast(popularity_edges(scores))).select(item, "score", label.alias("quantile"))


def popularity_affinity(events: DataFrame, scores: DataFrame, item: str) -> DataFrame:
    """Mean score of a client's distinct items over the mean of all items."""
    overall = scores.agg(F.avg("score").alias("overall"))
    mine = events.where(F.col(item).isNotNull()).select("client_id", item).distinct().join(scores.select(item, "score"), item)
    per = mine.groupBy("client_id").agg(F.avg("score").alias("own"), F.count("*").alias("n_items"), F.max(F.struct("score", -F.col(item))).alias("top"))
    ratio = F.col("own") / F.col("overall")
    return per.join(F.broadcast(overall)).select(
        "client_id", "n_items", r6(F.col("own")).alias("mean_score"), r6(ratio).alias("ratio"), r6(F.col("own") - F.col("overall")).alias("delta"),
        F.when(ratio > 1.3, "popular").when(ratio < 0.7, "niche").otherwise("average").alias("affinity"), (-F.col("top.col2")).alias("top_item"),
    )


def cart_vs_view_popularity(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score of distinct skus put in the cart over that of skus viewed."""
    mine = events.where("sku is not null and event_type in ('page_visit', 'add_to_cart')").select("client_id", "event_type", "sku").distinct().join(scores.select("sku", "score"), "sku")
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("score")))
    per = mine.groupBy("client_id").agg(mean("add_to_cart").alias("c"), mean("page_visit").alias("v")).where("c is not null and v > 0")
    ratio = F.col("c") / F.col("v")
    return per.select("client_id", r6(ratio).alias("ratio"), F.when(ratio > 1.2, "more_popular").when(ratio < 0.8, "less_popular").otherwise("alike").alias("tag"))


# -- categories ----------------------------------------------------------------------
def category_counts(events: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    e = events.where("category_id is not null")
    e = e.where(F.col("event_type").isin(*kinds)) if kinds else e
    return e.groupBy("client_id", "category_id").agg(F.count("*").alias("n"))


def browse_focus(events: DataFrame, gap_s: int) -> DataFrame:
    """Pages per session and concentration of page visits on the top category."""
    visits = events.where("event_type = 'page_visit'")
    pages = session_table(visits, gap_s).groupBy("client_id").agg(F.avg("n_events").alias("pages"))
    c = category_counts(visits).groupBy("client_id").agg((F.max("n") / F.sum("n")).alias("top"), F.count("*").alias("n_categories"))
    focus = F.when(F.col("top") > 0.75, "focus").when((F.col("top") < 0.4) & (F.col("n_categories") >= 3), "explorer")
    return pages.join(c, "client_id").select("client_id", r6(F.col("pages")).alias("pages_per_session"), F.when(F.col("pages") > 15, "intensive").when(F.col("pages") < 3, "shallow").alias("depth"), r6(F.col("top")).alias("top_share"), "n_categories", focus.alias("focus"))


def category_entropy(events: DataFrame) -> DataFrame:
    return entropy(category_counts(events), ["client_id"], "h").select("client_id", r6(F.col("h")).alias("entropy"))


def category_loyalty(events: DataFrame) -> DataFrame:
    """Loyal (top share >= 0.75), explorer (<= 0.40 with three categories or more) or moderate."""
    c = category_counts(events).groupBy("client_id").agg((F.max("n") / F.sum("n")).alias("top"), F.count("*").alias("n_categories"))
    segment = F.when(F.col("top") >= 0.75, "loyal").when((F.col("top") <= 0.4) & (F.col("n_categories") >= 3), "explorer").otherwise("moderate")
    return c.select("client_id", r6(F.col("top")).alias("loyalty"), "n_categories", segment.alias("segment"))


def user_segments(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Long table (client_id, segment): buyers, activity against 30 days and the median, frequency."""
    per = events.groupBy("client_id").agg(F.count_if(F.col("event_type") == "product_buy").alias("buys"), F.count("*").alias("n"), F.max("timestamp").alias("last"))
    per = per.withColumn("idle", days_between(conf.now, F.col("last")))
    (median,) = quantiles(per, "n", [0.5])
    b = F.col("buys")
    names = F.array_compact(
        F.array(
            F.when(b > 0, "buyers").otherwise("non_buyers"), F.when(F.col("idle") <= 30, "active_absolute").otherwise("inactive_absolute"),
            F.when(F.col("n") >= F.lit(median), "active_relative").otherwise("inactive_relative"),
            F.when(b == 1, "one_time_buyers").when(b.between(2, 5), "occasional_buyers").when(b > 5, "frequent_buyers"),
        )
    )
    return per.select("client_id", F.explode(names).alias("segment"))


def segments_of(segments: DataFrame) -> DataFrame:
    """Sorted segments of each client as one text."""
    return segments.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"))


def top_category(events: DataFrame) -> DataFrame:
    return top_k(category_counts(events), ["client_id"], [F.desc("n"), F.asc("category_id")], 1).drop("rank")
