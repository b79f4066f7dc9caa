"""Gap-based sessions and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import days_between, fractional_days, micros, whole_seconds
from profilis.functions.stats import quantiles, r6


def sessionize(events: DataFrame, gap_s: int = CONF.session_gap_s, key: str = "client_id", tie: str = "event_id") -> DataFrame:
    """Adds session_id per key: a new one after more than gap_s whole seconds."""
    w = W.partitionBy(key).orderBy("timestamp", tie)
    gap = whole_seconds(F.col("timestamp"), F.lag("timestamp").over(w))
    new = F.when(gap.isNull() | (gap > gap_s), 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("session_id", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def session_table(events: DataFrame, gap_s: int = CONF.session_gap_s) -> DataFrame:
    """One row per session: begin, end, events, minutes."""
    s = sessionize(events.select("client_id", "timestamp", "event_id"), gap_s)
    per = s.groupBy("client_id", "session_id").agg(F.min("timestamp").alias("begin"), F.max("timestamp").alias("end"), F.count("*").alias("n_events"))
    return per.withColumn("minutes", (micros("end") - micros("begin")) / F.lit(60e6))


def session_stats(events: DataFrame, gap_s: int = CONF.session_gap_s) -> DataFrame:
    """Over all sessions: count, means and medians of length and events."""
    table = session_table(events, gap_s)
    median = lambda c: r6(F.lit(quantiles(table, c, [0.5])[0]))
    return table.agg(
        F.count("*").alias("n_sessions"), r6(F.avg("minutes")).alias("mean_minutes"), median("minutes").alias("median_minutes"),
        r6(F.avg("n_events")).alias("mean_events"), median("n_events").alias("median_events"),
    )


def sessions_per_user(events: DataFrame, gap_s: int = CONF.session_gap_s) -> DataFrame:
    per = session_table(events, gap_s).groupBy("client_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_users"), r6(F.avg("n")).alias("mean_sessions"))


def session_profile(events: DataFrame, gap_s: int = CONF.session_gap_s) -> DataFrame:
    """Per client: sessions, share that begins in the evening or night, mean minutes and events, and tags."""
    hour = F.hour("begin")
    per = session_table(events, gap_s).groupBy("client_id").agg(
        F.count("*").alias("n_sessions"), F.avg(((hour >= 18) | (hour < 5)).cast("double")).alias("night"), F.avg("minutes").alias("m"), F.avg("n_events").alias("e"), F.sum("n_events").alias("n")
    )
    per = per.where("n >= 2")
    return per.select(
        "client_id", "n_sessions", r6(F.col("night")).alias("night_share"), r6(F.col("m")).alias("mean_minutes"), r6(F.col("e")).alias("mean_events"),
        F.when(F.col("night") > 0.7, "evening").when(F.col("night") < 0.3, "daytime").alias("time_tag"),
        F.when(F.col("m") < 5, "short").when(F.col("m") > 60, "long").alias("length_tag"),
        F.when(F.col("e") < 3, "shallow").when(F.col("e") > 15, "deep").alias("depth_tag"),
    )


def inactivity_gaps(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Per client: longest gap in days, gaps over 7 and 30 days, and the state now."""
    w = W.partitionBy("client_id").orderBy("timestamp", "event_id")
    g = events.select("client_id", "timestamp", fractional_days(F.col("timestamp"), F.lag("timestamp").over(w)).alias("gap"))
    per = g.groupBy("client_id").agg(F.max("gap").alias("gap"), F.count_if(F.col("gap") > 7).alias("gaps_7d"), F.count_if(F.col("gap") > 30).alias("gaps_30d"), F.max("timestamp").alias("last"))
    idle = days_between(conf.now, F.col("last"))
    return per.select("client_id", r6(F.col("gap")).alias("max_gap_days"), "gaps_7d", "gaps_30d", F.when(idle > 30, "inactive").when(idle > 7, "lapsing").otherwise("active").alias("state"))
