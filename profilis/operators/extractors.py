"""A registry of feature extractors and the wide table that joins their results.

An extractor is a function (events, conf) -> DataFrame with one row per client. User code
registers its own; the wide table computes all of them over one client-partitioned frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import days_between
from profilis.functions.stats import r6
from profilis.functions.text import word_hash
from profilis.operators import activity, metrics, pairs, price, propensity, sequence, sessions
from profilis.operators.dataset import with_sequence_section

Extractor = Callable[[DataFrame, EngineConf], DataFrame]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        EXTRACTORS[name] = f
        return f

    return add


@extractor("recency")
def _recency(events: DataFrame, conf: EngineConf) -> DataFrame:
    return activity.recency_status(events, conf)


@extractor("funnel")
def _funnel(events: DataFrame, conf: EngineConf) -> DataFrame:
    return activity.funnel_rates(events)


@extractor("gaps")
def _gaps(events: DataFrame, conf: EngineConf) -> DataFrame:
    return sessions.inactivity_gaps(events, conf)


@extractor("sessions")
def _sessions(events: DataFrame, conf: EngineConf) -> DataFrame:
    return sessions.session_profile(events, conf.session_gap_s)


@extractor("rfm")
def _rfm(events: DataFrame, conf: EngineConf) -> DataFrame:
    return price.rfm(events, conf)


@extractor("churn")
def _churn(events: DataFrame, conf: EngineConf) -> DataFrame:
    return propensity.churn_signals(events, conf)


@extractor("compact")
def compact_metrics(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Burstiness, price shift, entropies of categories and prices."""
    out = metrics.burst_score(events)
    for part in (metrics.price_shift(events), price.category_entropy(events), metrics.price_entropy(events)):
        out = out.join(part, "client_id", "left")
    return out


@extractor("extra")
def extra_metrics(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Favourites, weekday entropy, time-of-day variance, recency rank, lifetime."""
    out = metrics.weekday_entropy(events)
    for part in (metrics.favourites(events), metrics.time_of_day_variance(events), metrics.recency_rank(events, conf).drop("days"), activity.lifetime_span(events)):
        out = out.join(part, "client_id", "left")
    return out


@extractor("cyclic")
def _cyclic(events: DataFrame, conf: EngineConf) -> DataFrame:
    return metrics.cyclic_means(events)


def wide_features(events: DataFrame, conf: EngineConf = CONF, names: list[str] | None = None) -> DataFrame:
    """One row per client with the columns of all extractors, each prefixed by its name.

    Every extractor reads only the columns it needs and groups by client, so what is shuffled
    are its columns or its partial sums; nothing is stored between them.
    """
    out = events.select("client_id").distinct()
    for name in names or EXTRACTORS:
        part = EXTRACTORS[name](events, conf)
        out = out.join(part.select("client_id", *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != "client_id"]), "client_id", "left")
    return out


def global_stats(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """One row: users, buyers, events, mean recency of buyers, cart to purchase, sessions."""
    per = events.groupBy("client_id").agg(F.max(F.when(F.col("event_type") == "product_buy", F.col("timestamp"))).alias("buy"), F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("n_users"), F.count("buy").alias("n_buyers"), F.sum("n").alias("n_events"), r6(F.avg(days_between(conf.now, F.col("buy")))).alias("mean_buy_recency"))
    carts = pairs.cart_to_purchase(events).select(F.col("n").alias("n_carts_bought"), F.col("mean_minutes").alias("cart_minutes"))
    stats = sessions.session_stats(events, conf.session_gap_s).select("n_sessions", "mean_minutes", "mean_events")
    return out.join(F.broadcast(carts)).join(F.broadcast(stats))  # single rows


def restricted_to(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Events of listed clients; a list of any length is a semi join."""
    return events.join(clients.select("client_id"), "client_id", "left_semi")


def rare_as_null(events: DataFrame, item: str, top: int) -> DataFrame:
    """Items outside the ``top`` most frequent ones become null."""
    best = events.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(top).select(item, F.lit(True).alias("__top"))
    return events.join(best, item, "left").withColumn(item, F.when(F.col("__top"), F.col(item))).drop("__top")


def url_sku_edges(events: DataFrame, gap_s: int = CONF.session_gap_s, top: int | None = None) -> DataFrame:
    """Pages and skus of one session as weighted edges U_page, S_sku; of the ``top`` most visited pages if given."""
    s = sessions.sessionize(events, gap_s)
    if top is not None:
        best = events.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(top).select("url", F.lit(True).alias("__top"))
        s = s.join(best, "url", "left").withColumn("url", F.when(F.col("__top"), F.col("url")))
    urls = s.where("event_type = 'page_visit' and url is not null").select("client_id", "session_id", F.concat(F.lit("U_"), word_hash(F.col("url"), 15).cast("string")).alias("src")).distinct()
    skus = s.where("sku is not null and event_type <> 'page_visit'").select("client_id", "session_id", F.concat(F.lit("S_"), F.col("sku").cast("string")).alias("dst")).distinct()
    return urls.join(skus, ["client_id", "session_id"]).groupBy("src", "dst").agg(F.count("*").alias("w"))


def with_raw_sequences(texts: DataFrame, sequences: DataFrame, key: str = "client_id", most: int = 1000) -> DataFrame:
    """Texts (key, text) without a raw sequence section get one before the end mark."""
    return texts.join(sequences, key, "left").select(key, with_sequence_section(F.col("text"), F.col("raw_sequence"), most).alias("text"))


def sequences_of(events: DataFrame, conf: EngineConf = CONF, k: int = 100) -> DataFrame:
    return sequence.raw_sequence_text(sequence.raw_sequence(events, conf, k))
