"""Item pairs of sessions, co-occurrence graphs, conversion between events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.functions.dates import micros
from profilis.functions.stats import guarded, quantiles, r6, top_k
from profilis.operators.sessions import sessionize


def session_pairs(events: DataFrame, item: str, gap_s: int, kinds: tuple[str, ...], cap: int | None = 20, least: int = 1) -> DataFrame:
    """Pairs i < j of a session's distinct items, of which the ``cap`` least ids take part; without a cap all do.

    A cap is part of the operator: it bounds pairs per session to cap * (cap - 1) / 2.
    """
    e = events.where(F.col("event_type").isin(*kinds) & F.col(item).isNotNull()).select("client_id", "timestamp", "event_id", item)
    return pairs_of_sessions(sessionize(e, gap_s), item, cap, least)


def pairs_of_sessions(events: DataFrame, item: str, cap: int | None = 20, least: int = 1) -> DataFrame:
    """The same for events that have a session_id.

    Where only pairs of ``least`` sessions of a client count, items that it met in fewer sessions
    can be in none and are left out before pairs are made.
    """
    taking = events.select("client_id", "session_id", F.col(item).alias("item")).distinct()
    if cap is not None:
        taking = top_k(taking, ["client_id", "session_id"], [F.asc("item")], cap)
    if least > 1:
        taking = taking.withColumn("met", F.count("*").over(W.partitionBy("client_id", "item"))).where(F.col("met") >= least)
    items = taking.groupBy("client_id", "session_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    at = items.where(F.size("items") > 1).select("client_id", "session_id", "items", F.posexplode("items").alias("pos", "i"))
    return at.select("client_id", "session_id", "i", F.explode(F.slice("items", F.col("pos") + 2, F.size("items"))).alias("j"))


def central_edges(events: DataFrame, popularity: DataFrame, gap_s: int, top: int = 2000, least: int = 100) -> DataFrame:
    """Skus of one session among the ``top`` most popular ones, as weighted edges from the lesser to the greater id.

    Skus without any score take part only if fewer than ``least`` have one. No session gives
    more than top * (top - 1) / 2 pairs.
    """
    scored = popularity.where("score > 0")
    pool = scored if scored.limit(least).count() == least else popularity
    best = pool.orderBy(F.desc("score"), "sku").limit(top).select("sku")  # at most ``top`` rows
    e = sessionize(events.join(F.broadcast(best), "sku", "left_semi").select("client_id", "timestamp", "event_id", "sku"), gap_s)
    return pairs_of_sessions(e, "sku", top).groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.count("*").alias("w"))


def top_co_pairs(pairs: DataFrame, k: int = 5, least: int = 1) -> DataFrame:
    """Each client's most frequent pairs."""
    counts = pairs.groupBy("client_id", "i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_k(counts, ["client_id"], [F.desc("n"), F.asc("i"), F.asc("j")], k)


def global_co_pairs(events: DataFrame, item: str, gap_s: int, kinds: tuple[str, ...], top_items: int, k: int, cap: int = 20, clients: DataFrame | None = None) -> DataFrame:
    """The k most frequent pairs among the most frequent items, over all clients or listed ones."""
    e = events.where(F.col("event_type").isin(*kinds) & F.col(item).isNotNull())
    popular = e.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(top_items).select(item)  # at most top_items rows
    e = e if clients is None else e.join(clients.select("client_id"), "client_id", "left_semi")
    pairs = session_pairs(e.join(popular, item, "left_semi"), item, gap_s, kinds, cap)
    return pairs.groupBy("i", "j").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "i", "j").limit(k)


def client_global_pairs(events: DataFrame, pairs: DataFrame, item: str) -> DataFrame:
    """Global pairs (a short list) of which a client touched both members."""
    touched = events.where(F.col(item).isNotNull()).select("client_id", F.col(item).alias("i")).distinct()
    one = touched.join(pairs, "i")
    return one.join(touched.withColumnRenamed("i", "j"), ["client_id", "j"], "left_semi").select("client_id", "i", "j", "n")


def pair_graph_stats(pairs: DataFrame, least_nodes: int = 2, digits: int = 6) -> DataFrame:
    """Per client: nodes, edges, density with a tag, and the node of highest degree."""
    edges = pairs.groupBy("client_id", "i", "j").agg(F.count("*").alias("w"))
    ends = edges.select("client_id", F.explode(F.array("i", "j")).alias("node"))
    degree = ends.groupBy("client_id", "node").agg(F.count("*").alias("degree"))
    per = degree.groupBy("client_id").agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.max("degree").alias("top_degree"), F.min_by("node", F.struct(-F.col("degree"), "node")).alias("top_node"))
    density = 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))
    return per.where(F.col("nodes") >= least_nodes).select("client_id", "nodes", "edges", F.round(density, digits).alias("density"), F.when(density > 0.5, "dense").when(density < 0.1, "sparse").alias("tag"), "top_node", "top_degree")


# -- conversion ---------------------------------------------------------------------
def last_cart_before(events: DataFrame) -> DataFrame:
    """As-of join: the last cart addition strictly before each purchase of the same sku.

    One window over (client, sku) instead of a join; purchases at one time count once.
    """
    at = micros("timestamp")
    e = events.where(F.col("event_type").isin("add_to_cart", "product_buy") & F.col("sku").isNotNull()).select("client_id", "sku", "event_type", at.alias("at"))
    w = W.partitionBy("client_id", "sku").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    cart = F.max(F.when(F.col("event_type") == "add_to_cart", F.col("at"))).over(w)
    buys = e.withColumn("cart", cart).where("event_type = 'product_buy' and cart is not null").select("client_id", "sku", "at", "cart").distinct()
    return buys.select("client_id", "sku", F.col("at").alias("buy_us"), F.col("cart").alias("cart_us"), r6((F.col("at") - F.col("cart")) / F.lit(60e6)).alias("minutes"))


def cart_to_purchase(events: DataFrame) -> DataFrame:
    found = last_cart_before(events)
    return found.agg(F.count("*").alias("n"), r6(F.avg("minutes")).alias("mean_minutes"), r6(F.lit(quantiles(found, "minutes", [0.5])[0])).alias("median_minutes"))


def cart_conversion(events: DataFrame) -> DataFrame:
    """Per client: share of cart additions whose sku was ever bought, and the mean delay of
    all ordered (addition, purchase) pairs of a sku.

    The pairs' delays follow from running counts and sums over each (client, sku) in order
    of time, so no pair is ever built.
    """
    at = micros("timestamp")
    e = events.where(F.col("event_type").isin("add_to_cart", "product_buy") & F.col("sku").isNotNull()).select("client_id", "sku", (F.col("event_type") == "add_to_cart").alias("add"), at.alias("at"))
    w = W.partitionBy("client_id", "sku")
    before = w.orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    first = F.min("at").over(w)
    e = e.withColumn("rel", F.col("at") - first).withColumn("ever", F.max(~F.col("add")).over(w))
    adds, total = F.coalesce(F.count_if("add").over(before), F.lit(0)), F.coalesce(F.sum(F.when(F.col("add"), F.col("rel"))).over(before), F.lit(0))
    e = e.withColumn("pairs", F.when(~F.col("add"), adds).otherwise(0)).withColumn("delay", F.when(~F.col("add"), adds * F.col("rel") - total).otherwise(0))
    per = e.groupBy("client_id").agg(F.count_if("add").alias("carts"), F.count_if(F.col("add") & F.col("ever")).alias("converted"), F.sum("pairs").alias("pairs"), F.sum(F.col("delay").cast("double")).alias("delay"))
    return per.where("carts > 0").select("client_id", "carts", "converted", r6(F.col("converted") / F.col("carts")).alias("conversion_rate"), "pairs", r6(guarded(F.col("delay") / F.lit(60e6), F.col("pairs"))).alias("mean_minutes"))
