"""Event and category sequences: transitions, n-grams, raw event tokens, history windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.conf import CONF, EngineConf
from profilis.functions.dates import age_bucket, days_between, delta_bucket, micros, time_of_day
from profilis.functions.stats import r6, top_k
from profilis.functions.text import word_hash
from profilis.operators.sessions import sessionize


def in_order() -> W:
    """Each client's events in their total order."""
    return W.partitionBy("client_id").orderBy("timestamp", "event_id")


def transition_matrix(events: DataFrame) -> DataFrame:
    """P(next type | previous type) over each client's order."""
    pairs = events.select(F.lag("event_type").over(in_order()).alias("prev"), F.col("event_type").alias("next")).where("prev is not null")
    counts = pairs.groupBy("prev", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", r6(F.col("n") / F.sum("n").over(W.partitionBy("prev"))))


def event_ngrams(events: DataFrame, n: int, k: int, least: int = 2) -> DataFrame:
    """Each client's k most frequent n-grams of event types with at least ``least`` occurrences."""
    grams = events.select("client_id", F.concat_ws(" -> ", "event_type", *[F.lead("event_type", i).over(in_order()) for i in range(1, n)]).alias("gram"), F.lead("event_type", n - 1).over(in_order()).alias("end"))
    counts = grams.where("end is not null").groupBy("client_id", "gram").agg(F.count("*").alias("n"))
    counts = counts.withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy("client_id"))))
    return top_k(counts.where(F.col("n") >= least), ["client_id"], [F.desc("n"), F.asc("gram")], k)


def ping_pong(events: DataFrame) -> DataFrame:
    """Places where a client's types go A, B, A, B with A unlike B."""
    e = lambda i: F.lead("event_type", i).over(in_order())
    w = events.select("client_id", F.col("event_type").alias("a"), e(1).alias("b"), e(2).alias("c"), e(3).alias("d"))
    return w.where("a = c and b = d and a <> b").groupBy("client_id").agg(F.count("*").alias("n"))


def browse_trigrams(events: DataFrame, gap_s: int, kinds: tuple[str, ...] = ("page_visit",)) -> DataFrame:
    """Each client's most frequent triple of categories, in order of first sight in a session."""
    s = sessionize(events.where(F.col("event_type").isin(*kinds) & F.col("category_id").isNotNull()).select("client_id", "timestamp", "event_id", "category_id"), gap_s)
    first = s.groupBy("client_id", "session_id", "category_id").agg(F.min(F.struct("timestamp", "event_id")).alias("at"))
    w = W.partitionBy("client_id", "session_id").orderBy("at")
    tri = first.select("client_id", F.col("category_id").alias("a"), F.lead("category_id", 1).over(w).alias("b"), F.lead("category_id", 2).over(w).alias("c"))
    counts = tri.where("c is not null").groupBy("client_id", "a", "b", "c").agg(F.count("*").alias("n"))
    return top_k(counts, ["client_id"], [F.desc("n"), F.asc("a"), F.asc("b"), F.asc("c")], 1).drop("rank")


def category_transitions(events: DataFrame, kinds: tuple[str, ...] = ("page_visit", "product_buy")) -> DataFrame:
    """Edges between unlike neighbouring categories of each client's order."""
    e = events.where(F.col("event_type").isin(*kinds) & F.col("category_id").isNotNull())
    pairs = e.select(F.lag("category_id").over(in_order()).alias("src"), F.col("category_id").alias("dst")).where("src is not null and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("w"))


def client_category_transitions(events: DataFrame) -> DataFrame:
    """The same per client over all events with a category."""
    e = events.where(F.col("category_id").isNotNull())
    pairs = e.select("client_id", F.lag("category_id").over(in_order()).alias("src"), F.col("category_id").alias("dst")).where("src is not null and src <> dst")
    return pairs.groupBy("client_id", "src", "dst").agg(F.count("*").alias("w"))


def top_transition(edges: DataFrame, least: int = 2) -> DataFrame:
    """Each client's heaviest category transition."""
    top = top_k(edges.where(F.col("w") >= least), ["client_id"], [F.desc("w"), F.asc("src"), F.asc("dst")], 1)
    return top.drop("rank")


# -- windows of history -----------------------------------------------------------
def history_windows(events: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """Per client and window (recent < 14 days, medium < 90, old): events, types and span."""
    age = micros(conf.now) - micros("timestamp")
    day = 86_400_000_000
    window = F.when(age < 14 * day, "recent").when(age < 90 * day, "medium").otherwise("old")
    per = events.groupBy("client_id", window.alias("window"))
    buys = F.count_if(F.col("event_type") == "product_buy")
    return per.agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types"), buys.alias("n_buys"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).select(
        "client_id", "window", "n_events", "n_types", "n_buys", days_between(F.col("last"), F.col("first")).cast("bigint").alias("span_days")
    )


def recent_lines(events: DataFrame, conf: EngineConf = CONF, k: int = 30, days: int = 14) -> DataFrame:
    """One line of text per event of the recent window, the last k; pos -1 is the latest.

    An event shows its sku with the product's category and price, else its page, else a short hash of its query.
    """
    recent = events.where(micros("timestamp") >= micros(conf.now) - days * 86_400_000_000)
    last = top_k(recent, ["client_id"], [F.desc("timestamp"), F.desc("event_id")], k)
    part = lambda mark, c: F.coalesce(F.concat(F.lit(f" {mark}:"), F.col(c).cast("string")), F.lit(""))
    what = F.when(F.col("sku").isNotNull(), F.concat(part("S", "sku"), part("C", "category_id"), part("P", "price_bucket")))
    if "url" in events.columns:
        what = what.when(F.col("url").isNotNull(), part("U", "url"))
    if "query" in events.columns:
        what = what.when(F.col("query").isNotNull(), F.concat(F.lit(" Q:"), F.lpad((word_hash(F.col("query")) % 10000).cast("string"), 4, "0")))
    line = F.concat(F.lit("["), F.date_format("timestamp", "yyyyMMdd-HHmm"), F.lit("] E:"), "event_type", what.otherwise(""))
    return last.select("client_id", (F.lit(0) - F.col("rank")).alias("pos"), line.alias("line"))


def raw_sequence(events: DataFrame, conf: EngineConf = CONF, k: int = 100, names: DataFrame | None = None, quantiles: DataFrame | None = None) -> DataFrame:
    """Tokens of each client's last k events: time since the one before, time of day, weekday, age.

    Sessions are those of the kept events, so that the first one always begins a session.
    names (sku, name: array of numbers) and quantiles (sku, quantile) add what products have.
    """
    last = top_k(events, ["client_id"], [F.desc("timestamp"), F.desc("event_id")], k).drop("rank")
    if "url" not in events.columns:
        last = last.withColumn("url", F.lit(None).cast("string"))
    last = last.join(names.select("sku", F.array_join(F.transform("name", lambda x: x.cast("bigint").cast("string")), " ").alias("name")), "sku", "left") if names is not None else last.withColumn("name", F.lit(None).cast("string"))
    quantile = F.coalesce("quantile", F.lit("Q0")) if quantiles is not None else F.lit(None).cast("string")
    last = (last.join(quantiles.select("sku", "quantile"), "sku", "left") if quantiles is not None else last).withColumn("popularity", quantile)
    s = sessionize(last, conf.session_gap_s)
    w = in_order()
    s = s.withColumn("before", F.lag("timestamp").over(w)).withColumn("session_before", F.lag("session_id").over(w))
    seconds = (micros("timestamp") - micros("before")) / F.lit(1e6)
    return s.select(
        "client_id", "event_id", "session_id", "event_type", "sku", "category_id", "price_bucket", "query", "url", "name", "popularity",
        F.when(F.col("session_before").isNull() | (F.col("session_before") != F.col("session_id")), "T_SessionStart").otherwise(delta_bucket(seconds)).alias("delta"),
        time_of_day(F.hour("timestamp")).alias("tod"), F.when(F.weekday("timestamp") < 5, "Weekday").otherwise("Weekend").alias("dow"),
        age_bucket(days_between(conf.now, F.col("timestamp"))).alias("age"),
    )


def _marked(name: str, value: Column, when: Column | None = None) -> Column:
    """`` NAME:[value]``, or nothing where there is no value or ``when`` doesn't hold."""
    text = F.concat(F.lit(f" {name}:["), value, F.lit("]"))
    return F.coalesce(text if when is None else F.when(when, text), F.lit(""))


def raw_sequence_text(tokens: DataFrame) -> DataFrame:
    """The tokens of a client as one text: events and marks of sessions, joined by </s>.

    Only purchases, cart additions and removals show a product; removals show neither its
    category nor its price. A query that is no bracketed list is called invalid.
    """
    kind, q = F.col("event_type"), F.col("query")
    product = kind.isin("product_buy", "add_to_cart", "remove_from_cart")
    priced = product & (kind != "remove_from_cart") & F.col("sku").isNotNull()
    inner = F.replace(F.regexp_replace(q, r"^[\[\]]+|[\[\]]+$", ""), F.lit(","), F.lit(" "))
    text = F.concat(
        F.lit("EVENT: "), kind, _marked("SKU", F.concat(F.lit("SKU_"), F.col("sku").cast("string")), product),
        _marked("CAT", F.concat(F.lit("CAT_"), F.col("category_id").cast("string")), priced), _marked("PRICE", F.concat(F.lit("PRICE_"), F.col("price_bucket").cast("string")), priced),
        _marked("NAME_EMB", F.col("name"), product & F.col("sku").isNotNull()), _marked("URL", F.concat(F.lit("URL_"), "url"), (kind == "page_visit") & (F.col("url") != "")),
        _marked("QUERY_EMB", F.when(q.startswith("[") & q.endswith("]"), inner).otherwise("InvalidFormat"), (kind == "search_query") & (q != "")),
        _marked("POP_Q", F.col("popularity")), _marked("AGE", F.col("age")), _marked("TOD", F.col("tod")), _marked("DOW", F.col("dow")), _marked("TIME_DELTA", F.col("delta")),
    )
    per = tokens.select("client_id", "session_id", "event_id", text.alias("line")).groupBy("client_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    whole = F.concat(F.array(F.lit("<SESS_START>")), F.transform("l", lambda x: x["line"]), F.array(F.lit("<SESS_END>")))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("session_id", whole.alias("l")))), lambda x: x["l"]))
    return per.groupBy("client_id").agg(F.array_join(ordered, "</s>").alias("raw_sequence"))
