"""Queries on the extractor registry and what is assembled from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilis.operators import extractors, graph, vectors
from profilis.plans import profile_queries  # noqa: F401
from profilis.plans.activity_queries import SESSION_ROWS
from profilis.plans.behaviour_queries import ASOF
from profilis.plans.registry import NOW, ORACLES, X, days, query, sessions_sql
from profilis.sources.events import raw_events, client_events, with_urls


def _joined(parts: dict[str, str]) -> str:
    """The results of other queries side by side, each column under the part's name."""
    return X + " select c.client_id" + "".join(f", {name}.* exclude (client_id)" if not name else f", columns({name}.* exclude (client_id)) as '{name}_\\0'" for name in parts) + " from (select distinct client_id from x) c" + "".join(f" left join ({ORACLES[sql]}) {name} on {name}.client_id = c.client_id" for name, sql in parts.items())


def _beside(first: str, *others: str) -> str:
    return f"select * from ({ORACLES[first]})" + "".join(f" left join (select * from ({ORACLES[o]})) using (client_id)" for o in others)


COMPACT = ("burst_score", "price_shift", "category_entropy", "price_entropy")
EXTRA = ("weekday_entropy", "favourites", "time_of_day_variance", "recency_rank", "lifetime_span")
ORACLES["__compact"], ORACLES["__extra"] = _beside(*COMPACT), f"select * exclude (days) from ({_beside(*EXTRA)})"
PARTS = {"recency": "recency_status", "funnel": "funnel_rates", "gaps": "inactivity_gaps", "sessions": "session_night_share", "rfm": "rfm", "churn": "churn_signals", "compact": "__compact", "extra": "__extra", "cyclic": "cyclic_means"}
WIDE_SQL, COMPACT_SQL, EXTRA_SQL = _joined(PARTS), ORACLES.pop("__compact"), ORACLES.pop("__extra")


@query("wide_features", WIDE_SQL)
def wide_features(spark, sf_dir):
    return extractors.wide_features(client_events(spark, sf_dir))


@query("compact_metrics", COMPACT_SQL)
def compact_metrics(spark, sf_dir):
    return extractors.compact_metrics(client_events(spark, sf_dir))


@query("extra_metrics", EXTRA_SQL)
def extra_metrics(spark, sf_dir):
    return extractors.extra_metrics(client_events(spark, sf_dir))


@query("global_stats", X + ASOF + ", " + SESSION_ROWS.replace("s as", "s as", 1).replace(" r as", " rr as") + f""", u as (select client_id, max(timestamp) filter (event_type = 'product_buy') as b, count(*) as n from x group by 1),
g as (select count(*) as n_users, count(b) as n_buyers, cast(sum(n) as bigint) as n_events, round(avg({days(NOW, 'b')}), 6) as mean_buy_recency from u),
k as (select count(*) as n_carts_bought, round(avg(minutes), 6) as cart_minutes from r), z as (select count(*) as n_sessions, round(avg(t.m), 6) as mean_minutes, round(avg(t.n), 6) as mean_events from t)
select * from g, k, z""")
def global_stats(spark, sf_dir):
    return extractors.global_stats(client_events(spark, sf_dir))


@query("relevant_events", X + "select client_id, event_id, event_type from x where client_id % 3 <> 0")
def relevant_events(spark, sf_dir):
    e = raw_events(spark, sf_dir)
    clients = e.select("client_id").distinct().where("client_id % 3 <> 0")
    return extractors.restricted_to(e, clients).select("client_id", "event_id", "event_type")


@query("rare_as_null", X + ", b as (select sku from x where sku is not null group by 1 order by count(*) desc, sku limit 50) select event_id, b.sku from x left join b on b.sku = x.sku")
def rare_as_null(spark, sf_dir):
    return extractors.rare_as_null(client_events(spark, sf_dir), "sku", 50).select("event_id", "sku")


def _with_urls(spark, sf_dir):
    return with_urls(client_events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("url_sku_edges", X + ", n as (select count(*) as n from pages), v as (select x.*, url from x cross join n left join pages on event_type = 'page_visit' and page_id = k % n.n), " + sessions_sql("v", 86400) + """,
a as (select distinct client_id, session_id, url from s where event_type = 'page_visit' and url is not null), b as (select distinct client_id, session_id, sku from s where sku is not null and event_type <> 'page_visit'),
e as (select url, sku, count(*) as w from a join b on a.client_id = b.client_id and a.session_id = b.session_id group by all) select 'U_' || cast('0x' || substr(md5(url), 1, 15) as bigint) as src, 'S_' || sku as dst, w from e""")
def url_sku_edges(spark, sf_dir):
    """Every edge; pages go by a hash of their address."""
    return extractors.url_sku_edges(_with_urls(spark, sf_dir), 86400)


#: Pages that have vectors, and clusters of these.
PAGES, PAGE_CLUSTERS = 500, 20


def _page_vectors(spark, sf_dir):
    """Vectors of the most visited pages from walks over pages and skus."""
    edges = extractors.url_sku_edges(_with_urls(spark, sf_dir), 86400, PAGES)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return graph.walk_vectors(graph.random_walks(both)).where(F.col("node").startswith("U_"))


@query("url_vectors")
def url_vectors(spark, sf_dir):
    """Each page's vector and its similarity to the centre of all."""
    v = graph.cut(_page_vectors(spark, sf_dir))
    return v.join(vectors.similarity_to_centre(v, "node", "vector"), "node")


@query("page_clusters")
def page_clusters(spark, sf_dir):
    return vectors.clusters(_page_vectors(spark, sf_dir), "node", "vector", PAGE_CLUSTERS)
