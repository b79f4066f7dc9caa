"""Queries on sources, counts, recency, sessions and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilis.operators import activity, sessions
from profilis.plans.registry import NOW, X, days, query, sessions_sql
from profilis.sources import events as src
from profilis.sources.events import client_events

SESSION_ROWS = f"""{sessions_sql()}, t as (
  select client_id, session_id, min(timestamp) as b, max(timestamp) as e, count(*) as n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60000000.0 as m from s group by all
)"""


@query("union_harmonised", X + "select client_id, timestamp, event_type, sku, cast(null as varchar) as url, query from ev")
def union_harmonised(spark, sf_dir):
    e = src.client_events(spark, sf_dir)
    # five sources with unlike columns and types, as separate files would have them
    parts = {t: e.where(F.col("event_type") == t).select("client_id", F.col("timestamp").cast("string").alias("timestamp"), "sku") for t in src.TYPES.values()}
    parts["search_query"] = e.where("event_type = 'search_query'").select("client_id", "timestamp", "query")
    return src.union_sources(parts | {"absent": None})


@query("product_lookup", X + "select client_id, event_id, sku, category_id, price_bucket, brand from x")
def product_lookup(spark, sf_dir):
    return client_events(spark, sf_dir).select("client_id", "event_id", "sku", "category_id", "price_bucket", "brand")


@query(
    "event_urls",
    X + ", n as (select count(*) as n from pages) select ev.client_id, ev.event_id, pages.url from ev, n left join pages on ev.event_type = 'page_visit' and pages.page_id = ev.k % n.n",
)
def event_urls(spark, sf_dir):
    return src.with_urls(src.client_events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")).select("client_id", "event_id", "url")


@query("event_type_counts", X + "select client_id, event_type, count(*) as n from x group by all")
def event_type_counts(spark, sf_dir):
    return activity.event_type_counts(client_events(spark, sf_dir))


@query("global_event_counts", X + "select event_type, count(*) as n, count(distinct client_id) as n_clients from x group by all")
def global_event_counts(spark, sf_dir):
    return activity.global_event_counts(client_events(spark, sf_dir))


@query("buyer_share", X + ", c as (select client_id, max(cast(event_type = 'product_buy' as int)) as b from x group by 1) select count(*) as n_users, cast(sum(b) as bigint) as n_buyers, round(avg(b), 6) as buyer_share from c")
def buyer_share(spark, sf_dir):
    return activity.buyer_share(client_events(spark, sf_dir))


HOURS = ", h as (select client_id, cast(hour(timestamp) as integer) as hour, count(*) as n from x group by all), p as (select * from h qualify n >= 0.8 * max(n) over (partition by client_id))"


@query("hour_peaks", X + HOURS + "select client_id, hour, n from p")
def hour_peaks(spark, sf_dir):
    return activity.hour_peaks(client_events(spark, sf_dir))


@query(
    "daypart_dominance",
    X + HOURS + """, d as (select client_id, count(*) filter (hour >= 5 and hour < 12) as m, count(*) filter (hour >= 12 and hour < 18) as a, count(*) filter (hour >= 18 or hour < 5) as e from p group by 1)
select client_id, case when m >= a and m >= e then 'Morning' when a >= e then 'Afternoon' else 'Evening' end as daypart from d""",
)
def daypart_dominance(spark, sf_dir):
    return activity.daypart_dominance(client_events(spark, sf_dir))


WEEKDAYS = ", d as (select client_id, cast(isodow(timestamp) as integer) as weekday, count(*) as n from x group by all), p as (select *, n >= 0.8 * max(n) over (partition by client_id) as is_peak from d)"


@query("weekday_activity", X + WEEKDAYS + "select client_id, weekday, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][weekday] as day, n, is_peak from p")
def weekday_activity(spark, sf_dir):
    return activity.weekday_activity(client_events(spark, sf_dir))


@query(
    "weekend_tag",
    X + WEEKDAYS + ", c as (select client_id, count(*) filter (weekday >= 6) as e, count(*) filter (weekday < 6) as w from p where is_peak group by 1) select client_id, case when w > e then 'weekday' when e > w then 'weekend' else 'mixed' end as tag from c",
)
def weekend_tag(spark, sf_dir):
    return activity.weekend_tag(client_events(spark, sf_dir))


@query(
    "recency_status",
    X + f""", r as (select client_id, max(timestamp) as l, max(timestamp) filter (event_type = 'product_buy') as b, max(timestamp) filter (event_type = 'add_to_cart') as c from x group by 1),
d as (select client_id, {days(NOW, 'l')} as days_since_last, {days(NOW, 'b')} as days_since_buy, {days(NOW, 'c')} as days_since_cart from r)
select *, case when days_since_last <= 7 then 'very_recent' when days_since_last <= 30 then 'moderately_recent' when days_since_last <= 90 then 'lapsed' else 'inactive' end as status from d""",
)
def recency_status(spark, sf_dir):
    return activity.recency_status(client_events(spark, sf_dir))


@query(
    "active_days_30d",
    X + f""", r as (select *, epoch_us({NOW}) - epoch_us(timestamp) <= 30 * 86400000000 as m, epoch_us({NOW}) - epoch_us(timestamp) <= 14 * 86400000000 as f from x),
g as (select client_id, count(*) filter (m) as events_30d, count(distinct case when m then cast(timestamp as date) end) as days_30d, min(timestamp) as first, avg(cast(f as int)) as share from r group by 1)
select client_id, events_30d, days_30d, round(days_30d / greatest(1, least(30, {days(NOW, 'first')})), 6) as active_ratio, round(share, 6) as share_14d, share > 0.5 as recent_heavy from g""",
)
def active_days_30d(spark, sf_dir):
    return activity.active_days(client_events(spark, sf_dir))


@query("sessionize", X + ", " + sessions_sql() + " select client_id, event_id, session_id from s")
def sessionize(spark, sf_dir):
    return sessions.sessionize(client_events(spark, sf_dir)).select("client_id", "event_id", "session_id")


STATS = "select count(*) as n_sessions, round(avg(m), 6) as mean_minutes, round(quantile_cont(m, 0.5), 6) as median_minutes, round(avg(n), 6) as mean_events, round(quantile_cont(n, 0.5), 6) as median_events from t"


@query("session_stats", X + ", " + SESSION_ROWS + STATS)
def session_stats(spark, sf_dir):
    return sessions.session_stats(client_events(spark, sf_dir))


@query("session_stats_6h", X + ", " + SESSION_ROWS.replace("> 1800", "> 21600") + STATS)
def session_stats_6h(spark, sf_dir):
    return sessions.session_stats(client_events(spark, sf_dir), 21600)


@query("sessions_per_user", X + ", " + SESSION_ROWS + ", u as (select client_id, count(*) as n from t group by 1) select count(*) as n_users, round(avg(n), 6) as mean_sessions from u")
def sessions_per_user(spark, sf_dir):
    return sessions.sessions_per_user(client_events(spark, sf_dir))


@query(
    "session_night_share",
    X + ", " + SESSION_ROWS + """, p as (select client_id, count(*) as n_sessions, avg(cast(hour(b) >= 18 or hour(b) < 5 as int)) as night, avg(m) as mm, avg(n) as ne, sum(n) as total from t group by 1)
select client_id, n_sessions, round(night, 6) as night_share, round(mm, 6) as mean_minutes, round(ne, 6) as mean_events, case when night > 0.7 then 'evening' when night < 0.3 then 'daytime' end as time_tag,
  case when mm < 5 then 'short' when mm > 60 then 'long' end as length_tag, case when ne < 3 then 'shallow' when ne > 15 then 'deep' end as depth_tag from p where total >= 2""",
)
def session_night_share(spark, sf_dir):
    return sessions.session_profile(client_events(spark, sf_dir))


@query(
    "inactivity_gaps",
    X + f""", g as (select client_id, timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by client_id order by timestamp, event_id))) / 86400000000.0 as gap from x),
p as (select client_id, max(gap) as gap, count(*) filter (gap > 7) as gaps_7d, count(*) filter (gap > 30) as gaps_30d, {days(NOW, 'max(timestamp)')} as idle from g group by 1)
select client_id, round(gap, 6) as max_gap_days, gaps_7d, gaps_30d, case when idle > 30 then 'inactive' when idle > 7 then 'lapsing' else 'active' end as state from p""",
)
def inactivity_gaps(spark, sf_dir):
    return sessions.inactivity_gaps(client_events(spark, sf_dir))


FUNNEL = """, f as (select client_id, count(*) filter (event_type = 'page_visit') as views, count(*) filter (event_type = 'search_query') as searches, count(*) filter (event_type = 'add_to_cart') as carts,
  count(*) filter (event_type = 'product_buy') as buys from x group by 1)"""


@query(
    "funnel_rates",
    X + FUNNEL + """select client_id, views + searches as starts, carts, buys, case when views + searches > 0 then round(carts / (views + searches), 6) end as cart_rate,
  case when carts > 0 then round(buys / carts, 6) end as buy_rate, case when views + searches > 0 then round(buys / (views + searches), 6) end as overall_rate, buys > 0 and carts = 0 as direct_buys from f""",
)
def funnel_rates(spark, sf_dir):
    return activity.funnel_rates(client_events(spark, sf_dir))


@query("funnel_stage", X + FUNNEL + "select client_id, case when buys > 0 then 'Conversion' when carts > 0 then 'Consideration' when searches > 0 or views > 5 then 'Research' when views > 0 then 'Awareness' else 'Inactive' end as stage from f")
def funnel_stage(spark, sf_dir):
    return activity.funnel_stage(client_events(spark, sf_dir))


@query("cart_abandon", X + FUNNEL + "select client_id, round(buys / carts, 6) as ratio, case when buys / carts < 0.2 then 'high_abandon' when buys / carts > 0.8 then 'high_conversion' end as tag from f where carts > 0")
def cart_abandon(spark, sf_dir):
    return activity.cart_abandon(client_events(spark, sf_dir))


@query(
    "search_intent",
    X + """, q as (select client_id, query, count(*) as n from x where event_type = 'search_query' group by all), r as (select *, row_number() over (partition by client_id order by n desc, query) as r from q)
select client_id, cast(sum(n) as bigint) as n_searches, count(*) as n_queries, count(*) filter (n > 1) as n_repeated, max(case when r = 1 then query end) as top_query, max(n) as top_n from r group by 1""",
)
def search_intent(spark, sf_dir):
    return activity.search_intent(client_events(spark, sf_dir))


@query("lifetime_span", X + f"select client_id, {days('max(timestamp)', 'min(timestamp)')} as lifetime_days from x group by 1")
def lifetime_span(spark, sf_dir):
    return activity.lifetime_span(client_events(spark, sf_dir))


@query("client_lookup", X + "select client_id, timestamp, event_id, event_type from x where client_id = 7")
def client_lookup(spark, sf_dir):
    """A point scan: the filter reaches the parquet scan."""
    return client_events(spark, sf_dir).where("client_id = 7").select("client_id", "timestamp", "event_id", "event_type")
