"""Queries on sequences, pairs, conversion, propensity, price and popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilis.operators import dataset, pairs, price, propensity, sequence
from profilis.plans.registry import NOW, X, days, query, sessions_sql
from profilis.sources.events import client_events, order_events, with_urls

DAY = 86400
W = "window w as (partition by client_id order by timestamp, event_id)"


@query("event_transitions", X + f""", p as (select lag(event_type) over w as prev, event_type as next from x {W}), c as (select prev, next, count(*) as n from p where prev is not null group by all)
select prev, next, n, round(n / sum(n) over (partition by prev), 6) as p from c""")
def event_transitions(spark, sf_dir):
    return sequence.transition_matrix(client_events(spark, sf_dir))


def _ngrams(n: int, k: int) -> str:
    tail = " || ' -> ' || ".join(["event_type", *[f"lead(event_type, {i}) over w" for i in range(1, n)]])
    return X + f""", g as (select client_id, {tail} as gram from x {W}), c as (select client_id, gram, count(*) as n from g where gram is not null group by all),
t as (select *, round(n / sum(n) over (partition by client_id), 6) as share from c)
select client_id, gram, n, share, cast(row_number() over (partition by client_id order by n desc, gram) as integer) as rank from t where n >= 2 qualify row_number() over (partition by client_id order by n desc, gram) <= {k}"""


@query("event_trigrams", _ngrams(3, 2))
def event_trigrams(spark, sf_dir):
    return sequence.event_ngrams(client_events(spark, sf_dir), 3, 2)


@query("event_fourgrams", _ngrams(4, 1))
def event_fourgrams(spark, sf_dir):
    return sequence.event_ngrams(client_events(spark, sf_dir), 4, 1)


@query("ping_pong", X + f""", g as (select client_id, event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c, lead(event_type, 3) over w as d from x {W})
select client_id, count(*) as n from g where a = c and b = d and a <> b group by 1""")
def ping_pong(spark, sf_dir):
    return sequence.ping_pong(client_events(spark, sf_dir))


@query("browse_trigrams", X + f""", v as (select client_id, timestamp, event_id, category_id from x where event_type = 'page_visit' and category_id is not null), {sessions_sql('v', 7 * DAY)},
f as (select client_id, session_id, category_id, min((timestamp, event_id)) as seen from s group by all),
t as (select client_id, category_id as a, lead(category_id, 1) over q as b, lead(category_id, 2) over q as c from f window q as (partition by client_id, session_id order by seen)),
n as (select client_id, a, b, c, count(*) as n from t where c is not null group by all)
select * from n qualify row_number() over (partition by client_id order by n desc, a, b, c) = 1""")
def browse_trigrams(spark, sf_dir):
    return sequence.browse_trigrams(client_events(spark, sf_dir), 7 * DAY)


@query("category_transitions", X + f""", c as (select * from x where event_type in ('page_visit', 'product_buy') and category_id is not null), p as (select lag(category_id) over w as src, category_id as dst from c {W})
select src, dst, count(*) as w from p where src <> dst group by all""")
def category_transitions(spark, sf_dir):
    return sequence.category_transitions(client_events(spark, sf_dir))


@query("top_category_transition", X + f""", c as (select * from x where category_id is not null), p as (select client_id, lag(category_id) over w as src, category_id as dst from c {W}),
n as (select client_id, src, dst, count(*) as w from p where src <> dst group by all)
select * from n where w >= 2 qualify row_number() over (partition by client_id order by w desc, src, dst) = 1""")
def top_category_transition(spark, sf_dir):
    return sequence.top_transition(sequence.client_category_transitions(client_events(spark, sf_dir)))


@query("history_windows", X + f""", a as (select *, epoch_us({NOW}) - epoch_us(timestamp) as age from x), b as (select *, case when age < 14 * 86400000000 then 'recent' when age < 90 * 86400000000 then 'medium' else 'old' end as win from a)
select client_id, win as "window", count(*) as n_events, count(distinct event_type) as n_types, count(*) filter (event_type = 'product_buy') as n_buys, {days('max(timestamp)', 'min(timestamp)')} as span_days from b group by 1, 2""")
def history_windows(spark, sf_dir):
    return sequence.history_windows(client_events(spark, sf_dir))


@query("history_lines", X + f""", r as (select *, row_number() over (partition by client_id order by timestamp desc, event_id desc) as r from x where epoch_us(timestamp) >= epoch_us({NOW}) - 14 * 86400000000)
select client_id, cast(-r as integer) as pos, '[' || strftime(timestamp, '%Y%m%d-%H%M') || '] E:' || event_type || case when sku is not null then ' S:' || sku || coalesce(' C:' || category_id, '') || coalesce(' P:' || price_bucket, '') when query is not null then ' Q:' || lpad(cast(cast('0x' || substr(md5(query), 1, 13) as bigint) % 10000 as varchar), 4, '0') else '' end as line from r where r <= 30""")
def history_lines(spark, sf_dir):
    return sequence.recent_lines(client_events(spark, sf_dir))


SKU_QUANTILES = """, rc as (select sku, count(*) filter (event_type = 'page_visit') as v, count(*) filter (event_type = 'add_to_cart') as a, count(*) filter (event_type = 'product_buy') as b from x where sku is not null group by 1),
rp as (select sku, case when sum(v) over () > 0 then v + 3 * a + 10 * b else 2 * a + 10 * b end as score from rc), rq as (select quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.5) as q2, quantile_cont(score, 0.75) as q3 from rp),
rs as (select sku, case when score <= q1 then 'Q1' when score <= q2 then 'Q2' when score <= q3 then 'Q3' else 'Q4' end as quantile from rp, rq)"""
RAW = X + SKU_QUANTILES + """, n0 as (select count(*) as n from pages), xu as (select x.*, url from x cross join n0 left join pages on event_type = 'page_visit' and page_id = k % n0.n),
rn as (select vec_id as sku, array_to_string(list_transform(embedding[1:36], lambda q: cast(floor(256 * cast(q as double)) as bigint)), ' ') as name from embeddings),
rk as (select xu.*, rn.name, coalesce(rs.quantile, 'Q0') as popularity from (select * from xu qualify row_number() over (partition by client_id order by timestamp desc, event_id desc) <= {k}) xu left join rn on rn.sku = xu.sku left join rs on rs.sku = xu.sku), """ + sessions_sql("rk") + f""",
rt as (select *, lag(session_id) over w as sb, (epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1000000.0 as sec, {days(NOW, 'timestamp')} as age_days from s {W}),
tk as (select client_id, event_id, session_id, event_type, sku, category_id, price_bucket, query, url, name, popularity,
  case when sb is null or sb <> session_id then 'T_SessionStart' when sec < 0 then 'T_Error' when sec <= 5 then 'T_0-5s' when sec <= 30 then 'T_5-30s' when sec <= 120 then 'T_30s-2m' when sec <= 600 then 'T_2m-10m' when sec <= 1800 then 'T_10m-30m' else 'T_30m+' end as delta,
  case when hour(timestamp) between 5 and 11 then 'Morning' when hour(timestamp) between 12 and 17 then 'Afternoon' when hour(timestamp) between 18 and 21 then 'Evening' else 'Night' end as tod,
  case when isodow(timestamp) <= 5 then 'Weekday' else 'Weekend' end as dow, case when age_days <= 1 then 'D_0-1' when age_days <= 7 then 'D_1-7' when age_days <= 30 then 'D_7-30' when age_days <= 180 then 'D_30-180' else 'D_180+' end as age from rt)"""
RAW_TEXT = """, re as (select client_id, session_id, event_id, 'EVENT: ' || event_type
  || case when event_type in ('product_buy', 'add_to_cart', 'remove_from_cart') and sku is not null then ' SKU:[SKU_' || sku || ']' || case when event_type <> 'remove_from_cart' then coalesce(' CAT:[CAT_' || category_id || ']', '') || coalesce(' PRICE:[PRICE_' || price_bucket || ']', '') else '' end || coalesce(' NAME_EMB:[' || name || ']', '')
    when event_type = 'page_visit' and url <> '' then ' URL:[URL_' || url || ']' when event_type = 'search_query' and query <> '' then ' QUERY_EMB:[' || case when query like '[%]' then replace(trim(query, '[]'), ',', ' ') else 'InvalidFormat' end || ']' else '' end
  || ' POP_Q:[' || popularity || '] AGE:[' || age || '] TOD:[' || tod || '] DOW:[' || dow || '] TIME_DELTA:[' || delta || ']' as line from tk),
rx as (select client_id, session_id, '<SESS_START></s>' || string_agg(line, '</s>' order by event_id) || '</s><SESS_END>' as part from re group by all),
raw as (select client_id, string_agg(part, '</s>' order by session_id) as raw_sequence from rx group by 1)"""


def raw_sql(k: int = 100) -> str:
    return RAW.replace("{k}", str(k))


def raw_tokens(spark, sf_dir, k: int = 100):
    """Tokens with names and popularity, over events with pages."""
    from profilis.plans.rendering_queries import named_skus

    e = client_events(spark, sf_dir)
    quantiles = price.popularity_quantiles(price.popularity(e, "sku"), "sku")
    return sequence.raw_sequence(with_urls(e, spark.read.parquet(f"{sf_dir}/pages.parquet")), k=k, names=named_skus(spark, sf_dir), quantiles=quantiles)


@query("raw_sequence_tokens", raw_sql() + " select * from tk")
def raw_sequence_tokens(spark, sf_dir):
    return raw_tokens(spark, sf_dir)


@query("raw_sequence_text", raw_sql(40) + RAW_TEXT + " select * from raw")
def raw_sequence_text(spark, sf_dir):
    """Of the last 40 events, so that some are cut in the small tables too."""
    return sequence.raw_sequence_text(raw_tokens(spark, sf_dir, 40))


# -- pairs -----------------------------------------------------------------------------
def _pairs(item: str, kinds: str, gap: int, cap: int = 20, source: str = "x") -> str:
    return f""", e as (select client_id, timestamp, event_id, {item} as item from {source} where event_type in ({kinds}) and {item} is not null), {sessions_sql('e', gap)},
d as (select *, row_number() over (partition by client_id, session_id order by item) as r from (select distinct client_id, session_id, item from s)),
q as (select a.client_id, a.session_id, a.item as i, b.item as j from d a join d b on a.client_id = b.client_id and a.session_id = b.session_id and a.item < b.item where a.r <= {cap} and b.r <= {cap})"""


CART_BUY = ("add_to_cart", "product_buy")
CART_BUY_SQL = "'add_to_cart', 'product_buy'"
TOP_PAIRS = """, n as (select client_id, i, j, count(*) as n from q group by all)
select *, cast(row_number() over (partition by client_id order by n desc, i, j) as integer) as rank from n qualify row_number() over (partition by client_id order by n desc, i, j) <= 5"""


@query("co_pairs_sku", X + _pairs("sku", CART_BUY_SQL, DAY) + TOP_PAIRS)
def co_pairs_sku(spark, sf_dir):
    return pairs.top_co_pairs(pairs.session_pairs(client_events(spark, sf_dir), "sku", DAY, CART_BUY))


@query("co_pairs_category", X + _pairs("category_id", "'page_visit', 'product_buy'", DAY) + TOP_PAIRS)
def co_pairs_category(spark, sf_dir):
    return pairs.top_co_pairs(pairs.session_pairs(client_events(spark, sf_dir), "category_id", DAY, ("page_visit", "product_buy")))


GLOBAL = X + f", pop as (select sku, count(*) as c from x where event_type in ({CART_BUY_SQL}) and sku is not null group by 1 order by c desc, sku limit 5000), y as (select x.* from x semi join pop on x.sku = pop.sku)" + _pairs("sku", CART_BUY_SQL, DAY, 20, "y") + ", gp as (select i, j, count(*) as n from q group by all order by n desc, i, j limit 30)"


def _global_pairs(spark, sf_dir):
    return pairs.global_co_pairs(client_events(spark, sf_dir), "sku", DAY, CART_BUY, top_items=5000, k=30)


@query("global_co_pairs", GLOBAL + " select * from gp")
def global_co_pairs(spark, sf_dir):
    return _global_pairs(spark, sf_dir)


GLOBAL_CATEGORIES = X + f", pop as (select category_id, count(*) as c from x where event_type in ({CART_BUY_SQL}) and category_id is not null group by 1 order by c desc, category_id limit 500), y as (select x.* from x semi join pop on x.category_id = pop.category_id)" + _pairs("category_id", CART_BUY_SQL, DAY, 10, "y")


@query("global_co_pairs_category", GLOBAL_CATEGORIES + " select i, j, count(*) as n from q group by all order by n desc, i, j limit 30")
def global_co_pairs_category(spark, sf_dir):
    return pairs.global_co_pairs(client_events(spark, sf_dir), "category_id", DAY, CART_BUY, top_items=500, k=30, cap=10)


SAMPLE = "cast('0x' || substr(md5(client_id || ':42'), 1, 13) as bigint) % 10 = 0"


@query("sampled_clients", X + f", c as (select distinct client_id from x) select client_id from c where {SAMPLE}")
def sampled_clients(spark, sf_dir):
    """A tenth of the clients, the same in every run."""
    return dataset.sampled(client_events(spark, sf_dir).select("client_id").distinct(), "client_id", 10)


@query("global_co_pairs_sampled", X + f", pop as (select sku, count(*) as c from x where event_type in ({CART_BUY_SQL}) and sku is not null group by 1 order by c desc, sku limit 5000), y as (select x.* from x semi join pop on x.sku = pop.sku where {SAMPLE})" + _pairs("sku", CART_BUY_SQL, DAY, 20, "y") + " select i, j, count(*) as n from q group by all order by n desc, i, j limit 30")
def global_co_pairs_sampled(spark, sf_dir):
    """Global pairs over a tenth of the clients; popularity is that of all."""
    return pairs.global_co_pairs(client_events(spark, sf_dir), "sku", DAY, CART_BUY, top_items=5000, k=30, clients=sampled_clients(spark, sf_dir))


@query("client_global_pairs", GLOBAL + ", t as (select distinct client_id, sku from x where sku is not null) select a.client_id, gp.i, gp.j, gp.n from gp join t a on a.sku = gp.i join t b on b.sku = gp.j and b.client_id = a.client_id")
def client_global_pairs(spark, sf_dir):
    return pairs.client_global_pairs(client_events(spark, sf_dir), _global_pairs(spark, sf_dir), "sku")


@query("sku_graph_stats", X + _pairs("sku", CART_BUY_SQL, 7 * DAY) + """, g as (select distinct client_id, i, j from q), n as (select client_id, i as node from g union all select client_id, j from g), dg as (select client_id, node, count(*) as degree from n group by all),
t as (select *, row_number() over (partition by client_id order by degree desc, node) as r from dg),
p as (select client_id, count(*) as nodes, cast(sum(degree) / 2 as bigint) as edges, max(degree) as top_degree, max(case when r = 1 then node end) as top_node from t group by 1)
select client_id, nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 6) as density, case when 2 * edges / (nodes * (nodes - 1)) > 0.5 then 'dense' when 2 * edges / (nodes * (nodes - 1)) < 0.1 then 'sparse' end as tag, top_node, top_degree from p where nodes >= 2""")
def sku_graph_stats(spark, sf_dir):
    return pairs.pair_graph_stats(pairs.session_pairs(client_events(spark, sf_dir), "sku", 7 * DAY, CART_BUY))


# -- conversion ------------------------------------------------------------------------
ASOF = """, b as (select distinct client_id, sku, timestamp from x where event_type = 'product_buy' and sku is not null),
m as (select b.client_id, b.sku, b.timestamp, max(c.timestamp) as cart from b join x c on c.client_id = b.client_id and c.sku = b.sku and c.event_type = 'add_to_cart' and c.timestamp < b.timestamp group by all),
r as (select client_id, sku, epoch_us(timestamp) as buy_us, epoch_us(cart) as cart_us, round((epoch_us(timestamp) - epoch_us(cart)) / 60000000.0, 6) as minutes from m)"""


@query("cart_to_purchase_asof", X + ASOF + " select * from r")
def cart_to_purchase_asof(spark, sf_dir):
    return pairs.last_cart_before(client_events(spark, sf_dir))


@query("cart_to_purchase_stats", X + ASOF + " select count(*) as n, round(avg(minutes), 6) as mean_minutes, round(quantile_cont(minutes, 0.5), 6) as median_minutes from r")
def cart_to_purchase_stats(spark, sf_dir):
    return pairs.cart_to_purchase(client_events(spark, sf_dir))


@query("cart_conversion", X + """, a as (select * from x where event_type = 'add_to_cart' and sku is not null), b as (select * from x where event_type = 'product_buy' and sku is not null),
r as (select client_id, count(*) as carts, count(*) filter (exists (select 1 from b where b.client_id = a.client_id and b.sku = a.sku)) as converted from a group by 1),
d as (select a.client_id, count(*) as pairs, sum(epoch_us(b.timestamp) - epoch_us(a.timestamp)) / 60000000.0 / count(*) as m from a join b on a.client_id = b.client_id and a.sku = b.sku and a.timestamp < b.timestamp group by 1)
select r.client_id, carts, converted, round(converted / carts, 6) as conversion_rate, coalesce(pairs, 0) as pairs, round(m, 6) as mean_minutes from r left join d on r.client_id = d.client_id""")
def cart_conversion(spark, sf_dir):
    return pairs.cart_conversion(client_events(spark, sf_dir))


# -- propensity --------------------------------------------------------------------------
def _scores(item: str, k: int, columns: str, weight: str = "1", source: str = "x") -> str:
    return f""", g as (select client_id, {item}, round(sum(pow((epoch_us({NOW}) - epoch_us(timestamp)) / 86400000000.0 + 1, -0.5) * {weight}), 6) as score, count(*) as n, {days(NOW, 'max(timestamp)')} as days_since from {source} where {item} is not null group by 1, 2),
r as (select *, cast(row_number() over (partition by client_id order by score desc, {item}) as integer) as rank from g) select {columns} from r where rank <= {k}"""


WEIGHT = "case event_type when 'page_visit' then 1 when 'add_to_cart' then 3 when 'product_buy' then 5 when 'remove_from_cart' then -2 else 1 end"


@query("category_propensity", X + _scores("category_id", 5, "client_id, category_id, score, rank"))
def category_propensity(spark, sf_dir):
    return propensity.category_propensity(client_events(spark, sf_dir))


@query("top_sku_scores", X + _scores("sku", 5, "*"))
def top_sku_scores(spark, sf_dir):
    return propensity.top_scores(client_events(spark, sf_dir), "sku")


@query("top_category_scores", X + _scores("category_id", 5, "*"))
def top_category_scores(spark, sf_dir):
    return propensity.top_scores(client_events(spark, sf_dir), "category_id")


@query("sku_propensity", X + _scores("sku", 10, "*", WEIGHT))
def sku_propensity(spark, sf_dir):
    return propensity.top_scores(client_events(spark, sf_dir), "sku", 10, weighted=True)


@query("sku_coverage", X + "select client_id, count(distinct sku) as seen, round(count(distinct sku) / 20, 6) as coverage from x where sku < 20 group by 1")
def sku_coverage(spark, sf_dir):
    return propensity.coverage(client_events(spark, sf_dir), "sku", spark.range(20).withColumnRenamed("id", "sku"))


ORDERS = "with x as (select o_custkey as client_id, o_orderdate as timestamp, l_partkey as sku, 'product_buy' as event_type from orders join lineitem on l_orderkey = o_orderkey)"


@query("orders_as_events", ORDERS + _scores("sku", 3, "*").replace(NOW, "timestamp '2030-01-01 00:00:00'"))
def orders_as_events(spark, sf_dir):
    from datetime import datetime

    from profilis.conf import EngineConf

    return propensity.top_scores(order_events(spark, sf_dir), "sku", 3, EngineConf(as_of=datetime(2030, 1, 1)))


@query("category_breadth", X + """, c as (select client_id, category_id, count(*) filter (event_type = 'product_buy') as b from x where category_id is not null group by all), r as (select *, row_number() over (partition by client_id order by b desc, category_id) as r from c)
select client_id, count(*) as breadth, case when sum(b) > 0 then max(case when r = 1 then category_id end) end as focus_category, case when sum(b) > 0 then round(max(b) / sum(b), 6) end as focus_share from r group by 1""")
def category_breadth(spark, sf_dir):
    return propensity.category_breadth(client_events(spark, sf_dir))


@query("repeat_purchase", X + """, b as (select client_id, sku, count(*) as n from x where event_type = 'product_buy' and sku is not null group by all having count(*) > 1), r as (select *, row_number() over (partition by client_id order by n desc, sku) as r from b)
select client_id, count(*) as repeat_skus, max(case when r = 1 then sku end) as top_sku, max(n) as top_n from r group by 1""")
def repeat_purchase(spark, sf_dir):
    return propensity.repeat_purchase(client_events(spark, sf_dir))


@query("brand_affinity", X + ", b as (select client_id, brand, count(distinct sku) as n from x where brand is not null group by all) select * from b qualify row_number() over (partition by client_id order by n desc, brand) = 1")
def brand_affinity(spark, sf_dir):
    return propensity.brand_affinity(client_events(spark, sf_dir))


@query("churn_signals", X + f""", b as (select *, {days('timestamp', 'lag(timestamp) over w')} as i from x where event_type = 'product_buy' {W}),
p as (select client_id, count(*) as n_buys, {days(NOW, 'max(timestamp)')} as buy_recency, avg(i) as m, cast(sum(price_bucket) as bigint) as ltv from b group by 1)
select c.client_id, n_buys, buy_recency, case when buy_recency is null then 'no_purchase' when buy_recency >= 14 then 'high' else 'low' end as risk, round(m, 6) as mean_interval,
  case when buy_recency is not null then coalesce(m > 0 and buy_recency > 2 * m, false) end as unusual_gap, ltv from (select distinct client_id from x) c left join p on p.client_id = c.client_id""")
def churn_signals(spark, sf_dir):
    return propensity.churn_signals(client_events(spark, sf_dir))


@query("post_purchase", X + """, l as (select *, max(timestamp) filter (event_type = 'product_buy') over (partition by client_id) as last from x),
p as (select client_id, count(*) filter (timestamp > last) as n_after, count(*) filter (timestamp > last and event_type = 'add_to_cart') as c, count(*) filter (timestamp > last and event_type = 'page_visit') as v from l where last is not null group by 1)
select client_id, n_after, case when c > 0 then 'cart_activity' when v > 0 then 'browsing' when n_after > 0 then 'other' else 'no_activity' end as tag from p""")
def post_purchase(spark, sf_dir):
    return propensity.post_purchase(client_events(spark, sf_dir))


# -- price and popularity -----------------------------------------------------------------
@query("price_stats", X + """, p as (select client_id, count(price_bucket) as n, min(price_bucket) as lo, max(price_bucket) as hi, avg(price_bucket) as m, stddev_samp(price_bucket) as s,
  case when avg(price_bucket) filter (event_type = 'product_buy') > 0 then stddev_samp(price_bucket) filter (event_type = 'product_buy') / avg(price_bucket) filter (event_type = 'product_buy') end as cv from x group by 1)
select client_id, n, lo as min_price, hi as max_price, round(m, 6) as mean_price, round(s, 6) as std_price, round(cv, 6) as buy_cv, case when hi - lo > 30 then 'wide' when hi - lo < 10 then 'narrow' end as width_tag,
  case when cv < 0.15 then 'consistent' when cv > 0.4 then 'varied' end as cv_tag from p where n > 0""")
def price_stats(spark, sf_dir):
    return price.price_stats(client_events(spark, sf_dir))


@query("price_sensitivity", X + """, b as (select distinct client_id, sku from x where event_type = 'product_buy' and price_bucket is not null),
p as (select x.client_id, avg(price_bucket) filter (event_type = 'product_buy') as bought, avg(price_bucket) filter (event_type = 'add_to_cart') as added,
  avg(price_bucket) filter (event_type = 'add_to_cart' and b.sku is null) as abandoned from x left join b on b.client_id = x.client_id and b.sku = x.sku where price_bucket is not null group by 1)
select client_id, round(bought / added, 6) as ratio, case when bought / added < 0.8 then 'high' when bought / added > 1.2 then 'low' else 'moderate' end as sensitivity, coalesce(abandoned > 1.2 * bought, false) as abandons_dearer
from p where bought is not null and added is not null""")
def price_sensitivity(spark, sf_dir):
    return price.price_sensitivity(client_events(spark, sf_dir))


@query("price_segments", X + """, p as (select client_id, coalesce(avg(price_bucket) filter (event_type = 'product_buy'), 0) as b, coalesce(avg(price_bucket) filter (event_type = 'add_to_cart'), 0) as a from x group by 1),
r as (select client_id, b / a as ratio from p where a > 0), e as (select quantile_cont(ratio, 0.33) as lo, quantile_cont(ratio, 0.66) as hi, count(*) as n from r)
select client_id, round(ratio, 6) as ratio, case when ratio <= lo then 'price_sensitive' when ratio >= hi then 'premium' else 'balanced' end as segment from r, e where n > 10""")
def price_segments(spark, sf_dir):
    return price.price_segments(client_events(spark, sf_dir))


@query("rfm", X + f"select client_id, {days(NOW, 'max(timestamp)')} as recency, count(*) filter (epoch_us({NOW}) - epoch_us(timestamp) <= 90 * 86400000000) as frequency, round(avg(price_bucket), 6) as monetary from x where event_type = 'product_buy' group by 1")
def rfm(spark, sf_dir):
    return price.rfm(client_events(spark, sf_dir))


def _popularity(item: str, name: str = "pop") -> str:
    return f""", {name}c as (select {item}, count(*) filter (event_type = 'page_visit') as views, count(*) filter (event_type = 'add_to_cart') as carts, count(*) filter (event_type = 'product_buy') as buys from x where {item} is not null group by 1),
{name} as (select *, case when carts > 0 and views > 0 then round(carts / views, 6) else 0.0 end as view_to_cart, case when carts > 0 then round(buys / carts, 6) else 0.0 end as cart_to_buy, case when views > 0 then round(buys / views, 6) else 0.0 end as view_to_buy,
  case when (select sum(views) from {name}c) > 0 then views + 3 * carts + 10 * buys else 2 * carts + 10 * buys end as score from {name}c)"""


@query("product_popularity", X + _popularity("sku") + " select * from pop")
def product_popularity(spark, sf_dir):
    return price.popularity(client_events(spark, sf_dir), "sku")


@query("category_popularity", X + _popularity("category_id") + " select * from pop")
def category_popularity(spark, sf_dir):
    return price.popularity(client_events(spark, sf_dir), "category_id")


@query("popularity_quantiles", X + _popularity("sku") + """, q as (select quantile_cont(score, 0.25) as a, quantile_cont(score, 0.5) as b, quantile_cont(score, 0.75) as c from pop)
select sku, score, case when score <= a then 'Q1' when score <= b then 'Q2' when score <= c then 'Q3' else 'Q4' end as quantile from pop, q""")
def popularity_quantiles(spark, sf_dir):
    return price.popularity_quantiles(price.popularity(client_events(spark, sf_dir), "sku"), "sku")


def _affinity(item: str) -> str:
    return X + _popularity(item) + f""", o as (select avg(score) as o from pop), d as (select distinct client_id, {item} from x where {item} is not null), j as (select d.*, pop.score from d join pop on pop.{item} = d.{item}),
r as (select *, row_number() over (partition by client_id order by score desc, {item}) as r from j), p as (select client_id, count(*) as n_items, avg(score) as m, max(case when r = 1 then {item} end) as top_item from r group by 1)
select client_id, n_items, round(m, 6) as mean_score, round(m / o, 6) as ratio, round(m - o, 6) as delta, case when m / o > 1.3 then 'popular' when m / o < 0.7 then 'niche' else 'average' end as affinity, top_item from p, o"""


@query("popularity_affinity", _affinity("sku"))
def popularity_affinity(spark, sf_dir):
    e = client_events(spark, sf_dir)
    return price.popularity_affinity(e, price.popularity(e, "sku"), "sku")


@query("category_affinity", _affinity("category_id"))
def category_affinity(spark, sf_dir):
    e = client_events(spark, sf_dir)
    return price.popularity_affinity(e, price.popularity(e, "category_id"), "category_id")


@query("cart_vs_view_popularity", X + _popularity("sku") + """, d as (select distinct client_id, event_type, sku from x where sku is not null and event_type in ('page_visit', 'add_to_cart')),
p as (select client_id, avg(score) filter (event_type = 'add_to_cart') as c, avg(score) filter (event_type = 'page_visit') as v from d join pop on pop.sku = d.sku group by 1)
select client_id, round(c / v, 6) as ratio, case when c / v > 1.2 then 'more_popular' when c / v < 0.8 then 'less_popular' else 'alike' end as tag from p where c is not null and v > 0""")
def cart_vs_view_popularity(spark, sf_dir):
    e = client_events(spark, sf_dir)
    return price.cart_vs_view_popularity(e, price.popularity(e, "sku"))


VISITS = ", v as (select * from x where event_type = 'page_visit'), " + sessions_sql("v")
CATEGORIES = ", c as (select client_id, category_id, count(*) as n from {0} where category_id is not null group by all), k as (select client_id, max(n) / sum(n) as top, count(*) as n_categories from c group by 1)"


@query("browse_focus", X + VISITS + CATEGORIES.format("v") + """, t as (select client_id, session_id, count(*) as n from s group by all), p as (select client_id, avg(n) as pages from t group by 1)
select p.client_id, round(pages, 6) as pages_per_session, case when pages > 15 then 'intensive' when pages < 3 then 'shallow' end as depth, round(top, 6) as top_share, n_categories, case when top > 0.75 then 'focus' when top < 0.4 and n_categories >= 3 then 'explorer' end as focus
from p join k on k.client_id = p.client_id""")
def browse_focus(spark, sf_dir):
    return price.browse_focus(client_events(spark, sf_dir), 1800)


@query("category_entropy", X + CATEGORIES.format("x") + ", h as (select client_id, n / sum(n) over (partition by client_id) as p from c) select client_id, round(-sum(p * log2(p)), 6) + 0.0 as entropy from h group by 1")
def category_entropy(spark, sf_dir):
    return price.category_entropy(client_events(spark, sf_dir))


@query("category_loyalty_segments", X + CATEGORIES.format("x") + "select client_id, round(top, 6) as loyalty, n_categories, case when top >= 0.75 then 'loyal' when top <= 0.4 and n_categories >= 3 then 'explorer' else 'moderate' end as segment from k")
def category_loyalty_segments(spark, sf_dir):
    return price.category_loyalty(client_events(spark, sf_dir))


@query("top_category", X + CATEGORIES.format("x") + "select client_id, category_id, n from c qualify row_number() over (partition by client_id order by n desc, category_id) = 1")
def top_category(spark, sf_dir):
    return price.top_category(client_events(spark, sf_dir))


SEGMENTS = f""", p as (select client_id, count(*) filter (event_type = 'product_buy') as b, count(*) as n, {days(NOW, 'max(timestamp)')} as idle from x group by 1), m as (select quantile_cont(n, 0.5) as m from p),
g as (select client_id, unnest([case when b > 0 then 'buyers' else 'non_buyers' end, case when idle <= 30 then 'active_absolute' else 'inactive_absolute' end, case when n >= m then 'active_relative' else 'inactive_relative' end,
  case when b = 1 then 'one_time_buyers' when b between 2 and 5 then 'occasional_buyers' when b > 5 then 'frequent_buyers' end]) as segment from p, m)"""


@query("user_segments", X + SEGMENTS + "select client_id, segment from g where segment is not null")
def user_segments(spark, sf_dir):
    return price.user_segments(client_events(spark, sf_dir))


@query("client_segments", X + SEGMENTS + "select client_id, string_agg(distinct segment, ',' order by segment) as segments from g where segment is not null group by 1")
def client_segments(spark, sf_dir):
    return price.segments_of(price.user_segments(client_events(spark, sf_dir)))
