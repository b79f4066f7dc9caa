"""Queries on the lines, texts and records of profiles, with SQL written from their definition."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from profilis.conf import EngineConf
from profilis.functions import text as tx
from profilis.operators import dataset, extractors, graph, pairs, price, rendering, segments, sequence, vectors
from profilis.plans.behaviour_queries import RAW_TEXT, raw_sql, raw_tokens
from profilis.plans.registry import NOW, X, days, query, sessions_sql
from profilis.sources.events import client_events, with_urls

DAY = 86400
#: The usual session gap, and a wide one under which sessions of the test tables hold many events.
USUAL, WIDE = 1800, 3 * DAY
#: Numbers in a product's name.
NAME = 36

# -- inputs ----------------------------------------------------------------------------------
XU = X + f""", n0 as (select count(*) as n from pages), xu as (select x.*, url from x cross join n0 left join pages on event_type = 'page_visit' and page_id = k % n0.n),
nm as (select vec_id as sku, list_transform(embedding[1:{NAME}], lambda q: floor(256 * cast(q as double))) as name from embeddings),
ue as (select url, list_transform(embedding, lambda q: cast(q as double)) as v from pages join embeddings on vec_id = page_id),
uc as (select i, avg(c) as m from (select unnest(v) as c, generate_subscripts(v, 1) as i from ue) group by 1),
us as (select url, sum(c * m) as similarity from (select url, unnest(v) as c, generate_subscripts(v, 1) as i from ue) join uc using (i) group by 1)"""


def named_skus(spark, sf_dir):
    """Products' names: numbers that stand for their vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("sku"), F.transform(F.slice("embedding", 1, NAME), lambda q: F.floor(q.cast("double") * 256).cast("double")).alias("name"))


def url_similarities(spark, sf_dir):
    """Each page's similarity to the centre of all pages; vectors of pages are those of the same number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("vec_id"), "url")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vectors.similarity_to_centre(pages.join(v, "vec_id"), "url", "v")


def profile_inputs(spark, sf_dir, gap: int = USUAL, pair_items: int | None = 20):
    """Events with pages, the derived tables, and the settings.

    Every part of a profile reads the events: they are joined and dealt by client once, so that
    parts exchange what they have counted and not the events.
    """
    conf = EngineConf(session_gap_s=gap, pair_items=pair_items)
    events = with_urls(client_events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("k")
    events = graph.dealt(events, "client_id")
    clusters = events.where("sku < 90").select("sku").distinct().withColumn("cluster", (F.col("sku") % 7).cast("int"))
    ranks = graph.pagerank(sequence.category_transitions(events), digits=12).withColumnRenamed("node", "category_id")
    central = graph.pagerank(pairs.central_edges(events, price.popularity(events, "sku"), gap), digits=12).withColumnRenamed("node", "sku")
    tables = rendering.derived_tables(
        events, top_skus=spark.range(20).withColumnRenamed("id", "sku"), top_categories=spark.range(1, 11).withColumnRenamed("id", "category_id"), names=named_skus(spark, sf_dir),
        clusters=clusters, urls=url_similarities(spark, sf_dir), sku_rank=central, category_rank=ranks,
    )
    return events, tables, conf


def profiles(spark, sf_dir, gap: int = USUAL, keep: tuple[str, ...] = ()):
    events, tables, conf = profile_inputs(spark, sf_dir, gap)
    return rendering.profile_lines(rendering.client_facts(events, tables, conf), tables, conf, keep)


def whole_profiles(spark, sf_dir, gap: int = WIDE):
    """Profiles in whose pairs all items of a session take part."""
    events, tables, conf = profile_inputs(spark, sf_dir, gap, pair_items=None)
    return rendering.profile_lines(rendering.client_facts(events, tables, conf), tables, conf)


# -- SQL of the facts --------------------------------------------------------------------------
W = "(partition by client_id order by timestamp, event_id)"
SHOP = "event_type in ('page_visit', 'add_to_cart', 'product_buy')"
WEIGHT = f"pow(floor((epoch_us({NOW}) - epoch_us(timestamp)) / 1000000.0) / 86400.0 + 1, -0.5)"
EVENT = "case event_type when 'page_visit' then 1.0 when 'add_to_cart' then 3.0 when 'product_buy' then 5.0 when 'remove_from_cart' then -2.0 else 1.0 end"


def fx(x: str, d: int, sign: str = "") -> str:
    return f"printf('%{sign}.{d}f', cast({x} as double))"


def short(x: str, d: int) -> str:
    return rf"regexp_replace({fx(x, d)}, '(\.\d+?)0+$', '\1')"


def kind(name: str) -> str:
    return f"filter (event_type = '{name}')"


def rank_sql(name: str, edges: str, rounds: int, key: str = "") -> str:
    """PageRank of a table of edges (src, dst, w) as a table ``name`` (node, rank); key: of each client."""
    k, on = (f"{key}, ", f"and {{0}}.{key} = {{1}}.{key}") if key else ("", "")
    out = f""", {name}l as (select {k}src, dst, w / sum(w) over (partition by {k}src) as p from {edges}), {name}n as (select {k}src as node from {edges} union select {k}dst from {edges}),
{name}s as (select *, count(*) over ({f'partition by {key}' if key else ''}) as n from {name}n), {name}0 as (select {k}node, 1.0 / n as rank from {name}s)"""
    for i in range(rounds):
        out += f""", {name}{i + 1} as materialized (select {', '.join(f's.{c}' for c in ([key] if key else []) + ['node'])}, 0.15 / n + 0.85 * coalesce(got, 0) as rank from {name}s s left join
(select {f'l.{key}, ' if key else ''}dst, sum(rank * p) as got from {name}l l join {name}{i} r on r.node = l.src {on.format('r', 'l')} group by all) g on g.dst = s.node {on.format('g', 's')})"""
    return out + f", {name} as (select * from {name}{rounds})"


def pairs_sql(name: str, source: str, item: str, where: str, gap: int, top: str = "", capped: bool = True) -> str:
    """Pairs i < j of sessions' items, of which the least 20 take part if they are capped."""
    least = " where a.r <= 20 and b.r <= 20" if capped else ""
    return f""", {name}e as (select client_id, timestamp, event_id, {item} as item from {source} where {where} and {item} is not null), {sessions_sql(f'{name}e', gap, f'{name}z')},
{name}d as (select *, row_number() over (partition by client_id, session_id order by item) as r from (select distinct client_id, session_id, item from {name}z {top})),
{name} as (select a.client_id, a.session_id, a.item as i, b.item as j from {name}d a join {name}d b on a.client_id = b.client_id and a.session_id = b.session_id and a.item < b.item{least})"""


def popularity_sql(name: str, item: str) -> str:
    return f""", {name}c as (select {item}, count(*) {kind('page_visit')} as v, count(*) {kind('add_to_cart')} as a, count(*) {kind('product_buy')} as b from xu where {item} is not null group by 1),
{name} as (select {item}, cast(case when sum(v) over () > 0 then v + 3 * a + 10 * b else 2 * a + 10 * b end as double) as score from {name}c)"""


def grams_sql(name: str, n: int, k: int) -> str:
    tail = " || ' -> ' || ".join(["event_type", *[f"lead(event_type, {i}) over w" for i in range(1, n)]])
    return f""", {name}g as (select client_id, {tail} as gram from xu window w as {W}), {name}c as (select client_id, gram, count(*) as c from {name}g where gram is not null group by all),
{name} as (select *, row_number() over (partition by client_id order by c desc, gram) as r, c / sum(c) over (partition by client_id) * 100.0 as share from {name}c qualify r <= {k})"""


def facts_sql(gap: int, capped: bool = True) -> str:
    age = f"epoch_us({NOW}) - epoch_us(timestamp)"
    us = 86_400_000_000
    out = XU + popularity_sql("ps", "sku") + popularity_sql("pc", "category_id")
    out += f""", t as (select client_id, count(*) as n, count(*) {kind('page_visit')} as views, count(*) {kind('search_query')} as searches, count(*) {kind('add_to_cart')} as adds, count(*) {kind('product_buy')} as buys,
  min(timestamp) as first, max(timestamp) as last, max(timestamp) {kind('product_buy')} as last_buy, max(timestamp) {kind('add_to_cart')} as last_add,
  count(*) filter ({age} <= {30 * us}) as n30, count(distinct cast(timestamp as date)) filter ({age} <= {30 * us}) as days30, min(timestamp) filter ({age} <= {30 * us}) as first30, count(*) filter ({age} <= {14 * us}) as n14,
  count(price_bucket) as priced, count(price_bucket) filter ({SHOP}) as n_range, min(price_bucket) filter ({SHOP}) as low, max(price_bucket) filter ({SHOP}) as high, avg(price_bucket) filter ({SHOP}) as middle,
  count(price_bucket) {kind('product_buy')} as n_paid, avg(price_bucket) {kind('product_buy')} as paid, stddev_samp(price_bucket) {kind('product_buy')} as paid_std, cast(coalesce(sum(price_bucket) {kind('product_buy')}, 0) as bigint) as ltv,
  avg(price_bucket) {kind('add_to_cart')} as added, max(timestamp) filter (event_type = 'product_buy' and price_bucket is not null) as last_paid,
  count(*) filter (event_type = 'product_buy' and price_bucket is not null and {age} <= {90 * us}) as freq90,
  avg(sin(2 * pi() * hour(timestamp) / 24)) as c0, avg(cos(2 * pi() * hour(timestamp) / 24)) as c1, avg(sin(2 * pi() * isodow(timestamp) / 7)) as c2, avg(cos(2 * pi() * isodow(timestamp) / 7)) as c3,
  1 - sqrt(pow(avg(cos(2 * pi() * hour(timestamp) / 24)), 2) + pow(avg(sin(2 * pi() * hour(timestamp) / 24)), 2)) as tod from xu group by 1),
h as (select client_id, hour(timestamp) as h, count(*) as c from xu group by all), hp as (select * from h qualify c >= 0.8 * max(c) over (partition by client_id)),
hl as (select client_id, string_agg(h || ':00', ', ' order by h) as peaks, count(*) filter (h >= 5 and h < 12) as pm, count(*) filter (h >= 12 and h < 18) as pa, count(*) filter (h >= 18 or h < 5) as pe from hp group by 1),
hb as (select client_id, (sum(c * c) / 24 - pow(sum(c) / 24, 2)) / (sum(c) / 24) as burst from h group by 1),
wd as (select client_id, isodow(timestamp) as d, count(*) as c from xu group by all), wp as (select * from wd qualify c >= 0.8 * max(c) over (partition by client_id)),
wl as (select client_id, string_agg(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d], ', ' order by d) as active, bool_or(d <= 5) as week, bool_or(d > 5) as wend from wp group by 1),
we as (select client_id, -sum(p * log2(p)) as dow from (select client_id, c / sum(c) over (partition by client_id) as p from wd) group by 1),
{sessions_sql('xu', gap)}, ss as (select client_id, session_id, count(*) as c, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0) as sec, hour(min(timestamp)) as h from s group by all),
sa as (select client_id, count(*) as sessions, sum(cast(h >= 18 or h < 5 as int)) / count(*) as night, avg(sec / 60.0) as minutes, avg(c) as per_session from ss group by 1),
gp as (select client_id, (epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1000000.0 / 86400.0 as g from xu window w as {W}), ga as (select client_id, max(g) as gap, count(*) filter (g > 7) as gaps7, count(*) filter (g > 30) as gaps30 from gp group by 1),
bi as (select client_id, {days('timestamp', 'lag(timestamp) over w')} as i from xu where event_type = 'product_buy' window w as {W}), ba as (select client_id, avg(i) as interval_mean from bi group by 1),
af as (select x.client_id, count(*) as n_after, count(*) {kind('page_visit')} as views_after, count(*) {kind('add_to_cart')} as adds_after from xu x join t on t.client_id = x.client_id and timestamp > last_buy group by 1),
qq as (select client_id, query, count(*) as c from xu where event_type = 'search_query' and query is not null group by all),
qa as (select client_id, cast(sum(c) as bigint) as queried, count(*) as queries, max(c) as top_query_n, first(query order by c desc, query) as top_query from qq group by 1)"""
    out += grams_sql("g3", 3, 2) + grams_sql("g4", 4, 1)
    out += f""", pp as (select client_id, count(*) as ping_pong from (select client_id, event_type as a, lead(event_type, 1) over w as b, lead(event_type, 2) over w as c, lead(event_type, 3) over w as d from xu window w as {W}) where a = c and b = d and a <> b group by 1),
bv as (select client_id, timestamp, event_id, category_id from xu where event_type = 'page_visit' and category_id is not null), {sessions_sql('bv', gap, 'bz')},
bf as (select client_id, session_id, category_id, min((timestamp, event_id)) as seen from bz group by all), bt as (select client_id, category_id as a, lead(category_id, 1) over q as b, lead(category_id, 2) over q as c from bf window q as (partition by client_id, session_id order by seen)),
bn as (select client_id, a, b, c, count(*) as n from bt where c is not null group by 1, 2, 3, 4 qualify row_number() over (partition by client_id order by n desc, a, b, c) = 1),
ct as (select lag(category_id) over w as src, category_id as dst from xu where event_type in ('page_visit', 'product_buy') and category_id is not null window w as {W}), ce as (select src, dst, count(*) as w from ct where src <> dst group by all)"""
    out += rank_sql("cr", "ce", 10)
    out += """, top2k as (select sku from ps where score > 0 or (select count(*) from ps where score > 0) < 100 order by score desc, sku limit 2000)"""
    out += pairs_sql("kp", "(select xu.* from xu semi join top2k on top2k.sku = xu.sku)", "sku", "true", gap, capped=False)
    out += ", ke as (select i as src, j as dst, count(*) as w from kp group by all)" + rank_sql("kr", "ke", 10)
    out += f""", cg as (select client_id, category_id, count(*) as c, count(*) {kind('page_visit')} as v, count(*) {kind('product_buy')} as b from xu where category_id is not null group by all),
cj as (select cg.*, score, round(rank, 12) as rank, sum(c) over (partition by client_id) as all_c, sum(v) over (partition by client_id) as all_v from cg left join pc on pc.category_id = cg.category_id left join cr on cr.node = cg.category_id),
ca as (select client_id, count(*) as breadth, count(*) filter (v > 0) as viewed, max(v) as top_v, cast(max(all_v) as bigint) as all_v, max(b) as top_b, cast(sum(b) as bigint) as all_b, first(category_id order by b desc, category_id) as focus,
  first(category_id order by c desc, category_id) as favourite, first(rank order by c desc, category_id) as favourite_rank, sum(-(v / all_v) * log2(v / all_v)) filter (v > 0) as view_entropy, sum(-(c / all_c) * log2(c / all_c)) as entropy,
  avg(score) as cat_score, max(score) as best_score, first(category_id order by coalesce(score, -1) desc, category_id) as best_category, max(rank) as central_rank, first(category_id order by coalesce(rank, -1) desc, category_id) as central from cj group by 1),
ci as (select client_id, category_id, round(sum({WEIGHT}), 9) as s, row_number() over (partition by client_id order by round(sum({WEIGHT}), 9) desc, category_id) as r from xu where category_id is not null group by 1, 2),
kg as (select client_id, sku, count(*) as c, count(*) {kind('page_visit')} as v, count(*) {kind('add_to_cart')} as a, count(*) {kind('product_buy')} as b, max(brand) as brand, count(price_bucket) {kind('product_buy')} as paid,
  sum(price_bucket) {kind('add_to_cart')} as add_sum, count(price_bucket) {kind('add_to_cart')} as add_n from xu where sku is not null group by all),
kj as (select kg.*, score, round(rank, 12) as rank from kg left join ps on ps.sku = kg.sku left join kr on kr.node = kg.sku),
ka as (select client_id, count(*) as n_skus, count(*) filter (v > 0 or a > 0 or b > 0) as n_shopped, avg(score) filter (v > 0 or a > 0 or b > 0) as own_score, avg(score) filter (v > 0) as view_score, avg(score) filter (a > 0) as cart_score,
  count(*) filter (b > 1) as repeats, max(b) as top_repeat_n, first(sku order by b desc, sku) as top_repeat, sum(add_sum) filter (paid = 0) / sum(add_n) filter (paid = 0) as abandoned, sum(add_sum) filter (paid > 0) / sum(add_n) filter (paid > 0) as carted_and_paid,
  max(paid) as any_paid, first(rank order by b desc, sku) as bought_rank from kj group by 1),
ki as (select client_id, sku, round(sum({WEIGHT} * {EVENT}), 9) as s, row_number() over (partition by client_id order by round(sum({WEIGHT} * {EVENT}), 9) desc, sku) as r from xu where sku is not null group by 1, 2),
br as (select client_id, brand, count(*) as c from kg where brand is not null group by 1, 2 qualify row_number() over (partition by client_id order by count(*) desc, brand) = 1),
cl as (select client_id, case when sku < 90 then sku % 7 else -1 end as cluster, count(*) as c from xu where sku is not null group by all),
cs as (select *, c / sum(c) over (partition by client_id) as share, row_number() over (partition by client_id order by c desc, cluster) as r from cl qualify r <= 3),
pe as (select client_id, price_bucket, count(*) as c from xu where price_bucket > 0 group by all), pf as (select client_id, count(*) as n_prices, sum(-p * log2(p)) as price_entropy from (select client_id, c / sum(c) over (partition by client_id) as p from pe) group by 1),
rb as (select client_id, {days(NOW, 'max(timestamp)')} as d, {days(NOW, f"max(timestamp) {kind('product_buy')}")} as bd from xu group by 1),
rr as (select client_id, (select count(*) filter (q.bd <= a.d) / count(q.bd) from rb q) as recency_share, case when a.bd is not null then (select count(*) filter (q.bd <= a.bd) / count(q.bd) from rb q) end as buy_share from rb a),
na as (select client_id, i, avg(c) as m, stddev_pop(c) as sd, count(*) as n from (select client_id, unnest(name[1:32]) as c, generate_subscripts(name[1:32], 1) as i from (select distinct client_id, sku from xu where {SHOP} and sku is not null) join nm using (sku)) group by all),
nb as (select client_id, 'AVG_PRODUCT_NAME_EMBEDDING (Dim:' || count(*) || '): [' || string_agg({fx('m', 2)}, ', ' order by i) || '] (' || max(n) || ' items)' as name_line, avg(sd) as name_std, max(n) as n_names from na group by 1),
nc as (select client_id, stddev_pop(c) as name_spread from (select client_id, unnest(name) as c from xu join nm using (sku)) group by 1),
ul as (select client_id, avg(similarity) as url_similarity from xu join us using (url) group by 1),
vv as (select * from xu where event_type = 'page_visit' and category_id is not null qualify count(*) over (partition by client_id) >= 5),
vt as (select client_id, lag(category_id) over w as src, category_id as dst from vv window w as {W}), ve as (select client_id, src, dst, count(*) as w from vt where src <> dst group by all)"""
    out += rank_sql("vr", "ve", 20, "client_id")
    out += """, vb as (select client_id, count(*) as nodes, first(node order by round(round(rank, 12), 9) desc, node) as node, max(round(rank, 12)) as rank from vr group by 1),
vu as (select distinct client_id, least(src, dst) as a, greatest(src, dst) as b from ve), vd as (select client_id, node, count(*) as degree from (select client_id, a as node from vu union all select client_id, b from vu) group by all),
v3 as (select p.client_id, p.a as a, p.b as b, q.b as c from vu p join vu q on q.client_id = p.client_id and q.a = p.b join vu r on r.client_id = p.client_id and r.a = p.a and r.b = q.b),
v4 as (select client_id, node, count(*) as t from (select client_id, a as node from v3 union all select client_id, b from v3 union all select client_id, c from v3) group by all),
vc as (select vd.client_id, avg(round(case when degree > 1 then coalesce(t, 0) / (degree * (degree - 1) / 2) else 0 end, 12)) as clustering from vd left join v4 on v4.client_id = vd.client_id and v4.node = vd.node group by 1),
vm as (select * from ve where w >= 2 qualify row_number() over (partition by client_id order by w desc, src, dst) = 1)"""
    out += pairs_sql("gq", f"(select * from xu where {SHOP} and sku is not null qualify count(*) over (partition by client_id) >= 3)", "sku", "true", gap, "where item < 20", capped)
    out += """, gs as (select distinct client_id, i, j from gq), gd as (select client_id, node, count(*) as degree from (select client_id, i as node from gs union all select client_id, j from gs) group by all),
gz as (select client_id, count(*) as nodes, sum(degree) / 2 as edges, max(degree) as top_degree, first(node order by degree desc, node) as top_node from gd group by 1),
gx as (select *, round(2 * edges / (nodes * (nodes - 1)), 12) as density from gz where nodes >= 2)"""
    out += pairs_sql("p1", "xu", "sku", "event_type in ('add_to_cart', 'product_buy')", gap, capped=capped) + pairs_sql("p2", "xu", "category_id", "event_type in ('page_visit', 'product_buy')", gap, capped=capped)
    for p in ("p1", "p2"):
        out += f", {p}t as (select client_id, i, j, count(*) as n, row_number() over (partition by client_id order by count(*) desc, i, j) as r from {p} group by 1, 2, 3 having count(*) >= 2 qualify r <= 5)"
    out += f""", ad as (select * from xu where event_type = 'add_to_cart' and sku is not null), bu as (select * from xu where event_type = 'product_buy' and sku is not null),
cc as (select client_id, count(*) as carts, count(*) filter (exists (select 1 from bu where bu.client_id = ad.client_id and bu.sku = ad.sku)) as converted from ad group by 1),
cd as (select ad.client_id, round(sum(epoch_us(bu.timestamp) - epoch_us(ad.timestamp)) / 60000000.0 / count(*), 6) as mean_minutes from ad join bu on ad.client_id = bu.client_id and ad.sku = bu.sku and ad.timestamp < bu.timestamp group by 1)"""
    for item, top, name in (("sku", "sku < 20", "k5"), ("category_id", "category_id between 1 and 10", "c5")):
        out += f""", {name}a as (select client_id, {item}, round(sum({WEIGHT}), 9) as s, count(*) as c, {days(NOW, 'max(timestamp)')} as ago from xu where {SHOP} and {top} group by 1, 2),
{name} as (select *, row_number() over (partition by client_id order by s desc, {item}) as r, count(*) over (partition by client_id) as met from {name}a)"""
    out += f""", sg0 as (select client_id, count(*) {kind('product_buy')} as b, count(*) {kind('page_visit')} as v, max(timestamp) as last, coalesce(avg(price_bucket) {kind('add_to_cart')}, 0) as added, coalesce(avg(price_bucket) {kind('product_buy')}, 0) as paid from xu group by 1),
sgl as (select client_id, max(n) / sum(n) as loyalty, count(*) as n_cats from (select client_id, category_id, count(*) as n from xu where event_type = 'page_visit' and category_id is not null group by all) group by 1),
sg1 as (select sg0.*, case when added > 0 then paid / added end as ratio, coalesce(loyalty, 0) as loyalty, coalesce(n_cats, 0) as n_cats, max(last) over () as tip from sg0 left join sgl using (client_id)),
sg2 as (select quantile_cont(ratio, 0.33) as lo, quantile_cont(ratio, 0.66) as hi, count(ratio) as nr, max(n_cats) as any_cats from sg1),
sg3 as (select client_id, case when b > 0 then 'buyers' else 'browsers' end as who, b, v, ratio, loyalty, n_cats, lo, hi, nr, any_cats, v >= 5 and {days(NOW, 'last')} <= 30 as act, v >= 5 and {days('tip', 'last')} <= 30 as rel from sg1, sg2),
sg as (select client_id, list_sort(list_filter([case when b > 0 then 'buyers' else 'non_buyers' end, case when act then 'active_' || who || '_absolute' end, case when rel then 'active_' else 'inactive_' end || who || '_relative',
  case when b = 1 then 'one_time_buyers' when b between 2 and 5 then 'occasional_buyers' when b > 5 then 'frequent_buyers' end,
  case when nr > 10 and ratio < lo then 'price_sensitive' when nr > 10 and ratio > hi then 'price_insensitive' when nr > 10 and ratio is not null then 'price_moderate' end,
  case when any_cats > 0 and loyalty >= 0.75 then 'category_loyal' when any_cats > 0 and loyalty <= 0.4 and n_cats >= 3 then 'category_explorer' when any_cats > 0 and loyalty > 0.4 then 'moderate_explorer' end], lambda q: q is not null)) as segments from sg3)"""
    out += history_sql("xu")
    out += """, f as (select * from t left join hl using (client_id) left join hb using (client_id) left join wl using (client_id) left join we using (client_id) left join sa using (client_id) left join ga using (client_id) left join ba using (client_id)
  left join af using (client_id) left join qa using (client_id) left join pp using (client_id) left join ca using (client_id) left join ka using (client_id) left join pf using (client_id) left join rr using (client_id) left join nb using (client_id)
  left join nc using (client_id) left join ul using (client_id) left join cc using (client_id) left join cd using (client_id) left join sg using (client_id) left join hx using (client_id) left join br on br.client_id = t.client_id
  cross join (select avg(score) as all_score from ps) cross join (select avg(score) as all_cat_score from pc))"""
    return out


def history_sql(source: str, now: str = NOW) -> str:
    day = 86_400_000_000

    def cats(name: str, table: str, k: int) -> str:
        return f"""{name} as (select client_id, string_agg('[CAT_' || category_id || ']:' || c, ', ' order by c desc, category_id) as cats from
  (select client_id, category_id, count(*) as c from {table} where event_type = 'product_buy' and category_id is not null group by 1, 2 qualify row_number() over (partition by client_id order by c desc, category_id) <= {k}) group by 1)"""

    types = lambda name, table: f"{name} as (select client_id, string_agg(event_type || ':' || c, ', ' order by c desc, event_type) as types, cast(sum(c) as bigint) as n, min(f) as first, max(l) as last from (select client_id, event_type, count(*) as c, min(timestamp) as f, max(timestamp) as l from {table} group by all) group by 1)"
    return f""", h1 as (select *, row_number() over (partition by client_id order by timestamp desc, event_id desc) as r from {source} where epoch_us(timestamp) >= epoch_us({now}) - {14 * day} qualify r <= 30),
h2 as (select client_id, string_agg('[' || strftime(timestamp, '%Y%m%d-%H%M') || '] E:' || event_type || case when sku is not null then ' S:' || sku || coalesce(' C:' || category_id, '') || coalesce(' P:' || price_bucket, '') when url is not null then ' U:' || url
  when query is not null then ' Q:' || lpad(cast(cast('0x' || substr(md5(query), 1, 13) as bigint) % 10000 as varchar), 4, '0') else '' end, chr(10) order by r) as recent from h1 group by 1),
hm as (select * from {source} where epoch_us(timestamp) < epoch_us({now}) - {14 * day} and epoch_us(timestamp) >= epoch_us({now}) - {90 * day}), ho as (select * from {source} where epoch_us(timestamp) < epoch_us({now}) - {90 * day}),
{types('hmt', 'hm')}, {cats('hmc', 'hm', 10)}, {types('hot', 'ho')}, {cats('hoc', 'ho', 3)},
h3 as (select client_id, 'Event count: ' || n || chr(10) || 'Event Types: ' || types || coalesce(chr(10) || 'Top Purchased Cats: ' || cats, '') as medium from hmt left join hmc using (client_id)),
h4 as (select client_id, case when n >= 2 then 'Hist. Span: ~' || {days('last', 'first')} || 'd (end ' || strftime(last, '%Y-%m-%d') || ')' || chr(10) else '' end || 'Hist. Event Counts: ' || types || coalesce(chr(10) || 'Top Hist. Purchased Cats: ' || cats, '') as old from hot left join hoc using (client_id)),
hx as (select coalesce(h2.client_id, h3.client_id, h4.client_id) as client_id, recent, medium, old from h2 full join h3 on h3.client_id = h2.client_id full join h4 on h4.client_id = coalesce(h2.client_id, h3.client_id))"""


# -- SQL of the lines --------------------------------------------------------------------------
def lines_sql(gap: int, capped: bool = True) -> str:
    rows: list[str] = []
    place = 0

    def add(name: str, section: str, *lines: str | tuple[str, str, str]) -> None:
        """lines: expressions over f, or (expression, table, rank) for one line per row of a table."""
        nonlocal place
        for x in lines:
            place += 1
            line, table, rank = x if isinstance(x, tuple) else (x, "f", "0")
            rows.append(f"select client_id, {place} + {rank} / 1000.0 as ord, '{name}' as extractor, '{section}' as section, {line} as line from {table}")

    ago = days(NOW, "last")
    bago = days(NOW, "last_buy")
    more = "n > 1"
    if_ = lambda *x: "case " + " ".join(f"when {c} then {v}" for c, v in zip(x[::2], x[1::2], strict=False)) + (f" else {x[-1]}" if len(x) % 2 else "") + " end"
    add("overview", "OVERVIEW", "'[CLIENT_' || client_id || ']'", "'User Type: ' || case when list_contains(segments, 'buyers') then 'buyer' else 'browser' end",
        "case when len(list_filter(segments, lambda q: q not in ('buyers', 'non_buyers'))) > 0 then 'Segments: ' || array_to_string(list_filter(segments, lambda q: q not in ('buyers', 'non_buyers')), ', ') end")
    add("temporal", "TEMPORAL", "'Peak hours: ' || peaks", "case when pm >= pa and pm >= pe then 'Morning' when pa >= pe then 'Afternoon' else 'Evening' end || '-dominant'", "'Active days: ' || active",
        if_("week and not wend", "'Weekday-dominant'", "wend and not week", "'Weekend-dominant'"), if_(f"{more} and night > 0.7", "'Mostly evening sessions'", f"{more} and night < 0.3", "'Mostly daytime sessions'"), if_(more, "'Sessions: ' || sessions"),
        if_(f"{more} and minutes < 5", f"'Typically very short sessions (~' || {fx('minutes', 1)} || ' m)'", f"{more} and minutes > 60", f"'Typically long sessions (~' || {fx('minutes', 1)} || ' m)'"),
        if_(f"{more} and per_session < 3", f"'Typically shallow sessions (~' || {fx('per_session', 1)} || ' evt)'", f"{more} and per_session > 15", f"'Typically deep sessions (~' || {fx('per_session', 1)} || ' evt)'"),
        f"'Days Since Last Activity: ' || {ago}", f"'Activity Status: ' || case when {ago} <= 7 then 'Very Recent' when {ago} <= 30 then 'Moderately Recent' when {ago} <= 90 then 'Lapsed' else 'Very Lapsed/Inactive' end",
        f"'Days Since Last Purchase: ' || coalesce(cast({bago} as varchar), 'Never')", f"'Days Since Last Cart Add: ' || coalesce(cast({days(NOW, 'last_add')} as varchar), 'Never')",
        f"case when n30 > 0 then 'Activity (Last 30d): ' || n30 || ' events over ' || days30 || ' days (Active Ratio: ' || {fx('days30 / least(30, greatest(1, ' + days('last', 'first30') + ' + 1)) * 100.0', 1)} || '%)' else 'Activity (Last 30d): None' end",
        if_("n14 / n > 0.5", "'Recent-heavy activity (<14d)'"), if_(more, f"'Max Inactivity Gap: ' || {fx('gap', 1)} || ' days'"), if_("gaps30 > 0", "'Notable Gaps (>30d): ' || gaps30", "gaps7 > 0", "'Notable Gaps (>7d): ' || gaps7"),
        if_(f"{more} and {ago} > 30", "'Recent Status: Currently Inactive (>30 days)'", f"{more} and {ago} > 7", "'Recent Status: Currently Lapsing (>7 days)'"))
    some = "n >= 2 and (views + searches > 0 or adds > 0 or buys > 0)"
    starts = "(views + searches)"
    rate = lambda a, b, d: fx(f"case when {b} > 0 then {a} / {b} * 100.0 else 0 end", d)
    gram = lambda head: f"'{head}: ' || gram || ' (' || c || ' times, ' || {fx('share', 1)} || '%)'"
    add("sequence", "SEQUENCE", if_("n < 2", "'Very limited activity'"), if_("n >= 2 and buys = 1", "'Single-purchase buyer'"), (if_("c >= 2", gram("Common sequence")), "g3", "r"), (if_("c >= 2", gram("Common extended path")), "g4", "r"),
        if_("ping_pong >= 2", "'Ping‑pong navigation pattern (' || ping_pong || ' times)'"), if_(some, "'Purchase funnel analysis:'"), if_(f"{some} and {starts} > 0", f"'  Starts (View/Search): ' || {starts}"),
        if_("n >= 2 and adds > 0", f"'  Cart Adds: ' || adds || ' (' || {rate('adds', starts, 1)} || '% of starts)'"), if_("n >= 2 and adds > 0 and buys > 0", f"'  Purchases: ' || buys || ' (' || {rate('buys', 'adds', 1)} || '% of cart adds)'"),
        if_("n >= 2 and adds > 0 and buys > 0", f"'  Overall Conversion: ' || {rate('buys', starts, 2)} || '% from start'"), if_("n >= 2 and adds = 0 and buys > 0", "'  Purchases: ' || buys || ' (direct or uncaptured cart add)'"),
        (if_("n >= 2", "'Common category sequence: CAT_' || a || ' -> CAT_' || b || ' -> CAT_' || c || ' (' || n || 'x)'"), "bn", "0"))
    of = lambda table, least: f"(select {table}.* from {table} join t on t.client_id = {table}.client_id where t.n >= {least})"
    add("graph", "CUSTOM", ("'Category exploration: ' || nodes || ' unique.'", of("vb", 5), "0"), (f"'Dominant cat (PR): CAT_' || node || ' (' || {fx('rank', 3)} || ')'", of("vb", 5), "0"), (f"'Avg cat clustering: ' || {fx('clustering', 3)}", of("vc", 5), "0"),
        ("'Top cat transition: CAT_' || src || '->CAT_' || dst || ' (' || w || 'x)'", of("vm", 5), "0"), ("'Product exploration: ' || nodes || ' unique.'", of("gx", 10), "0"), (f"'Product graph density: ' || {fx('density', 3)}", of("gx", 10), "0"),
        (if_("density > 0.5", "'Dense product co-interaction.'", "density < 0.1", "'Sparse product co-interaction.'"), of("gx", 10), "0"), (f"'Central product (degree): SKU_' || top_node || ' (' || {fx('top_degree / (nodes - 1)', 0)} || ')'", of("gx", 10), "0"),
        if_("n >= 5 and n < 10", "'Product graph skipped (few events or no sku).'"))
    pages = "views / sessions"
    add("intent", "OVERVIEW", "case when searches > 0 then 'Total searches: ' || searches else 'No search events.' end", if_("queried > 0", "'Unique search hashes: ' || queries", "searches > 0", "'No valid search queries found.'"),
        if_("queries < queried", "'Top search hash: [QUERY_' || cast('0x' || substr(md5(top_query), 1, 15) as bigint) || '] (' || top_query_n || 'x)'"),
        if_(f"views >= 3 and {pages} > 15", f"'Intensive browser (~' || {fx(pages, 1)} || ' pages/session)'", f"views >= 3 and {pages} < 3", f"'Shallow browser (~' || {fx(pages, 1)} || ' pages/session)'"),
        if_("views >= 3 and top_v / all_v > 0.75", "'Single-category focus browse'", "views >= 3 and top_v / all_v < 0.4 and viewed >= 3", "'Multi-category explorer browse'"), if_("views >= 3 and viewed > 1", f"'Category Diversity:' || {fx('view_entropy', 2)}"),
        "'Funnel Stage: ' || case when buys > 0 then 'Conversion' when adds > 0 then 'Consideration' when searches > 0 or views > 5 then 'Research' when views > 0 then 'Awareness' else 'Inactive' end",
        if_("adds > 0 and buys / adds < 0.2", "'Cart Behavior: High abandon ratio'", "adds > 0 and buys / adds > 0.8", "'Cart Behavior: High conversion ratio'"))
    add("price", "PRICE", if_("priced = 0", "'No price data.'"), if_("n_range >= 2", f"'Interacted price range (bucket): ' || {fx('low', 0)} || ' - ' || {fx('high', 0)} || ' (avg ' || {fx('middle', 0)} || ')'"),
        if_("n_range >= 2 and high - low > 30", "'Wide price exploration.'", "n_range >= 2 and high - low < 10", "'Narrow price focus.'"),
        if_("n_range >= 2 and n_paid >= 2 and paid > 0 and paid_std / paid < 0.15", "'Consistent purchase price.'", "n_range >= 2 and n_paid >= 2 and paid > 0 and paid_std / paid > 0.4", "'Varied purchase prices.'"),
        if_("added > 0 and paid / added < 0.8", "'Sensitivity: High (buys cheaper than adds)'", "added > 0 and paid / added > 1.2", "'Sensitivity: Low (buys similar/pricier)'", "added > 0 and paid is not null", "'Sensitivity: Moderate'"),
        if_("any_paid > 0 and abandoned > carted_and_paid * 1.2", "'Tends to abandon higher-priced cart items.'"), if_("n_paid > 0", f"'RFM:' || {days(NOW, 'last_paid')} || ':' || freq90 || ':' || {fx('paid', 0)}"))
    known = "n_shopped > 0 and all_score > 0"
    add("social", "SOCIAL", if_(known, "'Affinity: ' || case when own_score / all_score > 1.3 then 'Popular products' when own_score / all_score < 0.7 then 'Niche products' else 'Average popularity' end"),
        if_(f"{known} and abs(own_score - all_score) >= 1", f"'Popularity Δ: ' || {fx('own_score - all_score', 1, '+')}"), if_("cat_score > 0 and own_score / cat_score > 1.3", "'Affinity: Popular VS category avg'", "cat_score > 0 and own_score / cat_score < 0.7", "'Affinity: Niche VS category avg'"),
        if_("n_shopped > 0 and all_v >= 10 and top_v / all_v >= 0.75", "'Browsing highly concentrated on one category'", "n_shopped > 0 and all_v >= 10 and top_v / all_v <= 0.4 and viewed >= 3", "'Browsing spread across many categories'"),
        if_("view_score > 0 and cart_score / view_score > 1.2", "'Adds more popular items to cart than viewed.'", "view_score > 0 and cart_score / view_score < 0.8", "'Adds less popular items to cart than viewed.'"),
        if_("all_cat_score > 0 and cat_score / all_cat_score > 1.3", "'Category affinity: Popular categories'", "all_cat_score > 0 and cat_score / all_cat_score < 0.7", "'Category affinity: Niche categories'"),
        if_("best_score is not null", f"'Most popular category: CAT_' || best_category || ' (score: ' || {fx('best_score', 0)} || ')'"))
    add("name_embedding", "CUSTOM", "coalesce(name_line, case when n_shopped > 0 then 'No valid name embeddings found.' end)", if_("n_names > 1 and name_std < 30", "'Product Name Focus: High (Low Variance)'", "n_names > 1 and name_std > 70", "'Product Name Focus: Low (High Variance)'"))
    add("churn_propensity", "CHURN_PROPENSITY", if_("buys = 0", "'CHURN_STATUS:NO_PURCHASE'"), if_(f"{bago} >= 14", "'CHURN_RISK:HIGH'", "buys > 0", "'CHURN_RISK:LOW'"), if_("buys > 0", f"'PURCHASE_RECENCY:' || {bago} || 'd'"),
        f"'AVG_PURCHASE_INTERVAL:' || {fx('interval_mean', 1)} || 'd'", if_(f"{bago} > interval_mean * 2", "'PURCHASE_PATTERN:UNUSUAL_GAP'"), if_("buys > 0 and n_after > 0", "'POST_PURCHASE_EVENTS:' || n_after"),
        if_("views_after > 0", "'POST_PURCHASE:BROWSING'"), if_("adds_after > 0", "'POST_PURCHASE:CART_ACTIVITY'"), if_("buys > 0 and coalesce(n_after, 0) = 0", "'POST_PURCHASE:NO_ACTIVITY'"), if_("buys > 0", "'LTV_INDICATOR:' || ltv"),
        if_("breadth is null", "'CAT_PROPENSITY:NO_CATEGORY_EVENTS'"), (if_("r <= 5", f"'CAT_PROPENSITY:CAT_' || category_id || '(score=' || {fx('s', 2)} || ')'"), "ci", "r"), "'CAT_EXPLORATION_BREADTH:' || breadth",
        if_("all_b > 0", f"'PURCHASE_CAT_FOCUS:CAT_' || focus || '(' || {fx('top_b / all_b', 2)} || ')'"), if_("n_skus is null", "'SKU_PROPENSITY:NO_SKU_EVENTS'"), (if_("r <= 10", f"'SKU_PROPENSITY_TOP' || r || ':SKU_' || sku || '(score=' || {fx('s', 2)} || ')'"), "ki", "r"),
        if_("repeats > 0", "'REPEAT_PURCHASE_SKUS:' || repeats"), if_("repeats > 0", "'TOP_REPEAT_SKU:SKU_' || top_repeat || '(' || top_repeat_n || 'x)'"), ("'BRAND_AFFINITY:' || brand || '(' || c || ')'", "br", "0"))
    for name, item, table, mark, section, size, word in (("top_sku", "sku", "k5", "SKU", "SKU_PROPENSITY", 20, "SKU"), ("top_category", "category_id", "c5", "CAT", "CAT_PROPENSITY", 10, "category")):
        add(name, section, f"case when not exists (select 1 from {table} where {table}.client_id = f.client_id) then 'No top-{word} interactions' end",
            (if_("r <= 5", f"'TOP{mark}' || r || ':{mark}_' || {item} || ' rs=' || {fx('s', 2)} || ' cnt=' || c || ' last=' || ago || 'd'"), table, "r"), (if_("r = 1", f"'Top-{word} coverage:' || {fx(f'met / {size} * 100.0', 0)} || '%'"), table, "0"))
    tidy = lambda c: f"cast(round_even({c} * 100, 0) / 100 as varchar)"
    add("custom_behavior", "CUSTOM", "'SKU_CLUSTER_SHARES:'", (f"'  - C' || cluster || ': ' || {fx('share * 100.0', 0)} || '%'", "cs", "r"), f"'URL_EMB_SIM: ' || {fx('url_similarity', 3)}",
        f"'TIME_CYCLIC_MEAN: [' || {tidy('c0')} || ', ' || {tidy('c1')} || ', ' || {tidy('c2')} || ', ' || {tidy('c3')} || ']'", f"'RFM_REC_Q: ' || {fx('buy_share', 2)}")
    add("co_pairs", "CUSTOM", ("'CO_PAIR:SKU_' || i || '~SKU_' || j || ' (' || n || 'x)'", "p1t", "r"))
    add("category_pairs", "CUSTOM", ("'CAT_PAIR:CAT_' || i || '~CAT_' || j || ' (' || n || 'x)'", "p2t", "r"))
    add("cart_conversion", "CUSTOM", f"case when coalesce(carts, 0) = 0 then 'Cart conversion: no cart activity' else 'CART_CONV_RATE=' || {fx('converted / carts', 2)} end", f"'AVG_CART2BUY_MIN=' || {fx('mean_minutes', 1)}")
    add("compact", "PROP_SUBSET_STATS", f"'NAME_STD:' || {short('round(name_spread, 6)', 2)}", if_("added > 0 and paid is not null", f"'Δ$:' || {fx('100.0 * (paid - added) / added', 0, '+')} || '%'"), f"'BURST:' || {short('burst', 2)}",
        if_("central_rank is not null", f"'CAT_PR_TOP:' || central || '(' || {short('central_rank', 2)} || ')'"), if_("breadth = 1", "'H_cat:-0.0'", "breadth > 1", f"'H_cat:' || {short('entropy', 1)}"), if_("n_prices = 1", "'H_price:-0.0'", "n_prices > 1", f"'H_price:' || {short('price_entropy', 1)}"))
    add("extra", "PROP_SUBSET_STATS", if_("buys > 0", f"'CENT_SKU:' || {fx('bought_rank', 2)}"), if_("favourite_rank is not null", f"'CENT_CAT:' || favourite || '(' || {fx('favourite_rank', 2)} || ')'"), f"'DOW_ENT:' || {short('abs(dow)', 2)}", f"'TOD_VAR:' || {short('round(tod, 9)', 2)}",
        f"'REC_RANK:' || {short('1 - recency_share', 2)}", if_(f"{days('last', 'first')} > 0", f"'LIFETIME:~' || {days('last', 'first')} || 'd'"))
    add("recent", "TARGET_WINDOW_14D", "coalesce(recent, 'No activity in last 14 days')")
    add("medium", "SEQUENCE", "medium")
    add("historical", "CUSTOM", "old")
    both = " union all ".join(rows)
    return facts_sql(gap, capped) + f", ll as ({both}), ln as (select client_id, cast(row_number() over (partition by client_id order by ord) - 1 as integer) as pos, extractor, section, line from ll where line is not null)"


@query("profile_lines", lines_sql(USUAL) + " select * from ln")
def profile_lines(spark, sf_dir):
    """Every line of every extractor."""
    return rendering.long_lines(profiles(spark, sf_dir))


@query("profile_lines_wide", lines_sql(WIDE, capped=False) + " select * from ln")
def profile_lines_wide(spark, sf_dir):
    """The same under a session gap of three days, so that sessions hold pairs and sequences, and pairs of all items."""
    return rendering.long_lines(whole_profiles(spark, sf_dir, WIDE))


# -- texts and records ---------------------------------------------------------------------------
MARK_SQL = "case section " + " ".join(f"when '{s}' then '{m}'" for s, m in tx.MARKS.items()) + " end"
PLACE_SQL = "case section " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(tx.SECTIONS)) + " end"


def text_sql(gap: int, limit: int, capped: bool = True) -> str:
    """The table ``tx`` (client_id, rich_text) from the lines."""
    return lines_sql(gap, capped) + rf""", d0 as (select *, min(pos) over (partition by client_id, section) as f from ln), d1 as (select *, row_number() over (partition by client_id, lower(trim(line)) order by f, pos) as same from d0),
d2 as (select *, row_number() over (partition by client_id, section order by pos) as r from d1 where same = 1),
d3 as (select client_id, section, r, line, unnest(case when contains(line, 'CHURN_') or contains(line, 'PROPENSITY') or contains(line, '**') then [0, 1] else [0] end) as copy from d2 where r <= 10),
d4 as (select *, row_number() over (partition by client_id, section order by r, copy) as i, count(*) over (partition by client_id, section) as n from d3),
d5 as (select *, row_number() over (partition by client_id, section order by case when i <= 2 or n <= 3 then 0 else 1 end, case when i <= 2 or n <= 3 then lpad(cast(i as varchar), 3, '0') else md5(client_id || ':42:' || section || ':' || (i - 3)) end) as place from d4),
d6 as (select client_id, {PLACE_SQL} as p, place, line from d5 union all select distinct client_id, {PLACE_SQL}, -1, {MARK_SQL} from d5 union all select distinct client_id, {PLACE_SQL}, 0, '## ' || section || ' ##' from d5),
d7 as (select *, sum(case when trim(line) = '' then 0 else len(regexp_split_to_array(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')) end) over (partition by client_id order by p, place rows unbounded preceding) as words from d6),
tx as (select client_id, string_agg(line, chr(10) order by p, place) || chr(10) || '[END]' as rich_text from d7 where words <= {limit} group by 1)"""


def rich_texts(spark, sf_dir, gap: int = WIDE, limit: int = 4096, keep: tuple[str, ...] = ()):
    """Rich texts, and what else of the facts is asked for."""
    return with_texts(profiles(spark, sf_dir, gap, keep), limit)


def with_texts(found, limit: int = 4096):
    return found.withColumn("rich_text", tx.assembled(F.col("lines"), F.col("client_id"), limit, seed=42))


@query("rich_text", text_sql(WIDE, 4096) + " select client_id, rich_text from tx")
def rich_text(spark, sf_dir):
    return rich_texts(spark, sf_dir).select("client_id", "rich_text")


@query("rich_text_short", text_sql(USUAL, 150) + " select client_id, rich_text from tx")
def rich_text_short(spark, sf_dir):
    """Under the usual gap, and a budget of words that cuts."""
    return rich_texts(spark, sf_dir, USUAL, 150).select("client_id", "rich_text")


REPORT_SQL = "with_parts as (select unnest([" + ", ".join([f"{{'kind': 'section', 'name': '{s}', 'mark': '## {s} ##'}}" for s in tx.SECTIONS] + [f"{{'kind': 'mark', 'name': '{m}', 'mark': '{m}'}}" for m in [*tx.MARKS.values(), tx.END]]) + "], recursive := true))"


@query("status_report", text_sql(WIDE, 4096, capped=False) + f", {REPORT_SQL} select kind, name, count(*) filter (contains(rich_text, mark)) as n_with, count(*) as n_texts, cast(sum(case when kind = 'section' and contains(rich_text, mark) then len(string_split(substr(rich_text, instr(rich_text, mark)), chr(10))) - 1 end) as bigint) as n_lines from tx, with_parts group by all")
def status_report(spark, sf_dir):
    """Of texts in whose pairs all items of a session take part."""
    return dataset.status_report(with_texts(whole_profiles(spark, sf_dir, WIDE)), "rich_text")


CLIENTS = "cl0 as (select distinct client_id from xu where client_id % 3 <> 0 union select max(client_id) + unnest([1, 2, 3]) from xu)"
RECORD_SQL = """{'client_id': c.client_id, 'overview': {'user_type': case when list_contains(f.segments, 'buyers') then 'buyer' else 'browser' end, 'segments': list_filter(f.segments, lambda q: q not in ('buyers', 'non_buyers'))},
  'features': features[1:100], 'behavioral_metrics': {'co_pairs': coalesce(co, []), 'category_pairs': coalesce(cat, []), 'cart_conversion': coalesce(conv, [])},
  'recent_activity': substr(coalesce(f.recent, 'No recent activity.'), 1, 500), 'medium_term_summary': substr(coalesce(f.medium, 'No medium-term activity.'), 1, 500), 'historical_aggregates': substr(coalesce(f.old, 'No historical activity.'), 1, 500),
  'raw_sequence': substr(coalesce(raw_sequence, ''), 1, 1000)}"""


def records_sql() -> str:
    raw = raw_sql().removeprefix(X) + RAW_TEXT
    raw = raw.replace(", n0 as (select count(*) as n from pages), xu as (select x.*, url from x cross join n0 left join pages on event_type = 'page_visit' and page_id = k % n0.n)", "").replace("\ns as (", "\nrz as (").replace(" s as (", " rz as (").replace("from s window", "from rz window")
    of = lambda name: f"list(line order by pos) filter (extractor = '{name}')"
    return text_sql(WIDE, 4096) + raw + f""", {CLIENTS}, fe as (select client_id, list({{'type': extractor, 'value': line}} order by pos) filter (extractor not in ('overview', 'co_pairs', 'category_pairs', 'cart_conversion', 'recent', 'medium', 'historical')) as features,
  {of('co_pairs')} as co, {of('category_pairs')} as cat, {of('cart_conversion')} as conv from ln group by 1),
rec as (select c.client_id, f.client_id is not null as there, {RECORD_SQL} as record, rich_text from cl0 c left join f on f.client_id = c.client_id left join fe on fe.client_id = c.client_id left join raw on raw.client_id = c.client_id left join tx on tx.client_id = c.client_id)
select client_id, case when there then 'success' else 'no_data' end as status, cast(case when there then to_json(record) else to_json({{'client_id': client_id, 'error': 'No activity'}}) end as varchar) as profile,
  case when there then rich_text else '[CLIENT_' || client_id || ']' || chr(10) || 'No activity data.' end as rich_text,
  md5(cast(case when there then to_json({{'profile': record, 'rich_text': rich_text}}) else to_json({{'profile': {{'client_id': client_id, 'error': 'No activity'}}}}) end as varchar)) as json_md5 from rec"""


@query("profile_json", records_sql())
def profile_json(spark, sf_dir):
    """Records of the relevant clients, and of three that have no events."""
    raw = sequence.raw_sequence_text(raw_tokens(spark, sf_dir))
    found = rich_texts(spark, sf_dir, WIDE, keep=("segments", "recent", "medium", "old")).join(raw, "client_id", "left")
    e = client_events(spark, sf_dir)
    beyond = e.agg(F.max("client_id").alias("top")).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.col("top") + i)).alias("client_id"))
    clients = e.where("client_id % 3 <> 0").select("client_id").distinct().unionByName(beyond)
    return dataset.profile_records(found, clients).withColumn("json_md5", F.md5("json_str")).drop("json_str")


@query("raw_sequence_fill", text_sql(WIDE, 4096) + raw_sql().removeprefix(X).replace(", n0 as (select count(*) as n from pages), xu as (select x.*, url from x cross join n0 left join pages on event_type = 'page_visit' and page_id = k % n0.n)", "").replace(" s as (", " rz as (").replace("from s window", "from rz window") + RAW_TEXT + r"""
select client_id, md5(replace(rich_text, '[END]', chr(10) || '## RAW_SEQUENCE ##' || chr(10) || '```' || chr(10) || case when n > 20 then '... (truncated to last 20 events)' || chr(10) || array_to_string(e[n - 19 : n], '</s>') else array_to_string(e, '</s>') end || chr(10) || '```' || chr(10) || '[END]')) as text
from (select tx.client_id, rich_text, string_split(raw_sequence, '</s>') as e, len(string_split(raw_sequence, '</s>')) as n from tx join raw using (client_id))""")
def raw_sequence_fill(spark, sf_dir):
    """Rich texts with the last 20 tokens of the raw sequence in a section of their own."""
    texts = rich_text(spark, sf_dir).withColumnRenamed("rich_text", "text")
    return extractors.with_raw_sequences(texts, sequence.raw_sequence_text(raw_tokens(spark, sf_dir)), most=20).withColumn("text", F.md5("text"))


@query("profile_segments", facts_sql(USUAL) + " select client_id, array_to_string(segments, ',') as segments from sg")
def profile_segments(spark, sf_dir):
    return segments.profile_segments(client_events(spark, sf_dir)).select("client_id", F.array_join("segments", ",").alias("segments"))


LATE = "timestamp '2024-04-20 00:00:00'"


@query("history_texts", XU + history_sql("xu") + " select * from hx")
def history_texts(spark, sf_dir):
    events = with_urls(client_events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rendering.history_texts(events)


@query("history_texts_late", XU + history_sql("(select xu.* replace (case when event_id % 4 = 0 then sku end as sku) from xu)", LATE) + " select * from hx")
def history_texts_late(spark, sf_dir):
    """Looked at in April, when part of January lies more than 90 days back; three of four events have no sku."""
    events = with_urls(client_events(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("sku", F.when(F.col("event_id") % 4 == 0, F.col("sku")))
    return rendering.history_texts(events, EngineConf(as_of=datetime(2024, 4, 20)))


# -- data sets -------------------------------------------------------------------------------------
@query("augment_lines")
def augment_lines(spark, sf_dir):
    t = rich_text(spark, sf_dir)
    drop = lambda p, seed: tx.drop_lines(F.col("rich_text"), F.col("client_id"), p, seed)
    return dataset.variants(t, "rich_text", {"aug1": drop(0.35, 42), "aug2": drop(0.5, 1042)})


@query("augment_sections")
def augment_sections(spark, sf_dir):
    texts = rich_text(spark, sf_dir).withColumnRenamed("rich_text", "text")
    filled = extractors.with_raw_sequences(texts, sequence.raw_sequence_text(raw_tokens(spark, sf_dir)))
    return filled.select("client_id", tx.augment_sections(F.col("text"), F.col("client_id")).alias("text"))


@query("token_pairs")
def token_pairs(spark, sf_dir):
    t = rich_text(spark, sf_dir)
    both = t.withColumn("aug", tx.drop_lines(F.col("rich_text"), F.col("client_id")))
    a, b = dataset.tokenized(both, "client_id", "rich_text"), dataset.tokenized(both, "client_id", "aug").withColumnRenamed("input_ids", "input_ids_aug")
    return a.join(b, "client_id")


@query("text_embeddings")
def text_embeddings(spark, sf_dir):
    return dataset.encoded(rich_text(spark, sf_dir), "client_id", "rich_text", hashed_vectors, 16)


def hashed_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in encoder: signed counts of hashed words."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * 16
        for w in t.split():
            h = zlib.crc32(w.encode())
            v[h % 16] += 1 if h & 256 else -1
        out.append(v)
    return out


@query("portraits")
def portraits(spark, sf_dir):
    """Portraits of clients; one that failed is null and keeps an error."""
    return dataset.cleaned_portraits(dataset.generated(rich_text(spark, sf_dir), "client_id", "rich_text", first_lines))


def first_lines(texts: list[str]) -> list[str]:
    """A stand-in generator: the first lines of a profile as bullets."""
    return ["\n".join("- " + x for x in t.split("\n")[:3] if not x.startswith("##")) + "\n— FIN —" for t in texts]
