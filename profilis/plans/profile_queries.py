"""Queries on metrics, graphs, vectors, texts and data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilis.conf import CONF
from profilis.functions import text as tx
from profilis.functions.stats import r6
from profilis.operators import dataset, graph, metrics, pairs, price, sequence, vectors
from profilis.plans.registry import NOW, X, days, query, sessions_sql
from profilis.sources.events import client_events

DAY = 86400


# -- metrics ----------------------------------------------------------------------------
@query("burst_score", X + ", h as (select client_id, hour(timestamp) as h, count(*) as n from x group by all) select client_id, round((sum(n * n) / 24 - pow(sum(n) / 24, 2)) / (sum(n) / 24), 6) as burst from h group by 1")
def burst_score(spark, sf_dir):
    return metrics.burst_score(client_events(spark, sf_dir))


@query("time_of_day_variance", X + "select client_id, round(1 - sqrt(pow(avg(cos(2 * pi() * hour(timestamp) / 24)), 2) + pow(avg(sin(2 * pi() * hour(timestamp) / 24)), 2)), 6) as tod_var from x group by 1")
def time_of_day_variance(spark, sf_dir):
    return metrics.time_of_day_variance(client_events(spark, sf_dir))


def _entropy(value: str, out: str, where: str = "true") -> str:
    return X + f", c as (select client_id, {value} as v, count(*) as n from x where {where} group by all), p as (select client_id, n / sum(n) over (partition by client_id) as p from c) select client_id, round(-sum(p * log2(p)), 6) + 0.0 as {out} from p group by 1"


@query("weekday_entropy", _entropy("isodow(timestamp)", "weekday_entropy"))
def weekday_entropy(spark, sf_dir):
    return metrics.weekday_entropy(client_events(spark, sf_dir))


@query("price_entropy", _entropy("price_bucket", "price_entropy", "price_bucket > 0"))
def price_entropy(spark, sf_dir):
    return metrics.price_entropy(client_events(spark, sf_dir))


@query("price_shift", X + ", p as (select client_id, avg(price_bucket) filter (event_type = 'product_buy') as b, avg(price_bucket) filter (event_type = 'add_to_cart') as a from x group by 1) select client_id, round(100 * (b - a) / a, 6) as price_shift_percent from p where a > 0 and b is not null")
def price_shift(spark, sf_dir):
    return metrics.price_shift(client_events(spark, sf_dir))


@query("cyclic_means", X + """select client_id, round(avg(sin(2 * pi() * hour(timestamp) / 24)), 6) as hour_sin, round(avg(cos(2 * pi() * hour(timestamp) / 24)), 6) as hour_cos,
  round(avg(sin(2 * pi() * (isodow(timestamp) - 1) / 7)), 6) as day_sin, round(avg(cos(2 * pi() * (isodow(timestamp) - 1) / 7)), 6) as day_cos from x group by 1""")
def cyclic_means(spark, sf_dir):
    return metrics.cyclic_means(client_events(spark, sf_dir))


@query("favourites", X + """, a as (select client_id, sku, row_number() over (partition by client_id order by count(*) desc, sku) as r from x where sku is not null group by client_id, sku),
b as (select client_id, category_id, row_number() over (partition by client_id order by count(*) desc, category_id) as r from x where category_id is not null group by client_id, category_id)
select coalesce(a.client_id, b.client_id) as client_id, sku, category_id from (select * from a where r = 1) a full join (select * from b where r = 1) b on a.client_id = b.client_id""")
def favourites(spark, sf_dir):
    return metrics.favourites(client_events(spark, sf_dir))


@query("recency_rank", X + f""", p as (select client_id, {days(NOW, 'max(timestamp)')} as days, {days(NOW, "max(timestamp) filter (event_type = 'product_buy')")} as bd from x group by 1)
select client_id, days, round((select count(*) filter (q.bd <= p.days) / count(q.bd) from p q), 6) as recency_rank from p""")
def recency_rank(spark, sf_dir):
    return metrics.recency_rank(client_events(spark, sf_dir))


# -- graphs -----------------------------------------------------------------------------
CATEGORY_EDGES = """, cv as (select * from x where event_type in ('page_visit', 'product_buy') and category_id is not null), cp as (select lag(category_id) over (partition by client_id order by timestamp, event_id) as src, category_id as dst from cv),
e as (select src, dst, count(*) as w from cp where src <> dst group by all)"""


def _pagerank(rounds: int) -> str:
    out = """, l as (select src, dst, w / sum(w) over (partition by src) as p from e), nd as (select src as node from e union select dst from e), sz as (select count(*) as n from nd), r0 as (select node, 1.0 / n as rank from nd, sz)"""
    for i in range(rounds):
        out += f", r{i + 1} as (select nd.node, 0.15 / n + 0.85 * coalesce(g.got, 0) as rank from nd cross join sz left join (select dst, sum(rank * p) as got from l join r{i} on r{i}.node = l.src group by dst) g on g.dst = nd.node)"
    return out + f" select node, round(rank, 6) as pagerank from r{rounds}"


@query("pagerank_category", X + CATEGORY_EDGES + _pagerank(10))
def pagerank_category(spark, sf_dir):
    return graph.pagerank(sequence.category_transitions(client_events(spark, sf_dir)))


def _central(spark, sf_dir):
    e = client_events(spark, sf_dir)
    return pairs.central_edges(e, price.popularity(e, "sku"), CONF.session_gap_s)


SKU_EDGES = """, pk as (select sku, count(*) filter (event_type = 'page_visit') as v, count(*) filter (event_type = 'add_to_cart') as a, count(*) filter (event_type = 'product_buy') as b from x where sku is not null group by 1),
ps as (select sku, case when sum(v) over () > 0 then v + 3 * a + 10 * b else 2 * a + 10 * b end as score from pk),
top as (select sku from ps where score > 0 or (select count(*) from ps where score > 0) < 100 order by score desc, sku limit 2000), kx as (select x.* from x semi join top on top.sku = x.sku), """ + sessions_sql("kx") + """,
ki as (select distinct client_id, session_id, sku from s), e as (select a.sku as src, b.sku as dst, count(*) as w from ki a join ki b on a.client_id = b.client_id and a.session_id = b.session_id and a.sku < b.sku group by all)"""


@query("pagerank_sku", X + SKU_EDGES + _pagerank(10))
def pagerank_sku(spark, sf_dir):
    """Ranks over skus that meet in a session, among the 2000 most popular ones."""
    return graph.pagerank(_central(spark, sf_dir))


CLIENT_EDGES = """, cv as (select * from x where category_id is not null), cp as (select client_id, lag(category_id) over (partition by client_id order by timestamp, event_id) as src, category_id as dst from cv),
e as (select client_id, src, dst, count(*) as w from cp where src <> dst group by all)"""


def _client_pagerank(rounds: int) -> str:
    out = ", l as (select client_id, src, dst, w / sum(w) over (partition by client_id, src) as p from e), nd as (select client_id, src as node from e union select client_id, dst from e), sz as (select client_id, count(*) as n from nd group by 1), ns as (select nd.*, n from nd join sz on sz.client_id = nd.client_id), r0 as (select client_id, node, 1.0 / n as rank from ns)"
    for i in range(rounds):
        out += f", r{i + 1} as (select ns.client_id, ns.node, 0.15 / n + 0.85 * coalesce(g.got, 0) as rank from ns left join (select l.client_id, dst, sum(rank * p) as got from l join r{i} r on r.node = l.src and r.client_id = l.client_id group by all) g on g.dst = ns.node and g.client_id = ns.client_id)"
    return out + f" select client_id, node, round(rank, 6) as pagerank from r{rounds}"


@query("category_pagerank_client", X + CLIENT_EDGES + _client_pagerank(5))
def category_pagerank_client(spark, sf_dir):
    return graph.pagerank(sequence.client_category_transitions(client_events(spark, sf_dir)), rounds=5, keys=("client_id",))


@query("clustering_coefficient", X + CATEGORY_EDGES + """, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e), dg as (select node, count(*) as degree from (select a as node from u union all select b from u) group by 1),
t as (select p.a as a, p.b as b, q.b as c from u p join u q on q.a = p.b join u r on r.a = p.a and r.b = q.b), tn as (select node, count(*) as t from (select a as node from t union all select b from t union all select c from t) group by 1)
select dg.node, degree, coalesce(t, 0) as triangles, round(case when degree > 1 then coalesce(t, 0) / (degree * (degree - 1) / 2) else 0 end, 6) as clustering from dg left join tn on tn.node = dg.node""")
def clustering_coefficient(spark, sf_dir):
    return graph.clustering_coefficient(sequence.category_transitions(client_events(spark, sf_dir)))


@query("random_walks")
def random_walks(spark, sf_dir):
    return graph.random_walks(sequence.category_transitions(client_events(spark, sf_dir))).select("start", "walk", F.array_join("path", ",").alias("path"))


# -- vectors ----------------------------------------------------------------------------
NAMED = X + ", n as (select client_id, embedding as v from x join embeddings on vec_id = sku)"


def _named(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sku"), F.col("embedding").alias("v"))
    return client_events(spark, sf_dir).join(v, "sku").select("client_id", "v")


@query("name_vector_mean", NAMED + """, u as (select client_id, unnest(v) as c, generate_subscripts(v, 1) - 1 as pos from n)
select client_id, cast(pos as integer) as pos, round(avg(cast(c as double)), 6) as mean, round(stddev_pop(cast(c as double)), 6) as std, count(*) as n from u where pos < 32 group by 1, 2""")
def name_vector_mean(spark, sf_dir):
    m = vectors.mean_vectors(_named(spark, sf_dir).select("client_id", F.slice("v", 1, 32).alias("v")), "client_id", "v")
    return m.select("client_id", "pos", r6(F.col("m")).alias("mean"), r6(F.col("s")).alias("std"), "n")


@query("name_vector_spread", NAMED + ", u as (select client_id, cast(unnest(v) as double) as c from n) select client_id, round(stddev_pop(c), 6) as spread from u group by 1")
def name_vector_spread(spark, sf_dir):
    return vectors.vector_spread(_named(spark, sf_dir), "client_id", "v")


UNIT = "list_transform({v}, lambda q: cast(q as double) / (sqrt(list_sum(list_transform({v}, lambda y: cast(y as double) * cast(y as double)))) + 1e-8))"


@query("vector_normalise", f"select vec_id, array_to_string(list_transform({UNIT.format(v='embedding')}, lambda q: cast(cast(round(q * 1000000) as bigint) as varchar)), ',') as unit from embeddings")
def vector_normalise(spark, sf_dir):
    """All components, in millionths."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", F.array_join(F.transform(vectors.normalised(F.col("embedding")), lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",").alias("unit"))


@query("centroid_similarity", f"""with u as (select vec_id, {UNIT.format(v='embedding')} as u from embeddings), l as (select vec_id, unnest(u) as c, generate_subscripts(u, 1) as pos from u), m as (select pos, avg(c) as m from l group by 1)
select vec_id, round(sum(c * m), 6) as similarity from l join m on m.pos = l.pos group by 1""")
def centroid_similarity(spark, sf_dir):
    return vectors.centroid_similarity(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


#: Published task scores of three encoders.
SCORES = {"encoder_a": [0.7029, 0.7639, 0.7362, 0.7123, 0.7215, 0.7751], "encoder_b": [0.7098, 0.7685, 0.7645, 0.7166, 0.7689, 0.7762], "encoder_c": [0.7098, 0.7640, 0.7553, 0.7107, 0.7242, 0.7700]}


def _ensemble_sql() -> str:
    w = list(vectors.ensemble_weights(SCORES).values())
    sums = " + ".join(f"{w[i]!r} * u[{j}]" for i, j in enumerate(("pos", "1 + (pos % 64)", "65 - pos")))
    return f"""with u as (select vec_id, {UNIT.format(v='embedding')} as u from embeddings), l as (select vec_id, u, unnest(range(1, 65)) as pos from u), c as (select vec_id, pos, {sums} as c from l), n as (select vec_id, sqrt(sum(c * c)) + 1e-8 as n from c group by 1)
select c.vec_id, cast(c.pos as integer) as pos, round(c / n, 6) as value from c join n on n.vec_id = c.vec_id"""


@query("ensemble_vectors", _ensemble_sql())
def ensemble_vectors(spark, sf_dir):
    """Three encoders stood for by the table's vectors, rotated by one and reversed."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    w = list(vectors.ensemble_weights(SCORES).values())
    turned = v.select("vec_id", F.concat(F.slice("v", 2, 63), F.slice("v", 1, 1)).alias("v"))
    back = v.select("vec_id", F.reverse("v").alias("v"))
    return vectors.ensemble([(v, w[0]), (turned, w[1]), (back, w[2])], "vec_id", "v").select("vec_id", F.posexplode("vector").alias("p", "c")).select("vec_id", (F.col("p") + 1).alias("pos"), r6(F.col("c")).alias("value"))


#: Without active bounds the weights are 1 / n plus half the lead over the mean, over the penalty of 0.2.
ENSEMBLE_WEIGHTS = "with s as (select unnest([" + ", ".join(f"{{'model': '{m}', 'scores': {v}}}" for m, v in SCORES.items()) + "], recursive := true)), m as (select model, list_avg(scores) as m from s) select model, round(1 / count(*) over () + (m - avg(m) over ()) / 0.4, 6) as weight from m"


@query("ensemble_weights", ENSEMBLE_WEIGHTS)
def ensemble_weights(spark, sf_dir):
    return spark.createDataFrame([(m, round(w, 6)) for m, w in vectors.ensemble_weights(SCORES).items()], "model string, weight double")


@query("infonce_metrics", f"""with u as (select vec_id, vec_id // 20 as batch, {UNIT.format(v='embedding')} as a from embeddings), z as (select vec_id, batch, a, list_reverse(a) as rv from u),
p as (select vec_id, batch, {UNIT.format(v='mx')} as p from (select vec_id, batch, list_transform(range(1, 65), lambda i: 0.8 * a[i] + 0.2 * rv[i]) as mx from z)),
s as (select a.batch, a.vec_id as i, p.vec_id as j, list_sum(list_transform(range(1, 65), lambda k: a.a[k] * p.p[k])) / 0.07 as s from u a join p on p.batch = a.batch),
g as (select batch, i, max(s) as m, max(s) filter (i = j) as own from s group by 1, 2), h as (select s.batch, s.i, m, own, m + ln(sum(exp(s.s - m))) as lse from s join g on g.batch = s.batch and g.i = s.i group by s.batch, s.i, m, own)
select batch, count(*) as n, round(avg(lse - own), 6) as loss, round(avg(cast(own >= m as int)), 6) as accuracy, round(avg(own * 0.07), 6) as mean_similarity from h group by 1""")
def infonce_metrics(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.expr("vec_id div 20").alias("batch"), vectors.normalised(F.col("embedding")).alias("a"))
    p = v.withColumn("p", F.zip_with("a", F.reverse("a"), lambda x, y: 0.8 * x + 0.2 * y))
    return vectors.infonce(p, "batch", "a", "p", "vec_id")


@query("sku_clusters")
def sku_clusters(spark, sf_dir):
    return vectors.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


@query("cluster_shares", X + ", c as (select client_id, cast(sku % 7 as integer) as cluster, count(*) as n from x where sku is not null group by all), s as (select *, round(n / sum(n) over (partition by client_id), 6) as share from c) select *, cast(row_number() over (partition by client_id order by n desc, cluster) as integer) as rank from s qualify row_number() over (partition by client_id order by n desc, cluster) <= 3")
def cluster_shares(spark, sf_dir):
    clusters = client_events(spark, sf_dir).where("sku is not null").select("sku").distinct().withColumn("cluster", (F.col("sku") % 7).cast("int"))
    return metrics.cluster_shares(client_events(spark, sf_dir), clusters)


# -- texts --------------------------------------------------------------------------------
#: Documents that name a client in every way that cleaning knows, and their own number.
DOCS = """with d as (select doc_id, '[CLIENT_' || doc_id || '] client_id: ' || doc_id || ' "client_id": 12, ''client_id'': 7 CLIENT_99x user ' || doc_id || ' ' || text || ' ' || doc_id || '.' as t from documents)"""


@query("clean_text", DOCS + r""", a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)\[CLIENT_\d+\]', '', 'g'), '(?i)CLIENT_\d+', '', 'g'), '(?i)client_id:\s*\d+', '', 'g') as t from d),
b as (select doc_id, regexp_replace(regexp_replace(t, '(?i)"client_id":\s*\d+,?', '', 'g'), '(?i)''client_id'':\s*\d+,?', '', 'g') as t from a),
w as (select doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) as w, generate_subscripts(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) as i from b),
c as (select doc_id, string_agg(case when w = cast(doc_id as varchar) then '' else w end, '' order by i) as t from w group by 1)
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ ', ''), ' $', '')) as cleaned from c""")
def clean_text(spark, sf_dir):
    """Every document; its own number goes where it is a word of its own."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id").cast("string")
    t = F.concat(F.lit("[CLIENT_"), number, F.lit("] client_id: "), number, F.lit(" \"client_id\": 12, 'client_id': 7 CLIENT_99x user "), number, F.lit(" "), F.col("text"), F.lit(" "), number, F.lit("."))
    return d.select("doc_id", F.md5(tx.clean_text(t, F.col("doc_id"))).alias("cleaned"))


LINES = """with l0 as (select doc_id as client_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
l as (select client_id, cast(pos % 3 as integer) as section, cast(pos as integer) as pos, line from l0 where trim(line) <> ''),
u as (select * from l qualify row_number() over (partition by client_id, lower(trim(line)) order by section, pos) = 1)"""


def _lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("client_id"), F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)
    return d.where(F.trim("line") != "").select("client_id", (F.col("pos") % 3).alias("section"), "pos", "line")


@query("section_dedup", LINES + " select client_id, section, pos, md5(line) as line from u")
def section_dedup(spark, sf_dir):
    return tx.deduplicated(_lines(spark, sf_dir)).withColumn("line", F.md5("line"))


@query("token_budget", LINES + r""", w as (select *, cast(sum(len(regexp_split_to_array(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '))) over (partition by client_id order by section, pos rows unbounded preceding) as bigint) as words_so_far from u)
select client_id, section, pos, words_so_far from w where words_so_far <= 200""")
def token_budget(spark, sf_dir):
    return tx.within_budget(tx.deduplicated(_lines(spark, sf_dir)), 200).select("client_id", "section", "pos", "words_so_far")


@query("sequence_truncate", """with c as (select doc_id, list_filter(list_transform(string_split(case when doc_id % 7 = 0 then ' </s> ' else replace(text, '. ', '</s>') end, '</s>'), lambda q: regexp_replace(q, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda q: q <> '') as c from documents)
select doc_id, md5(case when len(c) = 0 then 'No event sequence available for this client.' when len(c) > 5 then '... (truncated to last 5 events)' || chr(10) || array_to_string(c[len(c) - 4 : len(c)], '</s>') else array_to_string(c, '</s>') end) as tail from c""")
def sequence_truncate(spark, sf_dir):
    """Texts as sequences of sentences; every seventh has no event."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.when(F.col("doc_id") % 7 == 0, " </s> ").otherwise(F.replace("text", F.lit(". "), F.lit("</s>")))
    return d.select("doc_id", F.md5(tx.truncated_sequence(t, 5)).alias("tail"))


@query("portrait_clean", r"""with p as (select doc_id, case when doc_id % 5 = 0 then 'nothing of use' else 'Sure: ```python' || chr(10) || '- not this' || chr(10) || '```' || chr(10) || '- ' || replace(text, chr(10), chr(10) || ' - ') || chr(10) || '— FIN — more' || chr(10) || '- nor this' end as t from documents),
q as (select doc_id, list_filter(list_transform(string_split(split_part(regexp_replace(t, '```[\s\S]*?```', '', 'g'), '— FIN —', 1), chr(10)), lambda z: trim(z, ' ' || chr(9) || chr(13))), lambda z: starts_with(z, '- ')) as l from p)
select doc_id, md5(case when len(l) > 0 then array_to_string(l, chr(10)) else '- Behavioural signal too sparse to summarise.' end || chr(10) || '— FIN —') as portrait from q""")
def portrait_clean(spark, sf_dir):
    """Documents as what a generator might say; every fifth says nothing of use."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = F.concat(F.lit("Sure: ```python\n- not this\n```\n- "), F.replace("text", F.lit("\n"), F.lit("\n - ")), F.lit("\n— FIN — more\n- nor this"))
    return d.select("doc_id", F.md5(tx.clean_portrait(F.when(F.col("doc_id") % 5 == 0, "nothing of use").otherwise(said))).alias("portrait"))


@query("prompt_text", r"""with d as (select doc_id, '[PROFILE]' || chr(10) || text || '## PORTRAIT ##' || chr(10) || '- x' || chr(10) || '## RAW_SEQUENCE ##' || chr(10) || 'EVENT: a</s>EVENT: b' || chr(10) || '[END]' as t from documents),
s as (select doc_id, regexp_replace(split_part(t, '## PORTRAIT ##', 1), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') as t from d) select doc_id, md5(case when length(t) > 6000 then substr(t, 1, 6000) || chr(10) || '[TRUNCATED FOR MEMORY]' else t end) as prompt from s""")
def prompt_text(spark, sf_dir):
    """Texts as profiles, made ready for a prompt."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.concat(F.lit("[PROFILE]\n"), "text", F.lit("## PORTRAIT ##\n- x\n## RAW_SEQUENCE ##\nEVENT: a</s>EVENT: b\n[END]"))
    return d.select("doc_id", F.md5(tx.strip_sections(t)).alias("prompt"))


@query("text_numbers", "select doc_id, coalesce(try_cast(regexp_replace(substr(text, 1, 200), '[^0-9]', '', 'g') as bigint), 0) as digits, md5('Instruct: describe' || chr(10) || 'Query:' || text) as instruct from documents")
def text_numbers(spark, sf_dir):
    """The number that the digits at a text's beginning make, and an instruction with the text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", tx.digits(F.substring("text", 1, 200)).alias("digits"), F.md5(tx.instruct("describe", F.col("text"))).alias("instruct"))


# -- data sets ----------------------------------------------------------------------------
TEXTS = "with t as (select doc_id as client_id, text from documents where doc_id % 3 <> 0)"


def _texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("client_id"), "text").where("client_id % 3 <> 0")  # the relevant clients of the adapter


@query("fallback_fill", TEXTS + " select client_id, md5(text) as text, 'profile' as origin from t union all select doc_id, md5('## OVERVIEW ##' || chr(10) || 'No activity recorded.' || chr(10) || '[END]'), 'fallback' from documents where doc_id % 3 = 0")
def fallback_fill(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("client_id"))
    return dataset.with_fallbacks(_texts(spark, sf_dir), ids).withColumn("text", F.md5("text"))


@query("pad_to_n", TEXTS + ", m as (select count(*) as n, max(client_id) as top from t) select client_id, 'profile' as origin from t union all select top + unnest(range(1, 11)), 'artificial' from m")
def pad_to_n(spark, sf_dir):
    t = _texts(spark, sf_dir).withColumn("origin", F.lit("profile"))
    return dataset.padded_to(t, t.count() + 10).select("client_id", "origin")


@query("id_intersection", "select doc_id from documents intersect select doc_id from labels intersect select vec_id from embeddings")
def id_intersection(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return dataset.common_ids(read("documents"), read("labels"), read("embeddings").withColumnRenamed("vec_id", "doc_id"), key="doc_id")


@query("pending_ids", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_ids(spark, sf_dir):
    return dataset.without(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query("portrait_fusion", """with p as (select doc_id, case when quality = 1 then ' - good ' when toxic = 1 then ' - OOM (x)' when doc_id % 2 = 0 then '- ERR : y' else '- Portrait generation failed' end as portrait from labels),
d as (select doc_id, case when doc_id % 3 = 0 then text || chr(10) || '[END]' else text end as t from documents)
select d.doc_id as client_id, md5(case when portrait = ' - good ' then case when contains(t, '[END]') then replace(t, '[END]', chr(10) || '## PORTRAIT ##' || chr(10) || '- good' || chr(10) || '[END]') else t || chr(10) || '## PORTRAIT ##' || chr(10) || '- good' || chr(10) end else t end) as text from d left join p using (doc_id)""")
def portrait_fusion(spark, sf_dir):
    """Documents as profiles; those with a good label have a sound portrait, others one that failed."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    said = F.when(F.col("quality") == 1, " - good ").when(F.col("toxic") == 1, " - OOM (x)").when(F.col("doc_id") % 2 == 0, "- ERR : y").otherwise("- Portrait generation failed")
    portraits = labels.select(F.col("doc_id").alias("client_id"), said.alias("portrait"))
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("client_id"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n[END]"))).otherwise(F.col("text")).alias("text"))
    return dataset.fuse_portraits(t, portraits).withColumn("text", F.md5("text"))


@query("dataset_integrity", "select count(*) as n_records, count(distinct doc_id) as n_keys, count(*) filter (trim(coalesce(text, '')) = '') as n_blank, cast(min(length(text)) as integer) as min_chars, cast(max(length(text)) as integer) as max_chars, round(avg(length(text)), 6) as mean_chars, round(quantile_cont(length(text), 0.5), 6) as median_chars from documents")
def dataset_integrity(spark, sf_dir):
    return dataset.integrity(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query("first_of_each", "select client_id, text from (select conv_id as client_id, text, row_number() over (partition by conv_id order by turn desc, text) as r from conversations) where r = 1")
def first_of_each(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("client_id"), (-F.col("turn")).alias("back"), "text")
    return dataset.first_of_each(c, "client_id", ["back", "text"]).select("client_id", "text")
