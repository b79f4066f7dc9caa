"""Registration of queries beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Events with product attributes as table x, from the star-schema tables.
X = """
with ev as (
  select user_id as client_id, ts as timestamp, event_id, k,
    case event_type when 'view' then 'page_visit' when 'click' then 'add_to_cart' when 'purchase' then 'product_buy' when 'error' then 'remove_from_cart' when 'signup' then 'search_query' end as event_type,
    case when event_type <> 'signup' then k end as sku,
    case when event_type = 'signup' then '[' || k || ' ' || (k * 7) % 100 || ']' end as query
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)
), pr as (
  select p_partkey as sku, cast(p_size as bigint) as category_id, cast(cast(round((p_retailprice - 900) * 10) as integer) % 100 as bigint) as price_bucket, p_brand as brand from part
), x as (
  select ev.*, pr.category_id, pr.price_bucket, pr.brand from ev left join pr on ev.sku = pr.sku
)"""
NOW = "timestamp '2024-01-31 00:00:00'"
DAYS = "cast(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) as bigint)"


def days(a: str, b: str) -> str:
    return DAYS.format(a=a, b=b)


def sessions_sql(source: str = "x", gap: int = 1800, name: str = "s") -> str:
    """A table expression: source with session_id."""
    return f"""{name} as (
  select *, cast(sum(new) over (partition by client_id order by timestamp, event_id rows unbounded preceding) as bigint) as session_id
  from (select *, case when lag(timestamp) over w is null or floor((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1000000.0) > {gap} then 1 else 0 end as new
    from {source} window w as (partition by client_id order by timestamp, event_id))
)"""
