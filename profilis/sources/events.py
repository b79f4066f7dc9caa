"""Event sources: harmonised schemas, unions, product attributes, and the adapter from the
star-schema tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = {"client_id": "bigint", "timestamp": "timestamp_ntz", "event_type": "string", "sku": "bigint", "url": "string", "query": "string"}


def harmonised(df: DataFrame, event_type: str) -> DataFrame:
    """The target schema: a column passes, is cast (null where that fails) or is filled with null."""
    kinds = dict(df.dtypes)

    def column(name: str, kind: str) -> Column:
        if name == "event_type":
            return F.lit(event_type)
        if name not in kinds:
            return F.lit(None).cast(kind)
        return F.col(name) if kinds[name] == kind else F.expr(f"try_cast(`{name}` as {kind})")

    return df.select(*[column(n, k).alias(n) for n, k in TARGET.items()])


def union_sources(sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """UNION ALL of harmonised sources; missing ones (None) are skipped, none at all is an error."""
    out = None
    for event_type, df in sources.items():
        if df is not None:
            part = harmonised(df, event_type)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no event source is there")
    return out


def read_sources(spark: SparkSession, folder: str, event_types: list[str]) -> DataFrame:
    """Parquet files ``<event_type>.parquet`` of a folder; a missing file is tolerated."""

    def read(name: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(f"{folder}/{name}.parquet") if there else None

    return union_sources({t: read(t) for t in event_types})


def with_products(events: DataFrame, products: DataFrame) -> DataFrame:
    """Left join of product attributes (unique by sku); Spark broadcasts them by their size."""
    return events.join(products, "sku", "left")


# -- adapter ----------------------------------------------------------------------
TYPES = {"view": "page_visit", "click": "add_to_cart", "purchase": "product_buy", "error": "remove_from_cart", "signup": "search_query"}


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bucket = F.round((F.col("p_retailprice") - 900) * 10).cast("int") % 100
    return part.select(F.col("p_partkey").alias("sku"), F.col("p_size").cast("bigint").alias("category_id"), bucket.cast("bigint").alias("price_bucket"), F.col("p_brand").alias("brand"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with canonical types; k is the number that stands for products and pages."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return e.select("event_id", F.col("user_id").alias("client_id"), F.col("ts").alias("timestamp"), kind[F.col("event_type")].alias("event_type"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def client_events(spark: SparkSession, sf_dir: str, profile: str = "rich") -> DataFrame:
    """The canonical event table: client_id, timestamp, event_id, event_type, sku, query and
    product attributes. In profile ``strict`` page visits have no sku."""
    e = raw_events(spark, sf_dir)
    without = ["search_query"] + (["page_visit"] if profile == "strict" else [])
    sku = F.when(~F.col("event_type").isin(without), F.col("k"))
    query = F.when(F.col("event_type") == "search_query", F.concat(F.lit("["), F.col("k"), F.lit(" "), F.col("k") * 7 % 100, F.lit("]")))
    e = e.select("client_id", "timestamp", "event_id", "event_type", "k", sku.alias("sku"), query.alias("query"))
    return with_products(e, products(spark, sf_dir))


def with_urls(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds url for page visits: page k modulo the number of pages."""
    n = pages.agg(F.count("*").alias("n_pages"))
    numbered = events.join(F.broadcast(n)).withColumn("page_id", F.when(F.col("event_type") == "page_visit", F.col("k") % F.col("n_pages")))
    return numbered.join(pages.select("page_id", "url"), "page_id", "left").drop("page_id", "n_pages")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchases: a large event set."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("timestamp"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("sku"), F.col("l_linenumber").alias("line"))
    return o.join(lines, "o_orderkey").withColumn("event_type", F.lit("product_buy"))
