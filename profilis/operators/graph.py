"""Graph measures on edge tables: PageRank, clustering, random walks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's spark.checkpoint.dir; a temporary one in local mode
    only, as a folder of one machine would be lost with it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="profilis-"))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A checkpoint dealt by keys (as it comes without any) that Spark knows to be dealt so; joins
    by these keys exchange only the other side. An adaptive plan would leave that unsaid, so
    this one job is planned without."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys) if keys else df)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def weighted_edges(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Without self-loops, weights of parallel edges added up."""
    return edges.where("src <> dst").groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, keys: tuple[str, ...] = (), every: int = 20, tolerance: float | None = None, digits: int = 6) -> DataFrame:
    """Weighted PageRank for all graphs (keys) at once.

    With a tolerance, rounds end once no graph's ranks moved further than that (Euclidean
    distance), else after a fixed number. Mass of nodes without out-edges is not dealt out
    again. Lineage is cut every few rounds, when the distance is looked at too. Links are dealt
    by source and nodes by themselves once, so that a round exchanges only what is sent.
    """
    k = list(keys)
    e = weighted_edges(edges, keys)
    total = e.groupBy(*k, "src").agg(F.sum("w").alias("out"))
    links = dealt(e.join(total, [*k, "src"]).select(*k, "src", "dst", (F.col("w") / F.col("out")).alias("p")), *k, "src")
    nodes = links.select(*k, F.col("src").alias("node")).union(links.select(*k, F.col("dst").alias("node"))).distinct()
    sizes = nodes.groupBy(*k).agg(F.count("*").alias("n"))
    nodes = dealt(nodes.join(sizes, k) if k else nodes.join(F.broadcast(sizes)), *k, "node")  # sizes of no keys: one row
    rank = nodes.select(*k, "node", "n", (F.lit(1.0) / F.col("n")).alias("rank"))
    for i in range(rounds):
        sent = links.join(rank.withColumnRenamed("node", "src"), [*k, "src"]).groupBy(*k, "dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        got = sent.withColumnRenamed("dst", "node")
        before = rank
        rank = nodes.join(got, [*k, "node"], "left").select(*k, "node", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % every == every - 1 and i < rounds - 1:
            rank = dealt(rank)
            if tolerance is not None:
                moved = rank.join(before.select(*k, "node", F.col("rank").alias("old")), [*k, "node"]).groupBy(*k).agg(F.sqrt(F.sum(F.pow(F.col("rank") - F.col("old"), 2))).alias("d"))
                if (moved.agg(F.max("d")).first()[0] or 0.0) <= tolerance:
                    break
    return rank.select(*k, "node", F.round("rank", digits).alias("pagerank"))


def clustering_coefficient(edges: DataFrame, keys: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Local clustering of each node of the undirected graph: triangles over pairs of neighbours.

    Edges point from the lesser to the greater degree, so that a hub starts few wedges: no node
    has more than about sqrt(2 * edges) edges that leave it.
    """
    k = list(keys)
    e = edges.where("src <> dst").select(*k, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = e.select(*k, F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy(*k, "node").agg(F.count("*").alias("degree"))
    of = lambda x: degree.select(*k, F.col("node").alias(x), F.col("degree").alias(f"d{x}"))
    near, far = F.struct("da", "a"), F.struct("db", "b")
    e = e.join(of("a"), [*k, "a"]).join(of("b"), [*k, "b"]).select(*k, F.when(near < far, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(near < far, F.col("b")).otherwise(F.col("a")).alias("b"))
    ab = e
    other = e.select(*k, "a", F.col("b").alias("c"))
    wedges = ab.join(other, [*k, "a"]).where("b < c")
    across = e.select(*k, F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    triangles = wedges.join(across, [*k, "b", "c"]).select(*k, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*k, "node").agg(F.count("*").alias("t"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    t = F.coalesce("t", F.lit(0))
    return degree.join(triangles, [*k, "node"], "left").select(*k, "node", "degree", t.alias("triangles"), F.round(F.when(pairs > 0, t / pairs).otherwise(0.0), digits).alias("clustering"))


#: Neighbours that a bucket of a node's share of chance holds, about.
BUCKET = 8


def random_walks(edges: DataFrame, per_node: int = 10, steps: int = 10, seed: int = 42) -> DataFrame:
    """Walks along weighted edges, chosen by a hash of walk and step, so that they repeat.

    Each node's neighbours share [0, 1) by weight. The share is cut into buckets of about
    BUCKET neighbours; a walk draws one number and meets only the neighbours of its bucket, so a
    step costs the same at a hub as anywhere else. All walks advance together.
    """
    e = weighted_edges(edges).select("src", "dst", F.col("w").cast("double").alias("w"))
    w = W.partitionBy("src")
    upto, total, k = F.sum("w").over(w.orderBy("dst").rowsBetween(W.unboundedPreceding, 0)), F.sum("w").over(w), F.count("*").over(w)
    last = F.row_number().over(w.orderBy("dst")) == k
    share = e.select("src", "dst", ((upto - F.col("w")) / total).alias("low"), F.when(last, 1.0).otherwise(upto / total).alias("high"), F.ceil(k / BUCKET).cast("int").alias("buckets"))
    share = share.withColumn("low", F.coalesce(F.lag("high").over(w.orderBy("dst")), F.lit(0.0)))
    sizes = cut(share.groupBy("src").agg(F.max("buckets").alias("buckets")))
    ends = F.sequence(F.floor(F.col("low") * F.col("buckets")).cast("int"), F.least(F.col("buckets") - 1, F.floor(F.col("high") * F.col("buckets")).cast("int")))
    share = cut(share.select(F.col("src").alias("node"), "dst", "low", "high", F.explode(ends).alias("bucket")))
    walks = sizes.select(F.col("src").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk")).select(F.col("node").alias("start"), "walk", F.array("node").alias("path"), "node")
    for step in range(steps - 1):
        u = F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        here = walks.join(sizes.withColumnRenamed("src", "node"), "node", "left").withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")).cast("int"))
        near = share.select(F.col("node").alias("at"), "dst", "low", "high", F.col("bucket").alias("b"))
        ahead = here.join(near, (F.col("node") == F.col("at")) & (F.col("bucket") == F.col("b")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")), "left")
        path = F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path"))
        walks = ahead.select("start", "walk", path.alias("path"), F.col("dst").alias("node"))
        if step % 4 == 3:
            walks = cut(walks)
    return walks.select("start", "walk", "path")


def walk_vectors(walks: DataFrame, dim: int = 32, seed: int = 42) -> DataFrame:
    """Word2Vec over walks: a vector per node. Vectors live on the driver while they are learned,
    so the graph is one of a bounded number of nodes (the most visited pages, and skus)."""
    from pyspark.ml.feature import Word2Vec

    words = walks.select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=dim, minCount=0, seed=seed, inputCol="path", outputCol="v", maxIter=2).fit(words)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vector"))
