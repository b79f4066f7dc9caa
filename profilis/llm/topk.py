"""Exact top-k inner products of stated query rows against all rows.

Queries are packed into blocks and candidates into shards. Every pair of a lot of blocks
(at most about QUERY_BYTES, written once to the checkpoint folder) and an input partition of
candidates is one task, so neither side passes through the driver, nothing is shuffled by
a key and no key can be hot. A task multiplies each of its shards with each of its blocks;
a tile keeps its k best per query by partial selection, the tiles of a task merge at once,
and the tasks' lists merge in a tree of fan-in FAN.

Components become floor(scale * x). Products run in double precision where every sum is
below 2**53 (so exact) and in 64-bit integers otherwise.

Defined results: vectors that are null, empty or hold null or non-finite components, and
rows with a null id, take no part; only vectors of a same length are compared; rows that
repeat a query's id are not its candidates; of several query rows with one id the least
vector asks; candidates that repeat are candidates each; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import cut, parts, small_batches

QUERY_BYTES = 32 << 20
QUERIES, SHARD, FAN = 1024, 4096, 16
NOBODY = np.iinfo(np.int64).min


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def tile_best(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, shard_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x k, best first) of a tile; missing ones are NOBODY.

    shard_ids ascend, so that of equal scores the first column is the smaller id.
    """
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * shard.shape[1]
    if most < 2**53:
        found = (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    else:
        found = queries @ shard.T
    m = len(shard_ids)
    own = query_ids[:, None] == shard_ids[None]
    if most < 2**62 / max(m, 1):
        key = found * m + np.arange(m - 1, -1, -1)
        key[own] = NOBODY
        at = np.argpartition(key, m - k, axis=1)[:, m - k :] if m > k else np.repeat(np.arange(m)[None], len(key), 0)
        at = np.take_along_axis(at, np.argsort(-np.maximum(np.take_along_axis(key, at, 1), -(2**63 - 1)), axis=1, kind="stable"), 1)
    else:
        at = np.stack([np.lexsort((shard_ids, -row))[: k + 1] for row in np.where(own, NOBODY + 1, found)])
    scores, ids = np.take_along_axis(found, at, 1), shard_ids[at]
    gone = np.take_along_axis(own, at, 1)
    return _padded(np.where(gone, NOBODY, scores), np.where(gone, NOBODY, ids), k)


def _padded(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best first (missing last), cut or filled to k columns."""
    order = np.lexsort((ids, -np.maximum(scores, NOBODY + 1)), axis=1)
    scores, ids = np.take_along_axis(scores, order, 1)[:, :k], np.take_along_axis(ids, order, 1)[:, :k]
    short = k - scores.shape[1]
    if short > 0:
        fill = np.full((len(scores), short), NOBODY)
        scores, ids = np.concatenate([scores, fill], 1), np.concatenate([ids, fill], 1)
    return scores, ids


def merged(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    return _padded(np.concatenate([s for s, _ in lists], 1), np.concatenate([i for _, i in lists], 1), k)


PACKED = "pack bigint, length int, ids binary, vectors binary"
LISTS = "block bigint, node bigint, queries binary, scores binary, ids binary"


def _bytes_of(values: np.ndarray) -> bytes:
    """Whole numbers in the least of two, four or eight bytes each that holds all of them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(kind).tobytes()


def _numbers(raw: bytes, rows: int, length: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (rows * length)]
    return np.frombuffer(raw, kind).reshape(rows, length).astype(np.int64)


def _packer(most: int):
    """Rows (id, vector) as packs of at most ``most`` vectors of one length, ids ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def packs(d: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            i = 0
            while len(ids) - i >= least and i < len(ids):
                mine, rows = ids[i : i + most], vectors[i : i + most]
                order = np.argsort(mine, kind="stable")
                row = (number, d, mine[order].tobytes(), _bytes_of(rows[order]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["pack", "length", "ids", "vectors"])
                number += 1
                i += most
            if i < len(ids):
                waiting[d] = [(ids[i:], vectors[i:])]

        for batch in batches:
            have = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            own = batch.column(0).to_numpy()
            for d in np.unique(have).tolist():
                mine = np.flatnonzero(have == d)
                waiting.setdefault(d, []).append((own[mine], batch.column(1).take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), d)))
                if sum(len(i) for i, _ in waiting[d]) >= most:
                    yield from packs(d, most)
        for d in sorted(waiting):
            yield from packs(d, 1)

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows."""
    small_batches(vectors.sparkSession)
    whole = vectors.where(F.col(id_col).isNotNull() & _usable(vector_col)).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"), is_query.alias("q")
    )
    asked = whole.where("q").groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.coalesce(F.sum((F.size("v") + 1).cast("bigint") * 8), F.lit(0))).first()[0]
    lots = parts(int(size), QUERY_BYTES)
    blocks = cut(asked.repartition(lots, "id").mapInArrow(_packer(QUERIES), PACKED))
    shards = whole.select("id", "v").mapInArrow(_packer(SHARD), PACKED)
    nodes = shards.rdd.getNumPartitions()
    queries = blocks.select(F.col("pack").alias("block"), F.col("length").alias("q_length"), F.col("ids").alias("queries"), F.col("vectors").alias("q_vectors"))
    # blocks of the stated queries against shards: a task for each pair of their partitions; an
    # equal-length condition here would make it a shuffle by length, so the search skips the others
    tiles = shards.crossJoin(queries)
    return _merged_lists(tiles.mapInArrow(_searcher(k, lots), LISTS), nodes, k)


def _searcher(k: int, lots: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        asking: dict[int, bytes] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["length"] != r["q_length"]:
                    continue
                own, ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["queries"], np.int64)
                shard, asked = _numbers(r["vectors"], len(own), r["length"]), _numbers(r["q_vectors"], len(ids), r["length"])
                tile, b = tile_best(asked, ids, shard, own, k), r["block"]
                best[b] = merged([best[b], tile], k) if b in best else tile
                asking[b] = r["queries"]
        node = TaskContext.get().partitionId() // lots
        for b, (scores, found) in best.items():
            yield _listed(b, node, asking[b], scores, found)

    return search


def _merged_lists(lists: DataFrame, nodes: int, k: int) -> DataFrame:
    def tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asking = table["queries"][0].as_py()
        n = len(asking) // 8
        found = [(np.frombuffer(s, np.int64).reshape(n, k), np.frombuffer(i, np.int64).reshape(n, k)) for s, i in zip(table["scores"].to_pylist(), table["ids"].to_pylist(), strict=True)]
        return pa.Table.from_batches([_listed(key[0].as_py(), key[1].as_py(), asking, *merged(found, k))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, s, i in zip(batch["queries"].to_pylist(), batch["scores"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                scores, found = np.frombuffer(s, np.int64), np.frombuffer(i, np.int64)
                there = found != NOBODY
                names = np.repeat(np.frombuffer(q, np.int64), k)
                ranks = np.tile(np.arange(1, k + 1, dtype=np.int32), len(names) // k)
                yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (names, ranks, found, scores)], names=["query_id", "rank", "vec_id", "score"])

    while True:
        nodes = parts(nodes, FAN)
        above = F.expr(f"node div {FAN}") if nodes > 1 else F.lit(0).cast("bigint")
        lists = lists.withColumn("node", above).groupBy("block", "node").applyInArrow(tree, LISTS)
        if nodes == 1:
            return lists.mapInArrow(rows, "query_id bigint, rank int, vec_id bigint, score bigint")


def _listed(block: int, node: int, queries: bytes, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    values = (block, node, queries, np.ascontiguousarray(scores, np.int64).tobytes(), np.ascontiguousarray(ids, np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "node", "queries", "scores", "ids"])
