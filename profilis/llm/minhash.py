"""Near-duplicate documents: MinHash banding, verified links, connected components.

A document's set is its distinct five-word shingles as 64-bit hashes. Documents with
equal sets form a class, of which one speaks. Many universal hash minima make the
signature; classes that agree in a whole band of it share a bucket.

Links are found in two steps, so that a bucket of m classes never gives m * m rows:
1. each class is held against its bucket's least one: signatures first, then the full
   sets; verified links are joined to components;
2. in buckets that still hold more than one component, the classes outside the largest one
   are held against all others in tiles of at most 2 * CHUNK classes (signatures, then full
   sets), which give out a spanning forest only. Every pair of a bucket that lies in
   different components meets in some tile, so no link is lost.

The number of bands follows the threshold, so that a pair exactly at it shares no bucket
with a chance of MISS at most (25 bands of ROWS minima at 0.85, 37 at 0.80); a signature
rejects a true link with about the same chance.

Defined results: documents without words have empty sets, are linked with nothing and
stay; with fewer than five words the whole sequence is the only shingle; rows of one id
are one document; rows with a null id keep their n_shingles, have a null component and
aren't kept; repeated rows come out once each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import arrow_kind, by_ids, cut, small_batches
from profilis.llm.components import connected_components

SHINGLE = 5
ROWS = 5
#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 5e-7
#: Share of equal minima by which a pair may stay below the threshold: five standard deviations.
LOOSE = 0.16
CHUNK = 256
#: Bytes of full sets that a chunk may hold, about.
CHUNK_BYTES = 24 << 20
#: Bytes that a worker's kept token hashes may take, about.
CACHE_BYTES = 24 << 20
#: Words that are hashed at a time.
STEP = 100_000
PLACE = np.random.default_rng(6).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int) -> int:
    """Bands with which a pair at the threshold is missed with a chance of MISS at most."""
    same = min(percent / 100, 1 - 1e-9) ** ROWS
    return max(1, math.ceil(math.log(MISS) / math.log1p(-same)))


@cache
def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of n universal hash functions."""
    random = np.random.default_rng(5)
    return random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, n, dtype=np.uint32)


# -- sets and signatures -------------------------------------------------------------
class _Tokens(dict):
    """Hashes of words; emptied once its words and numbers take more than CACHE_BYTES."""

    held = 0

    def __missing__(self, token: bytes) -> int:
        import xxhash

        value = self[token] = xxhash.xxh3_64_intdigest(token)
        self.held += 200 + len(token)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.uint64)
        for i in range(0, len(words), STEP):
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            some = words[i : i + STEP]
            out[i : i + STEP] = np.fromiter(map(self.__getitem__, some), dtype=np.uint64, count=len(some))
        return out


_TOKENS = _Tokens()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = _TOKENS.of(words)
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out += hashes[i : len(words) - n + 1 + i] * PLACE[i]
    return np.unique(_mix(out))


def signature(found: np.ndarray, hashes: int) -> np.ndarray:
    """The minima of a non-empty set."""
    multiply, add = family(hashes)
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (multiply[:, None] * low[None, i : i + 2048] + add[:, None]).min(1), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bands = signatures.shape[1] // ROWS
    values = signatures.reshape(-1, bands, ROWS).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        keys = _mix((keys + values[:, :, i] + np.uint64(i)) * np.uint64(0xD1342543DE82EF95))
    return keys.view(np.int64)


def _prints(hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, keys, signs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found, hashes).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n", "key", "sign"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_signs(batch.column(2)))
            rows = np.repeat(np.arange(batch.num_rows), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["band", "id", "n"])


def _signs(column: pa.Array) -> np.ndarray:
    """Signatures of one or more rows, a row each."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint32).reshape(len(rows), -1)


def _least_alike(percent: int) -> int:
    """Equal minima that two sets at the threshold have but for a chance like MISS."""
    return math.ceil((percent / 100 - LOOSE) * ROWS * bands_for(percent))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "items"])


# -- verification -------------------------------------------------------------------
def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 columns in blocks."""
    size = [len(s) for s in sets]
    items, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(of) > 1
    column = np.cumsum(shared) - 1
    keep = shared[of]
    row, col = row[keep], column[of[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [a, a + 4096])
        block = np.zeros((len(sets), 4096), dtype=np.float32)
        block[row[i:j], col[i:j] - a] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _loosely(percent: int):
    least = _least_alike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signs(batch["sign_a"]) == _signs(batch["sign_b"])).sum(1) if batch.num_rows else np.zeros(0)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return run


def _exactly(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch[c].to_pylist()] for c in ("items_a", "items_b")]
            true = [linked(a, b, percent) for a, b in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(true, pa.bool_())) for c in (batch["a"], batch["b"])], names=["u", "v"])

    return run


def _tile(percent: int, id_type: pa.DataType):
    """Spanning links between different components among the classes of a tile."""
    least = _least_alike(percent)

    def run(table: pa.Table) -> pa.Table:
        ids, parts_of = table["id"].to_pylist(), table["component"].to_pylist()
        signs = _signs(table["sign"].combine_chunks())
        n, parts = len(ids), np.unique(np.array(parts_of, dtype=object).astype(str), return_inverse=True)[1]
        same = np.zeros((n, n), dtype=np.uint16)
        for k in range(signs.shape[1]):
            same += signs[:, k][:, None] == signs[:, k][None]
        i, j = np.nonzero(np.triu((same >= least) & (parts[:, None] != parts[None]), 1))
        out: list[tuple] = []
        if len(i):
            used = np.unique(np.concatenate([i, j]))
            at = np.searchsorted(used, np.arange(n))
            blobs = table["items"].take(pa.array(used)).to_pylist()
            sets = [np.frombuffer(b, np.uint64) for b in blobs]
            size = np.array([len(s) for s in sets])
            both = common_counts(sets)[at[i], at[j]]
            true = (both > 0) & (100 * both >= percent * (size[at[i]] + size[at[j]] - both))
            root = list(range(int(parts.max()) + 1))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(i[true].tolist(), j[true].tolist(), strict=True):
                x, y = find(int(parts[a])), find(int(parts[b]))
                if x != y:
                    root[x] = y
                    out.append((parts_of[a], parts_of[b]))
        return pa.table({"u": pa.array([o[0] for o in out], id_type), "v": pa.array([o[1] for o in out], id_type)})

    return run


# -- the operator --------------------------------------------------------------------
def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id and whether it is kept.

    Links: 100 * common >= percent * all shingles of both.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = cut(texts.mapInArrow(_prints(ROWS * bands_for(percent)), f"id {id_type}, n bigint, key binary, sign binary"))
    # one speaker for each class of equal sets; copies fold together before the shuffle
    classes = cut(prints.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sign").alias("sign")))
    bands = classes.select("id", "n", "sign").mapInArrow(_bands, f"band bigint, id {id_type}, n bigint")
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("least")).where("size > 1")
    members = cut(bands.join(buckets, "band").select("band", "id", "n", "size", F.col("least.id").alias("pivot"), F.col("least.n").alias("pivot_n")))
    signs = classes.select("id", "sign")
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    sides = lambda c: [signs.select(F.col("id").alias(x), F.col("sign").alias(f"sign_{x}")) for x in c]
    stars = members.where((F.col("id") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    left, right = sides("ab")
    likely = cut(stars.join(left, "a").join(right, "b").select("a", "b", "sign_a", "sign_b").mapInArrow(_loosely(percent), f"a {id_type}, b {id_type}"))
    # full sets of the classes that share a bucket with another
    wanted = members.select("id").distinct()
    sets = cut(by_ids(texts.where(F.col("id").isNotNull()), cut(wanted), "id", "left_semi").mapInArrow(_sets, f"id {id_type}, items binary"))
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}"))
    pairs = likely.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "items_a", "items_b")
    first = connected_components(pairs.mapInArrow(_exactly(percent), f"u {id_type}, v {id_type}"))
    second = connected_components(_between(members, first, signs, sets, percent, id_type))
    component = (
        classes.select("key", "id")
        .join(first, "id", "left")
        .select("key", F.coalesce("component", "id").alias("id"))
        .join(second, "id", "left")
        .select("key", F.coalesce("component", "id").alias("component"))
    )
    own = prints.select("id", "n", "key")
    found = own.where("n > 0").join(component, "key", "left").select("id", "n", "component")  # texts of null ids alone have no class
    alone = own.where("n = 0").select("id", "n", F.col("id").alias("component"))
    both = found.unionByName(alone)
    component = F.when(F.col("id").isNotNull(), F.col("component"))
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _between(members: DataFrame, first: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Links between components that share a bucket.

    A pair inside one component needs no look, so the classes outside a bucket's largest
    component are held against all others of the bucket, in tiles of a chunk against a chunk.
    """
    placed = members.where("size > 2").select("band", "id", "n").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut(placed)
    own = placed.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("items"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
    most = F.max(F.struct("c", "component", "items"))
    mixed = own.groupBy("band").agg(most.alias("most"), F.count("*").alias("parts"), F.sum("c").alias("all"), F.sum("items").alias("all_items"), F.sum("sum").alias("sum")).where("parts > 1")
    # buckets with the same members need one look
    once = mixed.groupBy("sum", "all").agg(F.min_by(F.struct("band", "most", "all_items"), "band").alias("b")).select("b.*", "all")
    lots = lambda rows, items: F.greatest(F.lit(1), F.ceil(rows / CHUNK), F.ceil(items * 8 / CHUNK_BYTES)).cast("int")
    once = once.select("band", F.col("most.component").alias("large"), lots(F.col("all") - F.col("most.c"), F.col("all_items") - F.col("most.items")).alias("few"), lots(F.col("most.c"), F.col("most.items")).alias("many"))
    dealt = placed.join(once, "band").withColumn("rest", F.col("component") != F.col("large"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("rest"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    # chunks of the rest are numbered first, those of the large component after them
    other = F.sequence(F.lit(0), F.col("few") - 1 + F.when(F.col("rest"), F.col("many")).otherwise(0))
    dealt = dealt.withColumn("chunk", F.when(F.col("rest"), F.col("chunk")).otherwise(F.col("chunk") + F.col("few"))).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    full = dealt.select("band", "low", "high", "id", "component").join(signs, "id").join(sets, "id").select("band", "low", "high", "id", "component", "sign", "items")
    return full.groupBy("band", "low", "high").applyInArrow(_tile(percent, arrow_kind(members, "id")), f"u {id_type}, v {id_type}")
