"""Deleted interpolation: a word-pair language model over all training texts.

A token's probability mixes three maximum-likelihood estimates (pair, single word,
uniform) with weights that depend on how often the left neighbour was seen (buckets of
powers of two). The weights are learned by expectation-maximisation on a deleted tenth
of the training texts, whose own counts are taken out of the estimates there.

Texts are dealt into blocks of about BLOCK_BYTES by a hash. A block sends the sorted
hashes of its distinct words and pairs with their training counts, packed by hash range
(bucket); a bucket adds up what all blocks sent and answers each with the counts it asked
for. So a frequent word costs one entry per block, nothing is held whole anywhere, and
the answers (cut by a checkpoint) serve both the learning of weights and the scoring.

Hashes have 64 bits. Order two only: the distinct triples of a corpus are nearly as many
as its tokens, and shuffling them would take more disk than the pairs, texts and answers
together.

Defined results: null and empty texts consist of the end token alone; repeated rows count
and score once each; without training texts all counts are 0 and only the uniform
estimate is left; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import cut, parts, small_batches, text_bytes

BLOCK_BYTES = 7 << 20
#: One training text in DELETED serves the weights.
DELETED = 10
BUCKETS, STEPS = 24, 4  # context-frequency buckets; steps per octave in EM's statistics
START, END = b"\x01start", b"\x01end"  # never words: words have no control characters around them
LEAST = 1e-6  # of the uniform weight, so that every text has a probability
DEFAULT = (0.5, 0.4, 0.1)


# -- blocks ---------------------------------------------------------------------
class _Ids(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    """Tokens of some texts: word numbers, and the sorted hashes of words and pairs."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        ids = _Ids()
        start, end = ids[(START,)], ids[(END,)]  # keys no split word can equal
        flat: list[np.ndarray] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words = text.lower().split()
            row = np.empty(len(words) + 2, dtype=np.int64)
            row[0], row[-1] = start, end
            row[1:-1] = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
            flat.append(row)
            sizes[i] = len(words) + 1
        all_ids = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
        del flat
        last = np.cumsum(sizes + 1) - 1
        is_token, is_left = np.ones(len(all_ids), dtype=bool), np.ones(len(all_ids), dtype=bool)
        is_token[last - sizes], is_left[last] = False, False
        self.sizes, self.left, self.word = sizes, all_ids[is_left], all_ids[is_token]
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        del all_ids, is_token, is_left
        hashes = np.array([xxhash.xxh3_64_intdigest(w if isinstance(w, bytes) else b"\0" + w[0]) for w in ids], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.left, self.word, self.start = rank[self.left], rank[self.word], int(rank[start])
        n = len(order)
        codes, of = np.unique(self.left * n + self.word, return_inverse=True)
        pair_hashes = _mix(self.keys[codes // n] * np.uint64(0x9E3779B97F4A7C15) + self.keys[codes % n])
        order = np.argsort(pair_hashes)
        self.pair_keys = pair_hashes[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[of]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word (the start: each text) and each pair stands in training texts."""
        on = train[self.doc].astype(np.float64)
        words = np.bincount(self.word, on, len(self.keys))
        words[self.start] = train.sum()
        return words.astype(np.int64), np.bincount(self.pair, on, len(self.pair_keys)).astype(np.int64)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (column 2) as zstandard frames: they are shuffled twice."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        frames = [packer.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(frames, pa.binary()), batch.column(3)], names=["block", "id", "text", "train"])


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(x) for x in column.to_pylist()]


def _pack(values: np.ndarray) -> bytes:
    """Numbers as zstandard-compressed byte planes, of their differences if they are keys."""
    import zstandard

    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    else:
        values = values.astype(np.uint32)
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=np.uint64) if kind is np.uint64 else values.astype(np.int64)


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys, and the end."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _rows(names_kinds: str, rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split(" ") for x in names_kinds.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


ASKED = "bucket int, block int, kind int, keys binary, counts binary"
ANSWERED = "block int, kind int, bucket int, counts binary, deleted binary, sums_n bigint, sums_v bigint, sums_deleted_n bigint, sums_deleted_v bigint"


# -- weights ---------------------------------------------------------------------
@dataclass(frozen=True)
class Weights:
    """For each context bucket the weights of pair, word and uniform estimates."""

    by_bucket: np.ndarray

    @staticmethod
    def learned(bucket: np.ndarray, p: np.ndarray, times: np.ndarray, rounds: int = 60) -> Weights:
        """Expectation-maximisation; p: rows of the three estimates, seen ``times`` each."""
        out = np.tile(np.array(DEFAULT), (BUCKETS, 1))
        for b in np.unique(bucket).tolist():
            mine, n = p[bucket == b], times[bucket == b]
            w = np.array(DEFAULT)
            for _ in range(rounds):
                joint = mine * w
                w = (n[:, None] * joint / joint.sum(1, keepdims=True)).sum(0) / n.sum()
            out[b] = w
        out[:, 2] = np.maximum(out[:, 2], LEAST)
        return Weights(out / out.sum(1, keepdims=True))


def context_bucket(times: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the floor of log2."""
    return np.minimum(np.frexp(times.astype(np.float64))[1], BUCKETS - 1)


def log_ratio(p: np.ndarray) -> np.ndarray:
    """A probability in steps of log2; unseen is 1, above any real value."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(STEPS * np.log2(p)), 1).astype(np.int32)


# -- the model ---------------------------------------------------------------------
class Model:
    """Counts of a corpus as answers to its blocks, with totals and weights."""

    def __init__(self, docs: DataFrame, trains: Column, id_col: str, text_col: str):
        small_batches(docs.sparkSession)
        size = text_bytes(docs, text_col)
        blocks, deleted_blocks = parts(size, BLOCK_BYTES), parts(size // DELETED, BLOCK_BYTES)
        buckets = blocks
        turn = F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit(3))
        deleted = trains & (F.pmod(turn, F.lit(DELETED)) == 0)
        spread = F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit(5))
        block = F.when(deleted, F.pmod(spread, F.lit(deleted_blocks))).otherwise(deleted_blocks + F.pmod(spread, F.lit(blocks)))
        dealt = docs.select(block.cast("int").alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("train"))
        self.docs = dealt.mapInArrow(_squeezed, f"block int, id {docs.schema[id_col].dataType.simpleString()}, text binary, train boolean")
        self.deleted_blocks = deleted_blocks

        def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            block = Block(_texts(table["text"]))
            rows = []
            for kind, keys, counts in zip((1, 2), (block.keys, block.pair_keys), block.counts(table["train"].to_numpy().astype(bool)), strict=True):
                at = _ranges(keys, buckets)
                rows += [(b, key[0].as_py(), kind, _pack(keys[i:j]), _pack(counts[i:j])) for b, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if i < j]
            return _rows(ASKED, rows)

        def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            out: list[tuple] = []
            start = _start_key()
            for kind in (1, 2):
                rows = [r for r in table.to_pylist() if r["kind"] == kind]
                keys = [_unpack(r["keys"], np.uint64) for r in rows]
                if not rows:
                    continue
                known, of = np.unique(np.concatenate(keys), return_inverse=True)
                counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows])
                total = np.bincount(of, counts, len(known)).astype(np.int64)
                from_deleted = np.repeat(np.array([r["block"] < deleted_blocks for r in rows]), [len(k) for k in keys])
                gone = np.bincount(of, counts * from_deleted, len(known)).astype(np.int64)
                ends = np.cumsum([len(k) for k in keys])
                for r, k, e in zip(rows, keys, ends.tolist(), strict=True):
                    at = of[e - len(k) : e]
                    out.append((r["block"], kind, key[0].as_py(), _pack(total[at]), _pack(gone[at]) if r["block"] < deleted_blocks else None, None, None, None, None))
                if kind == 1:
                    word = known != start
                    out.append((-1, 1, key[0].as_py(), None, None, *(int(x) for x in (total[word].sum(), (total[word] > 0).sum(), gone[word].sum(), (total[word] > gone[word]).sum()))))
                    out += [(-2, 1, key[0].as_py(), None, None, int(t), 0, int(g), 0) for t, g in zip(total[~word], gone[~word], strict=True)]
            return _rows(ANSWERED, out)

        self.answers = cut(self.docs.groupBy("block").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED))
        sums = {r["block"]: r for r in self.answers.where("block < 0").groupBy("block").agg(*[F.sum(c).alias(c) for c in ("sums_n", "sums_v", "sums_deleted_n", "sums_deleted_v")]).collect()}
        words, starts = sums.get(-1), sums.get(-2)
        self.n, self.v = (words["sums_n"], words["sums_v"]) if words else (0, 0)
        self.texts, self.deleted_texts = (starts["sums_n"], starts["sums_deleted_n"]) if starts else (0, 0)
        self.rest_n, self.rest_v = (self.n - words["sums_deleted_n"], words["sums_deleted_v"]) if words else (0, 0)
        self.weights = self._learn()

    def _answered(self, docs: DataFrame, answers: DataFrame, of_block, schema: str) -> DataFrame:
        """of_block(ids, trains, block, counts, deleted counts) of each block, joined with its answers."""

        def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return pa.table({n: pa.array([], t) for n, t in zip(*_empty(schema), strict=True)})
            rows = sorted(right.select(["kind", "bucket", "counts", "deleted"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
            counts, gone = ([np.concatenate([_unpack(r[c], np.uint32) for r in rows if r["kind"] == k and r[c] is not None] or [np.zeros(0, np.int64)]) for k in (1, 2)] for c in ("counts", "deleted"))
            return of_block(left, Block(_texts(left["text"])), counts, gone)

        return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def _learn(self) -> Weights:
        rest_n, rest_v, texts = self.rest_n, self.rest_v, self.texts - self.deleted_texts
        schema = "bucket int, pair int, single int, times bigint"

        def of_block(left: pa.Table, block: Block, counts, gone) -> pa.Table:
            words, pairs = counts[0] - gone[0], counts[1] - gone[1]
            words[block.start] = texts
            p2, p1 = _estimates(block, words, pairs, rest_n)
            seen, times = np.unique(np.stack([context_bucket(words[block.left]), log_ratio(p2), log_ratio(p1)]), axis=1, return_counts=True)
            return pa.table({n: pa.array(v, t) for n, v, t in zip(("bucket", "pair", "single", "times"), (*seen.astype(np.int32), times), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)})

        mine = F.col("block") < self.deleted_blocks
        found = self._answered(self.docs.where(mine), self.answers.where(mine & (F.col("block") >= 0)), of_block, schema)
        # at most BUCKETS times the steps of two log ratios, however large the corpus
        rows = found.groupBy("bucket", "pair", "single").agg(F.sum("times").alias("times")).toPandas()
        p = np.stack([np.where(rows[c] <= 0, np.exp2(rows[c] / STEPS), 0.0) for c in ("pair", "single")] + [np.full(len(rows), 1 / (rest_v + 1))], 1)
        return Weights.learned(rows["bucket"].to_numpy(), p, rows["times"].to_numpy().astype(float))

    def score(self, id_type: str) -> DataFrame:
        n, v, texts, weights = self.n, self.v, self.texts, self.weights.by_bucket
        schema = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

        def of_block(left: pa.Table, block: Block, counts, gone) -> pa.Table:
            words, pairs = counts
            words[block.start] = texts
            p2, p1 = _estimates(block, words, pairs, n)
            w = weights[context_bucket(words[block.left])]
            p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)
            seen = words[block.word]
            of = lambda x: np.bincount(block.doc, x, len(block.sizes))
            values = [
                pa.array(~left["train"].to_numpy().astype(bool)), pa.array(block.sizes, pa.int64()), pa.array(of(seen > 0).astype(np.int64), pa.int64()),
                pa.array(np.full(len(block.sizes), n), pa.int64()), pa.array(of(np.log10((seen + 1) / (n + v + 1)))), pa.array(of(np.log10(p))),
            ]
            return pa.table([left["id"], *values], names=[x.split(" ")[0] for x in schema.split(", ")])

        return self._answered(self.docs, self.answers.where("block >= 0"), of_block, schema)


def _start_key() -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(b"\0" + START))


def _estimates(block: Block, words: np.ndarray, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of each token by its pair and alone."""
    return pairs[block.pair] / np.maximum(words[block.left], 1), words[block.word] / max(n, 1)


def _empty(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return [n for n, _ in fields], [kinds[k] for _, k in fields]


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: tokens, known tokens, add-one base score and the model's log10 probability."""
    model = Model(docs, trains, id_col, text_col)
    return model.score(docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
