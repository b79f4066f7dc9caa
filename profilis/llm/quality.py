"""Quality scores by compression: two zstandard dictionaries, one built from good and one
from bad labelled texts, compress each block of a text; the normalised difference of the
compressed sizes goes through a logistic calibration.

Labels are learned from a bounded sample of labelled rows, chosen by a hash of the id: of
DICTIONARY_DOCS texts a class at most DICTIONARY_BLOCKS blocks make a dictionary, and
CALIBRATION_DOCS texts are measured whole by the executors, which return numbers. Every text
is scored whole, in blocks of BLOCK bytes, so that a dictionary weighs the same anywhere in
a long text.

Defined results: null and empty texts have difference 0 and a mean compression, and get the
calibrated score of that; without labels of both classes the score is the share of good labels (0.5 without
any). A labelled id that occurs more than once counts once, with its smallest label and
its smallest text; every row is scored by itself, repeated ones alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilis.llm.common import crc_mod, cut, small_batches

#: Labelled texts a class from which a dictionary is built, and texts for the calibration.
DICTIONARY_DOCS, CALIBRATION_DOCS = 800, 3000
DICTIONARY_BYTES, BLOCK, LEVEL = 1 << 16, 2048, 3
#: Blocks a class, from anywhere in its texts, that come to the driver: 16 MB.
DICTIONARY_BLOCKS = 1 << 13
#: Bytes at which a text counts as half short.
SHORT = 200


@dataclass(frozen=True)
class QualityModel:
    """Bounded by two dictionaries of DICTIONARY_BYTES."""

    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    offset: float
    mean: float

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """For each text the normalised difference, the log of its compression, and its bytes."""
        out = np.tile([0.0, self.mean, 0.0], (len(texts), 1))
        if not self.bad or not self.good:
            return out
        import zstandard

        sides = []
        for raw in (self.bad, self.good):
            shared = zstandard.ZstdCompressionDict(raw)
            shared.precompute_compress(level=LEVEL)
            sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False))
        as_bad, as_good = (s.compress for s in sides)
        for i, text in enumerate(texts):
            bad = good = size = 0
            for block in blocks(text):
                bad += len(as_bad(block))
                good += len(as_good(block))
                size += len(block)
            if size:
                out[i] = (bad - good) / (bad + good), np.log((bad + good) / (2 * size)), size
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logit = calibrated(self.measures(texts), self.mean) @ np.array(self.weights) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def calibrated(measures: np.ndarray, mean: float) -> np.ndarray:
    """What the calibration weighs: both measures, and both again in so far as a text is short,
    since a single shared line can fill a short text and then says little."""
    both, short = measures[:, :2] - [0.0, mean], 1 / (1 + measures[:, 2:] / SHORT)
    return np.concatenate([both, both * short, short], 1)


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def build_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: their plain bytes serve
        return b"".join(samples)[:DICTIONARY_BYTES]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the columns of x and an offset by Newton steps, with a slight pull of weights to 0."""
    design = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(design.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    pull = np.append(np.full(design.shape[1] - 1, 1e-3), 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(pull), design.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from labelled rows for which ``learnable`` (on the id column) holds."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    turn, part = F.xxhash64(id_col, F.lit(7)), F.pmod(F.xxhash64(id_col), F.lit(2))
    picked = None
    for which, n in ((F.col("label") == 0, DICTIONARY_DOCS), (F.col("label") == 1, DICTIONARY_DOCS), (None, CALIBRATION_DOCS)):
        rows = known.where((part == 0) & which) if which is not None else known.where(part == 1)
        rows = rows.orderBy(turn, id_col).limit(n).select(id_col, "label", part.alias("part"))
        picked = rows if picked is None else picked.unionByName(rows)
    picked = F.broadcast(picked)  # at most 2 * DICTIONARY_DOCS + CALIBRATION_DOCS rows
    found = cut(docs.select(id_col, text_col).join(picked, id_col).groupBy(id_col, "label", "part").agg(F.min(text_col).alias("text")).withColumnRenamed(id_col, "id"))
    model = QualityModel(*(_dictionary_of(found, k) for k in (0, 1)), (0.0,) * 5, 0.0, 0.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.measures(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x[:, i]) for i in range(3))], names=["label", "part", "a", "b", "n"])

    small_batches(docs.sparkSession)
    rows = found.select("text", "label", F.col("part").cast("int")).mapInArrow(measured, "label int, part int, a double, b double, n double").collect()
    held = sorted(r for r in rows if r["part"] == 1) or sorted(rows)
    if not held:
        return model
    y, x = np.array([r["label"] for r in held], dtype=float), np.array([r[2:] for r in held])
    mean = float(x[:, 1].mean())
    weights, offset = fit_logistic(calibrated(x, mean), y)
    return QualityModel(model.bad, model.good, tuple(weights.tolist()), offset, mean)


def _dictionary_of(found: DataFrame, label: int) -> bytes:
    """A dictionary from blocks of a class's texts, chosen by a hash of text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = blocks(text)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(raw), pa.string()), pa.array(range(len(raw)), pa.int64()), pa.array(raw, pa.binary())], names=["id", "n", "block"])

    mine = found.where((F.col("part") == 0) & (F.col("label") == label)).select(F.col("id").cast("string"), "text")
    some = mine.mapInArrow(run, "id string, n bigint, block binary").orderBy(F.xxhash64("id", "n"), "id", "n").limit(DICTIONARY_BLOCKS)
    return build_dictionary([bytes(r["block"]) for r in sorted(some.collect(), key=lambda r: (r["id"], r["n"]))])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: good likelier) and ``predicted``; no shuffle.

    keep: columns of docs to carry beside the id.
    """
    small_batches(docs.sparkSession)
    kept = [id_col, *[c for c in keep or [] if c != id_col]]
    picked = docs.select(*kept, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                names=[*kept, "score", "predicted"],
            )

    return picked.mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(column: Column) -> Column:
    return crc_mod(column, 3) == 1


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
