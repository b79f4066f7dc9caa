"""Assembling data sets of profiles: fusion with portraits, fallbacks, padding, tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from profilis.functions.stats import quantiles
from profilis.functions.text import END, MARKS, SECTIONS, clean_portrait, is_failure, portrait_error, stripped, truncated_sequence, word_hash
from profilis.runtime import small_batches

FALLBACK = "## OVERVIEW ##\nNo activity recorded.\n[END]"


def fuse_portraits(profiles: DataFrame, portraits: DataFrame, key: str = "client_id") -> DataFrame:
    """Profiles (key, text) with a portrait section where a client has a sound one."""
    good = portraits.where(~is_failure(F.col("portrait"))).select(key, "portrait")
    block = F.concat(F.lit("\n## PORTRAIT ##\n"), stripped(F.col("portrait")), F.lit("\n"))
    return profiles.join(good, key, "left").select(key, F.when(F.col("portrait").isNotNull(), before_end(F.col("text"), block)).otherwise(F.col("text")).alias("text"))


def before_end(text: Column, block: Column) -> Column:
    """A block before every end mark, or at the end of a text without one."""
    return F.when(F.contains(text, F.lit(END)), F.replace(text, F.lit(END), F.concat(block, F.lit(END)))).otherwise(F.concat(text, block))


def with_sequence_section(text: Column, raw: Column, most: int = 1000) -> Column:
    """A text without a raw sequence section gets one, fenced, before its end mark."""
    block = F.concat(F.lit("\n## RAW_SEQUENCE ##\n```\n"), truncated_sequence(raw, most), F.lit("\n```"))
    added = F.when(F.contains(text, F.lit(END)), before_end(text, F.concat(block, F.lit("\n")))).otherwise(F.concat(text, block))
    return F.when(F.contains(text, F.lit("## RAW_SEQUENCE ##")), text).otherwise(added)


def with_fallbacks(profiles: DataFrame, ids: DataFrame, text: str = FALLBACK, key: str = "client_id") -> DataFrame:
    """Every id once: its profile, or the fallback text."""
    missing = ids.select(key).distinct().join(profiles.select(key), key, "left_anti")
    return profiles.select(key, "text", F.lit("profile").alias("origin")).unionByName(missing.select(key, F.lit(text).alias("text"), F.lit("fallback").alias("origin")))


def padded_to(rows: DataFrame, n: int, key: str = "client_id", text: str = FALLBACK) -> DataFrame:
    """Exactly n rows: the n least keys, or ids after the greatest with the fallback text."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(key), F.lit(-1)).alias("top")).first()
    if size["n"] >= n:
        return rows.orderBy(key).limit(n)
    more = rows.sparkSession.range(1, n - size["n"] + 1).select((F.col("id") + size["top"]).alias(key), F.lit(text).alias("text"), F.lit("artificial").alias("origin"))
    return rows.unionByName(more)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by a total order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def common_ids(*frames: DataFrame, key: str) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.intersect(f.select(key))
    return out


def without(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def sampled(rows: DataFrame, key: str, one_in: int, most: int | None = None, seed: int = 42) -> DataFrame:
    """A sample that repeats: keys whose hash falls into one class of ``one_in``, and of these
    the ``most`` with the least hashes."""
    turn = word_hash(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    picked = rows.where(turn % one_in == 0)
    return picked if most is None else picked.orderBy(turn, key).limit(most)


def integrity(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Records, distinct keys, blanks and lengths of a data set."""
    n = F.length(text)
    (median,) = quantiles(rows.select(n.alias("n")), "n", [0.5])
    return rows.agg(
        F.count("*").alias("n_records"), F.countDistinct(key).alias("n_keys"), F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("n_blank"),
        F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.lit(median).cast("double"), 6).alias("median_chars"),
    )


def status_report(rows: DataFrame, text: str) -> DataFrame:
    """How many texts hold each section and each mark, and the lines from each section to the end of its text."""
    t = F.col(text)
    entry = lambda kind, name, mark: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(mark).alias("mark"))
    parts = [entry("section", s, f"## {s} ##") for s in SECTIONS] + [entry("mark", m, m) for m in [*MARKS.values(), END]]
    each = rows.select(t.alias("t"), F.explode(F.array(*parts)).alias("p")).select("p.*", F.position("p.mark", "t").alias("at"), "t")
    after = F.when(F.col("kind") == "section", F.length("t") - F.length(F.replace(F.substr("t", F.col("at")), F.lit("\n"), F.lit(""))) - F.col("at") + 1)
    return each.groupBy("kind", "name").agg(F.count_if(F.col("at") > 0).alias("n_with"), F.count("*").alias("n_texts"), F.sum(F.when(F.col("at") > 0, after)).alias("n_lines"))


# What stands for windows of time without events.
NO_RECENT, NO_MEDIUM, NO_OLD = "No recent activity.", "No medium-term activity.", "No historical activity."
#: Extractors whose lines aren't features of a record.
APART = ("overview", "co_pairs", "category_pairs", "cart_conversion", "recent", "medium", "historical")


def profile_records(profiles: DataFrame, clients: DataFrame, key: str = "client_id", n_features: int = 100, n_text: int = 500, n_raw: int = 1000) -> DataFrame:
    """status, profile (JSON with bounded previews), rich_text and json_str of each listed client.

    profiles: key, lines, segments, recent, medium, old, raw_sequence, rich_text; a client that
    has none gets the fixed record of clients without activity.
    """
    of = lambda name: F.slice(F.transform(F.filter("lines", lambda x: x["extractor"] == name), lambda x: x["line"]), 1, 5)
    features = F.transform(F.filter("lines", lambda x: ~x["extractor"].isin(*APART)), lambda x: F.struct(x["extractor"].alias("type"), x["line"].alias("value")))
    shown = F.filter("segments", lambda s: ~s.isin("buyers", "non_buyers"))
    cut = lambda c, default: F.substring(F.coalesce(c, F.lit(default)), 1, n_text)
    record = F.struct(
        F.col(key).alias("client_id"), F.struct(F.when(F.array_contains("segments", "buyers"), "buyer").otherwise("browser").alias("user_type"), shown.alias("segments")).alias("overview"), F.slice(features, 1, n_features).alias("features"),
        F.struct(of("co_pairs").alias("co_pairs"), of("category_pairs").alias("category_pairs"), of("cart_conversion").alias("cart_conversion")).alias("behavioral_metrics"),
        cut("recent", NO_RECENT).alias("recent_activity"), cut("medium", NO_MEDIUM).alias("medium_term_summary"), cut("old", NO_OLD).alias("historical_aggregates"), F.substring(F.coalesce("raw_sequence", F.lit("")), 1, n_raw).alias("raw_sequence"),
    )
    known = F.col("lines").isNotNull()
    none = failed_profile(F.col(key), F.lit("No activity"))
    rows = clients.select(key).join(profiles, key, "left").select(key, known.alias("__known"), "rich_text", record.alias("__record"))
    there = F.col("__known")
    whole = F.to_json(F.struct(F.col("__record").alias("profile"), F.col("rich_text")))
    return rows.select(
        key, F.when(there, "success").otherwise("no_data").alias("status"), F.when(there, F.to_json("__record")).otherwise(F.to_json(none)).alias("profile"),
        F.when(there, F.col("rich_text")).otherwise(no_activity_text(F.col(key))).alias("rich_text"), F.when(there, whole).otherwise(F.to_json(F.struct(none.alias("profile")))).alias("json_str"),
    )


def no_activity_text(key: Column) -> Column:
    return F.concat(F.lit("[CLIENT_"), key.cast("string"), F.lit("]\nNo activity data."))


def failed_profile(key: Column, error: Column) -> Column:
    return F.struct(key.alias("client_id"), F.substring(error, 1, 500).alias("error"))


def error_records(failures: DataFrame, key: str = "client_id", error: str = "error", whole_batch: bool = False) -> DataFrame:
    """Records of clients whose profile failed (key, error); of a failed batch only status and error are known."""
    e = F.col(error)
    if whole_batch:
        return failures.select(key, F.lit("batch_error").alias("status"), F.substring(e, 1, 500).alias("error"))
    own = failed_profile(F.col(key), e)
    return failures.select(key, F.lit("error").alias("status"), F.to_json(own).alias("profile"), F.concat(F.lit("ERROR: "), F.substring(e, 1, 200)).alias("rich_text"), F.to_json(own).alias("json_str"))


def variants(rows: DataFrame, text: str, augment: dict[str, Column]) -> DataFrame:
    """Each row with its augmented texts as further rows."""
    options = F.array(F.struct(F.lit("base").alias("variant"), F.col(text).alias("text")), *[F.struct(F.lit(k).alias("variant"), v.alias("text")) for k, v in augment.items()])
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.explode(options).alias("o")).select(*keep, "o.variant", "o.text")


def whitespace_tokens(texts: list[str]) -> list[list[int]]:
    """A stand-in tokenizer: a stable 31-bit hash of each word."""
    import zlib

    return [[zlib.crc32(w.encode()) & 0x7FFFFFFF for w in t.split()] for t in texts]


def tokenized(rows: DataFrame, key: str, text: str, tokenizer: Callable[[list[str]], list[list[int]]] = whitespace_tokens, limit: int = 2048) -> DataFrame:
    """input_ids of each text by a pluggable batch tokenizer, cut to the model's context.

    The limit is the context length of the consuming model, not of the table.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x[:limit] for x in tokenizer([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "input_ids"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, input_ids array<int>")


def padded_tokens(ids: Column, length: int, pad: int = 0) -> Column:
    """Tokens cut or filled to a length, with the attention mask."""
    n = F.least(F.size(ids), F.lit(length))
    return F.struct(F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n)).alias("attention_mask"))


def first_filled(*arrays: Column) -> Column:
    """The first array that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def encoded(rows: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """Vectors from a pluggable batch encoder; a batch that fails is tried row by row, and a
    row that fails gets a null vector and its error."""
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            errors: list[str | None] = [None] * len(texts)
            try:
                vectors: list[list[float] | None] = list(encoder(texts))
            except Exception:  # noqa: BLE001
                vectors = []
                for i, t in enumerate(texts):
                    try:
                        vectors.append(encoder([t])[0])
                    except Exception as e:  # noqa: BLE001
                        vectors.append(None)
                        errors[i] = str(e)
            vectors = [None if v is None else ([float(x) for x in v] + [0.0] * dim)[:dim] for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[key, "vector", "error"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>, error string")


def generated(rows: DataFrame, key: str, text: str, generator: Callable[[list[str]], list[str]]) -> DataFrame:
    """Portraits from a pluggable batch generator; a batch that lacks memory is tried in halves,
    and what fails becomes a text that says so."""
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            try:
                out = list(generator(texts))
            except MemoryError:  # half of it at a time may do
                out, step = [], max(1, len(texts) // 2)
                for i in range(0, len(texts), step):
                    try:
                        out += list(generator(texts[i : i + step]))
                    except Exception as e:  # noqa: BLE001
                        out += [f"- OOM ({type(e).__name__}) — FIN —"] * len(texts[i : i + step])
            except Exception as e:  # noqa: BLE001
                out = [f"- ERR : {str(e)[:50]} — FIN —"] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "portrait"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, portrait string")


def cleaned_portraits(raw: DataFrame, key: str = "client_id") -> DataFrame:
    """key, portrait and error of what a generator gave: a failure has no portrait, and where no
    bullet was said an error stands beside the default."""
    said = F.col("portrait")
    return raw.select(key, F.when(~is_failure(said), clean_portrait(said)).alias("portrait"), portrait_error(said).alias("error"))
