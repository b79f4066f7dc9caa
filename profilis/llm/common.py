"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from profilis.runtime import small_batches  # noqa: F401  (operators take it from here)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; where it is unset a temporary one
    is made in local mode (tests), and anything else is an error: a folder of one machine
    would be lost with it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="profilis-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one narrow aggregate, used to size blocks."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])


def crc_mod(column, n: int):
    """crc32 of the column's decimal text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def parts(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


#: Results a fold gathers before it stores them away.
FOLD = 64


def scanned(array: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Running fold: step(state, x) gives the next state and a result; all results that aren't null.

    An array that grew by one entry at a time would be copied as often as it has entries, so
    results are gathered by FOLD and the full lots stored away: near linear in the entries.
    """
    none = F.expr(f"cast(array() as array<{out_type}>)")
    lots = F.expr(f"cast(array() as array<array<{out_type}>>)")
    start = F.struct(state.alias("state"), none.alias("now"), lots.alias("lots"))

    def one(acc: Column, x: Column) -> Column:
        after, result = step(acc["state"], x)
        full = F.size(acc["now"]) >= FOLD
        now = F.when(full, none).otherwise(acc["now"])
        now = F.when(result.isNotNull(), F.concat(now, F.array(result))).otherwise(now)
        return F.struct(after.alias("state"), now.alias("now"), F.when(full, F.concat(acc["lots"], F.array(acc["now"]))).otherwise(acc["lots"]).alias("lots"))

    return F.aggregate(array, start, one, lambda acc: F.concat(F.flatten(acc["lots"]), acc["now"]))


#: Ids that may be broadcast: about 16 MB on a worker. Beyond it rows are shuffled.
BROADCAST_IDS = 1 << 20


def by_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join with a one-column frame of distinct ids, whose size is checked."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, column, how)
