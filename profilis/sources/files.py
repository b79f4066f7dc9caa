"""File sources and sinks beside Spark's own: JSON lines, id lists, vectors for submission."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines (plain, .gz or .zst; a glob is fine); blank and malformed lines are skipped.

    A limit holds for each file: a look at the beginnings of a few files.
    """
    read = lambda p: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(p)
    if limit is None:
        return read(path)
    system, where = _file_system(spark, path)
    found = sorted(f.getPath().toString() for top in system.globStatus(where) or [] for f in (system.listStatus(top.getPath()) if top.isDirectory() else [top]) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    out = read(path).limit(0)
    for f in found:
        out = out.unionByName(read(f).limit(limit))
    return out


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions of a table that ``write_versioned`` has written whole, in order."""
    system, where = _file_system(spark, root)
    if not system.exists(where):
        return []
    done = [f.getPath() for f in system.listStatus(where) if f.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_versioned(df: DataFrame, root: str) -> int:
    """Parquet as the next version of a table; earlier versions stay as they are. Returns the version."""
    spark = df.sparkSession
    version = max(versions(spark, root), default=0) + 1
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/v={version}")  # an unfinished try may be there
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, the last one by default."""
    known = versions(spark, root)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no version {version or ''} under {root}")
    return spark.read.parquet(f"{root}/v={version or known[-1]}")


def write_stats(df: DataFrame, path: str) -> None:
    """A table of a few rows, such as global statistics, as one plain JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str, schema) -> DataFrame:
    """The same with the types that it had."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_parquet(df: DataFrame, path: str, cluster_by: str | None = None) -> None:
    """Parquet with zstd; clustered by a key if given, so that its ranges prune on reading."""
    if cluster_by is not None:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_id_list(spark: SparkSession, path: str, column: str = "client_id") -> DataFrame:
    """Integer ids of a .npy file, read through Spark, so that any of its stores will do."""
    ids = np.load(io.BytesIO(_read_bytes(spark, path)), allow_pickle=False).astype(np.int64).ravel()
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({column: ids}))


def write_submission(df: DataFrame, folder: str, id_col: str, vector_col: str, name: str = "submission") -> None:
    """client_ids.npy (int64), embeddings.npy (float16), both in a zip, by ascending id.

    A sink for one consumer that takes one archive on the driver's disk; rows stream into the
    files, so that the driver holds one partition at a time.
    """
    from pathlib import Path

    rows = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    if n:
        ids = np.lib.format.open_memmap(where / "client_ids.npy", mode="w+", dtype=np.int64, shape=(n,))
        vectors = np.lib.format.open_memmap(where / "embeddings.npy", mode="w+", dtype=np.float16, shape=(n, dim))
        for k, r in enumerate(rows.orderBy("i").toLocalIterator(prefetchPartitions=True)):
            ids[k], vectors[k] = r[0], np.asarray(r[1], dtype=np.float16)
        ids.flush()
        vectors.flush()
        del ids, vectors
    else:
        np.save(where / "client_ids.npy", np.zeros(0, np.int64))
        np.save(where / "embeddings.npy", np.zeros((0, 0), np.float16))
    with zipfile.ZipFile(where / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for part in ("client_ids.npy", "embeddings.npy"):
            z.write(where / part, part)


def write_text_per_client(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Texts in folders by client."""
    df.select(F.col(id_col), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(id_col).text(path)
