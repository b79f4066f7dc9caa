"""Every query of the reference's own operators against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from profilis.operators import graph
from profilis.plans import catalogue, rendering_queries

DATA = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, found):
    keys = sorted(columns)
    return sorted((tuple(value(r[columns.index(k)]) for k in keys) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.fixture(scope="module", autouse=True)
def profiles_once():
    """Profiles take long to plan and many queries begin with them: here they are made once for each gap."""
    made, whole = {}, rendering_queries.profiles
    keep = ("segments", "recent", "medium", "old")

    def once(spark, sf_dir, gap=rendering_queries.USUAL, wanted=()):
        if (sf_dir, gap) not in made:
            made[sf_dir, gap] = graph.cut(whole(spark, sf_dir, gap, keep))
        return made[sf_dir, gap].select("client_id", "lines", *wanted)

    rendering_queries.profiles = once
    yield
    rendering_queries.profiles = whole


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_run_with_the_operators_own_sizes(spark):
    walks = catalogue.QUERIES["random_walks"](spark, DATA).collect()
    starts = {w["start"] for w in walks}
    assert len(walks) == 10 * len(starts) and max(w["path"].count(",") for w in walks) >= 9
    clusters = catalogue.QUERIES["sku_clusters"](spark, DATA)
    assert clusters.select([c for c in clusters.columns if "cluster" in c][0]).distinct().count() > 20
