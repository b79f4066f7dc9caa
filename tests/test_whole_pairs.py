"""Pairs of all items of a session, and SQL that has no cap on them."""

from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

from profilis.conf import EngineConf
from profilis.operators import pairs, rendering
from profilis.plans import catalogue

START = datetime(2024, 1, 1)
#: Sessions of two clients as skus; more than 20 in one, and the pair met most often beyond the least 20.
SESSIONS = {1: [range(30), [*range(25), 28, 29], [28, 29, 40]], 2: [range(50), range(60, 100), [7]]}


def events(spark):
    rows = []
    for client, sessions in SESSIONS.items():
        for s, items in enumerate(sessions):
            rows += [(client, START + timedelta(days=5 * s, seconds=i), 1000 * s + i, "product_buy", int(item)) for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "client_id long, timestamp timestamp_ntz, event_id long, event_type string, sku long")


def counted(client, least):
    found = Counter(p for items in SESSIONS[client] for p in combinations(sorted(set(items)), 2))
    return {(client, *p, n) for p, n in found.items() if n >= least}


def test_pairs_of_all_items(spark):
    for least in (1, 2):
        found = pairs.session_pairs(events(spark), "sku", 1800, ("product_buy",), cap=None, least=least).groupBy("client_id", "i", "j").count().where(f"count >= {least}")
        assert {tuple(r) for r in found.collect()} == counted(1, least) | counted(2, least)
    # client 2 met no item twice, so that no pair of its large sessions is made where two are asked for
    assert pairs.session_pairs(events(spark), "sku", 1800, ("product_buy",), cap=None, least=2).where("client_id = 2").count() == 0


def test_lines_of_all_pairs(spark):
    lines = rendering.pair_lines(events(spark), "sku", ("product_buy",), "CO_PAIR", "SKU", "co_pairs", EngineConf(pair_items=None)).collect()
    assert [(r["client_id"], r["co_pairs"][0]) for r in lines] == [(1, "CO_PAIR:SKU_28~SKU_29 (3x)")]
    capped = rendering.pair_lines(events(spark), "sku", ("product_buy",), "CO_PAIR", "SKU", "co_pairs", EngineConf()).collect()
    assert capped[0]["co_pairs"][0] == "CO_PAIR:SKU_0~SKU_1 (2x)"


def test_wide_lines_have_no_cap_in_their_sql():
    assert "r <= 20" not in catalogue.ORACLES["profile_lines_wide"]


def test_reports_have_no_cap_in_their_sql():
    assert "r <= 20" not in catalogue.ORACLES["status_report"]


def test_graphs_of_all_skus(spark):
    """Without a list of skus the product graph of the report's profiles has all of them: 31 and 90 nodes."""
    tables = rendering.derived_tables(events(spark).selectExpr("*", "sku as category_id", "0 as price_bucket"))
    graphs = {r["client_id"]: r["product_graph"] for r in rendering.product_graph(events(spark), tables, EngineConf(pair_items=None)).collect()}
    assert {c: lines[0] for c, lines in graphs.items()} == {1: "Product exploration: 31 unique.", 2: "Product exploration: 90 unique."}
