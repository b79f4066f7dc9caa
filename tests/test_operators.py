"""Small hand-made frames: boundaries, ties, nulls, empty tables."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilis.conf import EngineConf
from profilis.functions import text as tx
from profilis.functions.dates import days_between
from profilis.operators import activity, dataset, graph, pairs, price, propensity, sequence, sessions, vectors
from profilis.sources import events as src
from profilis.sources import files
from profilis.streaming.sessions import stream_sessions, stream_type_counts

SCHEMA = "client_id long, timestamp timestamp_ntz, event_id long, event_type string, sku long, category_id long, price_bucket long, brand string, query string"
T0 = datetime(2024, 1, 10, 12)


def frame(spark, rows):
    full = []
    for i, r in enumerate(rows):
        client, seconds, kind, sku, cat, price_ = (*r, *[None] * (6 - len(r)))
        full.append((client, T0 + timedelta(seconds=seconds), i, kind, sku, cat, price_, None, None))
    return spark.createDataFrame(full, SCHEMA)


def test_session_gaps(spark):
    e = frame(spark, [(1, 0, "page_visit"), (1, 1799, "page_visit"), (1, 1799 + 1800, "page_visit"), (1, 3599 + 1800.5, "page_visit"), (1, 3599 + 1800.5 + 1801, "page_visit"), (2, 0, "page_visit")])
    got = [tuple(r) for r in sessions.sessionize(e).select("client_id", "event_id", "session_id").orderBy("event_id").collect()]
    assert [g[2] for g in got] == [1, 1, 1, 1, 2, 1]


def test_as_of_is_strict_and_takes_the_last(spark):
    e = frame(spark, [(1, 0, "add_to_cart", 5), (1, 60, "add_to_cart", 5), (1, 120, "product_buy", 5), (1, 120, "add_to_cart", 5), (1, 130, "product_buy", 6), (2, 10, "product_buy", 5), (2, 10, "add_to_cart", 5)])
    got = pairs.last_cart_before(e).collect()
    assert [(r["client_id"], r["sku"], r["minutes"]) for r in got] == [(1, 5, 1.0)]


def test_conversion_counts_all_ordered_pairs(spark):
    e = frame(spark, [(1, 0, "add_to_cart", 5), (1, 60, "add_to_cart", 5), (1, 120, "product_buy", 5), (1, 180, "product_buy", 5), (1, 0, "add_to_cart", 6)])
    r = pairs.cart_conversion(e).first()
    assert (r["carts"], r["converted"], r["pairs"], r["mean_minutes"]) == (3, 2, 4, 2.0)


def test_floor_days(spark):
    e = spark.createDataFrame([(T0, T0 + timedelta(hours=h)) for h in (23.99, 24, 335, 336)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in e.select(days_between(F.col("b"), F.col("a"))).collect()] == [0, 1, 13, 14]


def test_weekdays_and_compatible_labels(spark):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1 + i), i) for i in range(7)], "client_id long, timestamp timestamp_ntz, event_id long")
    right = {r["weekday"]: r["day"] for r in activity.weekday_activity(e).collect()}
    late = {r["weekday"]: r["day"] for r in activity.weekday_activity(e, EngineConf(compat_weekday=True)).collect()}
    assert right[1] == "Mon" and right[7] == "Sun" and late[1] == "Tue" and late[7] == "Mon"


def test_ping_pong_and_ngrams(spark):
    kinds = ["page_visit", "add_to_cart"] * 3
    e = frame(spark, [(1, i, k) for i, k in enumerate(kinds)] + [(2, 0, "page_visit"), (2, 1, "page_visit")])
    assert [tuple(r) for r in sequence.ping_pong(e).collect()] == [(1, 3)]
    got = sequence.event_ngrams(e, 3, 2).collect()
    assert [(r["gram"], r["n"]) for r in sorted(got, key=lambda r: r["rank"])] == [("add_to_cart -> page_visit -> add_to_cart", 2), ("page_visit -> add_to_cart -> page_visit", 2)]


def test_ties_take_the_least_id(spark):
    e = frame(spark, [(1, 0, "page_visit", 9, 4), (1, 1, "page_visit", 3, 7)])
    assert price.top_category(e).first()["category_id"] == 4
    assert propensity.top_scores(frame(spark, [(1, 0, "page_visit", 9), (1, 0, "page_visit", 3)]), "sku", 1).first()["sku"] == 3


def test_popularity_without_views(spark):
    e = frame(spark, [(1, 0, "add_to_cart", 1), (1, 1, "product_buy", 1), (1, 2, "add_to_cart", 2)])
    assert {r["sku"]: r["score"] for r in price.popularity(e, "sku").collect()} == {1: 12, 2: 2}
    assert {r["sku"]: r["score"] for r in price.popularity(e.unionByName(frame(spark, [(1, 3, "page_visit", 2)])), "sku").collect()} == {1: 13, 2: 4}


def test_empty_events(spark):
    e = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    for f in (activity.funnel_rates, sessions.session_profile, sequence.transition_matrix, pairs.last_cart_before, price.price_stats, propensity.churn_signals, propensity.category_propensity):
        assert f(e).count() == 0


def test_nulls_and_searches_only(spark):
    e = frame(spark, [(1, 0, "search_query"), (None, 5, "page_visit", 3)])
    assert {r["client_id"]: r["stage"] for r in activity.funnel_stage(e).collect()} == {1: "Research", None: "Awareness"}
    assert propensity.category_propensity(e).count() == 0


def test_harmonise(spark, tmp_path):
    a = spark.createDataFrame([("7", "2024-01-01 00:00:00", "5"), ("x", "bad", None)], "client_id string, timestamp string, sku string")
    got = src.union_sources({"product_buy": a, "page_visit": None}).collect()
    assert [(r["client_id"], r["timestamp"], r["sku"], r["url"]) for r in got] == [(7, datetime(2024, 1, 1), 5, None), (None, None, None, None)]
    with pytest.raises(FileNotFoundError):
        src.union_sources({"product_buy": None})
    a.write.parquet(str(tmp_path / "product_buy.parquet"))
    assert src.read_sources(spark, str(tmp_path), ["product_buy", "page_visit"]).count() == 2


def test_pagerank_mass(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (1, 1, 9)], "src long, dst long, w long")
    ranks = {r["node"]: r["pagerank"] for r in graph.pagerank(e).collect()}
    assert ranks == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 1 / 3}, abs=1e-5)
    c = graph.clustering_coefficient(e).collect()
    assert {r["clustering"] for r in c} == {1.0}


def test_random_walks_follow_edges(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src long, dst long, w long")
    assert sorted(r["path"] for r in graph.random_walks(e, 1, 4).collect()) == [[1, 2, 3], [2, 3]]


def test_vectors(spark):
    v = spark.createDataFrame([("[1 2, 3]",), ("[]",), ("[1 x]",), (None,)], "t string")
    assert [r[0] for r in v.select(vectors.parse_vector(F.col("t"))).collect()] == [[1.0, 2.0, 3.0], None, None, None]
    assert vectors.ensemble_weights({"a": [1.0], "b": [1.0]}) == pytest.approx({"a": 0.5, "b": 0.5})
    low = vectors.ensemble_weights({"a": [1.0], "b": [0.1]})
    assert low["b"] == pytest.approx(0.01) and sum(low.values()) == pytest.approx(1)
    one = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert one.select(vectors.mean_pooled(F.col("v"), F.col("m"))).first()[0] == [2.0, 3.0]
    assert one.select(vectors.fitted(F.array(F.lit(1.0)), 3)).first()[0] == [1.0, 0.0, 0.0]


def test_texts(spark):
    d = spark.createDataFrame([("a</s> b </s></s>c",), ("",)], "t string")
    assert [r[0] for r in d.select(tx.last_chunks(F.col("t"), 2)).collect()] == ["b</s>c", ""]
    end = spark.createDataFrame([("x\n[END]\ny[END]",), ("x",)], "t string")
    assert [r[0] for r in end.select(tx.insert_before_end(F.col("t"), F.lit("P"))).collect()] == ["x\n[END]\nyP\n[END]", "x\nP\n[END]"]
    lines = spark.createDataFrame([(1, "OVERVIEW", 1, "Hello"), (1, "TEMPORAL", 1, " hello "), (1, "CHURN_PROPENSITY", 1, "CHURN_RISK:LOW"), (1, "OTHER", 1, "gone")], "client_id long, section string, pos int, line string")
    assert tx.rich_text(lines).first()["rich_text"] == "## OVERVIEW ##\nHello\n## CHURN_PROPENSITY ##\nCHURN_RISK:LOW\nCHURN_RISK:LOW\n[END]"
    assert tx.within_budget(lines.where("section <> 'OTHER'"), 1).count() == 1
    assert d.select(tx.word_count(F.lit("  a  b\n")), tx.word_count(F.lit(" "))).first()[:] == (2, 0)
    assert d.select(*[tx.is_failure(F.lit(x)) for x in (" - OOM (x)", "- ERR : y", "\n- Portrait generation failed", "ok", "[ERROR] x")], tx.is_failure(F.lit(None).cast("string"))).first()[:] == (True, True, True, False, False, True)
    assert d.select(tx.clean_text(F.lit("[CLIENT_12] user 12 said  12 times"), F.lit(12))).first()[0] == "user said times"


def test_augmentation_repeats_and_keeps_headers(spark):
    t = "## OVERVIEW ##\nkeep\n" + "\n".join(f"line {i} v:{i}.50" for i in range(50)) + "\n[END]"
    d = spark.createDataFrame([(1, t), (2, t)], "k long, t string")
    one = [r[0] for r in d.select(tx.drop_lines(F.col("t"), F.col("k"))).collect()]
    two = [r[0] for r in d.select(tx.drop_lines(F.col("t"), F.col("k"))).collect()]
    assert one == two and one[0] != one[1] and all(x.startswith("## OVERVIEW ##\n") and x.endswith("[END]") for x in one)
    assert all("[END]" in r[0] for r in d.select(tx.augment_sections(F.col("t"), F.col("k"))).collect())


def test_padding_and_tokens(spark):
    t = spark.createDataFrame([(5, "a", "profile"), (9, "b", "profile")], "client_id long, text string, origin string")
    assert [r["client_id"] for r in dataset.padded_to(t, 4).orderBy("client_id").collect()] == [5, 9, 10, 11]
    assert [r["client_id"] for r in dataset.padded_to(t, 1).collect()] == [5]
    got = dataset.tokenized(t, "client_id", "text").select(dataset.padded_tokens(F.col("input_ids"), 3).alias("p")).first()["p"]
    assert len(got["input_ids"]) == 3 and got["attention_mask"] == [1, 0, 0]
    assert t.select(dataset.first_filled(F.array().cast("array<int>"), F.array(F.lit(3)))).first()[0] == [3]


def test_encoder_errors_stay_with_their_rows(spark):
    def failing(texts):
        if "b" in texts:
            raise ValueError("no b")
        return [[1.0] for _ in texts]

    t = spark.createDataFrame([(5, "a"), (9, "b")], "client_id long, text string").coalesce(1)
    got = {r["client_id"]: (r["vector"], r["error"]) for r in dataset.encoded(t, "client_id", "text", failing, 2).collect()}
    assert got == {5: ([1.0, 0.0], None), 9: (None, "no b")}


def test_files(spark, tmp_path):
    np.save(tmp_path / "ids.npy", np.array([3, 1, 2]))
    assert sorted(r[0] for r in files.read_id_list(spark, str(tmp_path / "ids.npy")).collect()) == [1, 2, 3]
    df = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "client_id long, v array<double>")
    files.write_submission(df, str(tmp_path / "out"), "client_id", "v")
    assert np.load(tmp_path / "out/client_ids.npy").tolist() == [1, 2]
    assert np.load(tmp_path / "out/embeddings.npy").dtype == np.float16
    files.write_json_lines(df, str(tmp_path / "j"))
    (tmp_path / "j" / "more.json").write_text("\nbad\n")
    assert files.read_json_lines(spark, str(tmp_path / "j"), "client_id long, v array<double>").where("client_id is not null").count() == 2
    import zstandard

    (tmp_path / "z.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"client_id": 4, "v": [1.5]}\n'))
    assert files.read_json_lines(spark, str(tmp_path / "z.jsonl.zst"), "client_id long, v array<double>").first()["client_id"] == 4
    files.write_parquet(df, str(tmp_path / "p"), "client_id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_streaming_sessions(spark, tmp_path):
    e = frame(spark, [(1, 0, "page_visit"), (1, 600, "page_visit"), (1, 9000, "product_buy")])
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for i, (f, mode) in enumerate(((stream_sessions, "append"), (stream_type_counts, "complete"))):
        q = f(stream).writeStream.outputMode(mode).format("memory").queryName(f"out{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("out1").agg(F.sum("n")).first()[0] == 3


def test_filters_reach_the_scan(spark, capsys):
    src.client_events(spark, "/root/testdata/sf0.001").where("client_id = 7").select("client_id", "event_type").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(user_id,7)" in plan and "value:double" not in plan
