"""Texts, chance and records against plain Python versions with the same hashes."""

import hashlib
import json
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilis.conf import EngineConf
from profilis.functions import numbers, stats
from profilis.functions import text as tx
from profilis.functions.dates import recency_bucket
from profilis.operators import dataset, graph, rendering, sequence
from profilis.plans import rendering_queries
from profilis.sources import files
from tests.test_operators import T0, frame


def luck(*of):
    return int(hashlib.md5(":".join(map(str, of)).encode()).hexdigest()[:13], 16) / 16**13


def test_numbers_as_python_writes_them(spark):
    values = [0.25, 0.35, 2.5, 3.5, 0.05, 1.005, 0.125, -0.04, -2.5, 0.5, 99.995, 0.9999, 1e15 + 0.5, 0.0, 2.675, 1e-9, 123456789012.125] + [i / 32 for i in range(200)] + [i / 7 for i in range(200)]
    d = spark.createDataFrame([(x,) for x in values], "x double")
    x = F.col("x")
    for r in d.select("x", *[numbers.fixed(x, k).alias(str(k)) for k in range(4)], numbers.signed(x, 1).alias("s"), numbers.percent(x, 1).alias("p"), numbers.short(x, 2).alias("r")).collect():
        v = r["x"]
        assert list(r[1:]) == [f"{v:.{k}f}" for k in range(4)] + [f"{v:+.1f}", f"{v:.1%}", str(round(v, 2))]
    assert d.select(numbers.fixed(F.lit(None).cast("double"), 2)).first()[0] is None


def plain_noise(text, scale, *of):
    n = iter(range(10**6))

    def moved(m):
        i = next(n)
        if "_" in m[0] and any(c.isalpha() for c in m[0].split("_")[0]):
            return m[0]
        x = float(m[1])
        return f"{x + x * scale * (2 * luck(*of, i) - 1):.2f}"

    return re.sub(r"(?:[A-Z_]+_)?(\d+\.?\d*)", moved, text)


def plain_augment(text, key, seed=42, drop=0.4, mask=0.3, mask_share=0.15, noise=0.2, scale=0.05, reorder=0.1, block=3):
    """Section by section, as the augmentation is defined; chance by hash."""
    profile = re.match(r"(\[PROFILE\].*?)(?=## [A-Z0-9_]+ ##)", text, re.S)
    sections, header = ({"[PROFILE]": profile[1].strip()} if profile else {}), None
    for part in re.split(r"(^## [A-Z0-9_]+ ##\n)", text[profile.end() :] if profile else text, flags=re.M):
        if re.fullmatch(r"## [A-Z0-9_]+ ##\n", part):
            header = part.strip()
            sections[header] = ""
        elif header:
            sections[header] += part
    if "[END]" in text:
        sections["[END]"] = "[END]"
    out = ""
    for name in tx.AUGMENTED:
        at = lambda *what, name=name: luck(key, seed, name, *what)
        content = sections.get(name, "").strip()
        if not content and name not in ("[PROFILE]", "[END]"):
            continue
        if name not in ("[PROFILE]", "## OVERVIEW ##", "## RAW_SEQUENCE ##", "## PORTRAIT ##", "[END]") and at("drop") < drop:
            continue
        lines = content.split("\n")
        if name not in ("## RAW_SEQUENCE ##", "[PROFILE]", "[END]") and len(lines) > block and at("reorder") < reorder:
            n = len(lines) // block
            order = sorted(range(n), key=lambda b: at("order", b))
            lines = [x for b in order for x in lines[b * block : (b + 1) * block]] + lines[n * block :]
        content = "\n".join(lines)
        if name == "## RAW_SEQUENCE ##" and at("mask") < mask:
            events = [e.strip() for e in content.split("</s>") if e.strip()]
            content = "</s>".join("EVENT: [MASKED_EVENT]" if at("event", i) < mask_share else e for i, e in enumerate(events))
        if at("noise") < noise:
            content = plain_noise(content, scale, key, seed, name, "number")
        out += content if name == "[PROFILE]" else f"\n{content}" if name == "[END]" else f"\n{name}\n{content}"
    return re.sub(r"\n{3,}", "\n\n", out.strip())


def plain_drop(text, key, p=0.35, seed=42):
    lines = [x for x in text.split("\n") if x.strip()]
    kept = [x for i, x in enumerate(lines) if any(m in x for m in ("##", "[CLIENT_", "[END]", "— FIN —")) or luck(key, i, seed) > p]
    return "\n".join(kept if len(kept) >= 2 else lines[:2])


PROFILE = (
    "[PROFILE]\n## OVERVIEW ##\n[CLIENT_12]\nUser Type: buyer\nSeen 12.5 of 7\n[CHURN]\n## CHURN_PROPENSITY ##\nCHURN_RISK:HIGH\nPURCHASE_RECENCY:3d\nX:1.25\nY:_7 SKU_12 T_0-5s\nZ\nlast\n[TIME]\n## TEMPORAL ##\na 1\nb 2\nc 3\nd 4.\ne\nf\ng 0.50\n"
    "[SEQ]\n## SEQUENCE ##\nnot kept\n[MISC]\n## CUSTOM ##\nm 100 é\n\n## TARGET_WINDOW_14D ##\nw 20240101\n## PORTRAIT ##\n- likes 3 things\n— FIN —\n\n## RAW_SEQUENCE ##\n```\n<SESS_START></s>EVENT: a PRICE:[PRICE_5] 3</s> EVENT: b</s></s>EVENT: c 99</s><SESS_END>\n```\n[END]"
)


def test_augmentation_by_section_equals_a_plain_version(spark):
    texts = [PROFILE, "", "no sections 5", "## OVERVIEW ##\n1\n[END]", "[PROFILE] 7", PROFILE.replace("[PROFILE]\n", ""), "## OVERVIEW ##\nfirst 1\n## OVERVIEW ##\nsecond 2\n"]
    d = spark.createDataFrame([(k, i, t) for k in range(60) for i, t in enumerate(texts)], "k long, i int, t string")
    seen = set()
    for often in ({}, {"drop": 0.0, "mask": 1.0, "noise": 1.0, "reorder": 1.0, "mask_share": 0.5}):
        for r in d.select("k", "t", tx.augment_sections(F.col("t"), F.col("k"), **often).alias("a")).collect():
            assert r["a"] == plain_augment(r["t"], r["k"], **often), (r["k"], r["t"])
            seen.add(r["a"])
    assert len(seen) > 100 and any("[MASKED_EVENT]" in x for x in seen)


def test_dropped_lines_equal_a_plain_version(spark):
    texts = [PROFILE, "a\n\nb\n \nc", "", "one", "\n".join(map(str, range(50)))]
    d = spark.createDataFrame([(k, t) for k in range(40) for t in texts], "k long, t string")
    for p, seed in ((0.35, 42), (0.5, 1042), (1.0, 1)):
        for r in d.select("k", "t", tx.drop_lines(F.col("t"), F.col("k"), p, seed).alias("a")).collect():
            assert r["a"] == plain_drop(r["t"], r["k"], p, seed)


def plain_text(lines, key, limit, per_section, seed):
    by: dict[str, list[str]] = {}
    seen = set()
    order = list(dict.fromkeys(s for s, _ in lines))
    for s in order:
        for section, line in lines:
            if section == s and (n := line.strip(" ").lower()) not in seen:
                seen.add(n)
                by.setdefault(s, []).append(line)
    out = []
    for s in tx.SECTIONS:
        items = [y for x in by.get(s, [])[:per_section] for y in ([x, x] if any(m in x for m in ("CHURN_", "PROPENSITY", "**")) else [x])]
        if not items:
            continue
        if len(items) > 3 and seed is not None:
            rest = sorted(enumerate(items[2:]), key=lambda e: hashlib.md5(f"{key}:{seed}:{s}:{e[0]}".encode()).hexdigest())
            items = items[:2] + [x for _, x in rest]
        out += [tx.MARKS[s], f"## {s} ##", *items]
    total, kept = 0, []
    for x in out:
        total += len(x.split())
        if total > limit:
            break
        kept.append(x)
    return "\n".join([*kept, "[END]"])


def test_assembled_texts_equal_a_plain_version(spark):
    import random

    rng = random.Random(5)
    words = ["Hello there", " hello THERE", "CHURN_RISK:LOW", "** a", "PROPENSITY x y", "", "one two three", "  indented", "a\nb c"]
    rows = [(k, [(rng.choice([*tx.SECTIONS, "OTHER"]), rng.choice(words) + (f" {rng.randrange(6)}" if rng.random() < 0.8 else "")) for _ in range(rng.randrange(0, 70))]) for k in range(30)]
    d = spark.createDataFrame(rows, "k long, l array<struct<section:string,line:string>>")
    for limit, per_section, seed in ((4096, 10, 42), (40, 3, 7), (4096, 10, None)):
        for r in d.select("k", "l", tx.assembled(F.col("l"), F.col("k"), limit, per_section, seed).alias("t")).collect():
            assert r["t"] == plain_text([tuple(x) for x in r["l"]], r["k"], limit, per_section, seed)


def test_small_text_functions(spark):
    d = spark.range(1)
    get = lambda c: d.select(c).first()[0]
    assert get(tx.truncated_sequence(F.lit("a</s> b </s></s>c"), 2)) == "... (truncated to last 2 events)\nb</s>c"
    assert get(tx.truncated_sequence(F.lit("a</s>b"), 2)) == "a</s>b"
    assert get(tx.truncated_sequence(F.lit(" </s>"), 2)) == get(tx.truncated_sequence(F.lit(None).cast("string"), 2)) == "No event sequence available for this client."
    assert get(tx.clean_portrait(F.lit("x ```py\n- no\n``` \n - one\n- two \n— FIN —\n- three"))) == "- one\n- two\n— FIN —"
    assert get(tx.clean_portrait(F.lit("nothing"))) == "- Behavioural signal too sparse to summarise.\n— FIN —"
    assert get(tx.clean_text(F.lit("x CLIENT_7a 'client_id': 9, \"CLIENT_ID\": 3 client_id:  4  y 12, 120"), F.lit(12))) == "x a y , 120"
    assert get(tx.strip_sections(F.lit("a\n## PORTRAIT ##\nx\n## B ##\nc\n## RAW_SEQUENCE ##\ny</s>z\n[END]"))) == "a\n## B ##\nc"
    assert get(tx.strip_sections(F.lit("a\n## RAW_SEQUENCE ##\ny"), keep_raw=True)) == "a\n## RAW_SEQUENCE ##\ny"
    assert get(tx.strip_sections(F.lit("x" * 20), 5)) == "xxxxx\n[TRUNCATED FOR MEMORY]"
    assert get(tx.digits(F.lit("a1b2"))) == 12 and get(tx.digits(F.lit("none"))) == 0 and get(tx.digits(F.lit(None).cast("string"))) == 0
    assert get(tx.instruct("t", F.lit("q"))) == "Instruct: t\nQuery:q"
    assert [get(recency_bucket(F.lit(n))) for n in (3, 7, 30, 31)] == ["R_0-3d", "R_3-7d", "R_7-30d", "R_30+d"]


def test_fusion_and_back_fill(spark):
    profiles = spark.createDataFrame([(1, "a\n[END]"), (2, "b"), (3, "c[END]")], "client_id long, text string")
    portraits = spark.createDataFrame([(1, " - x "), (2, "- y"), (3, "- ERR : z")], "client_id long, portrait string")
    fused = {r["client_id"]: r["text"] for r in dataset.fuse_portraits(profiles, portraits).collect()}
    assert fused == {1: "a\n\n## PORTRAIT ##\n- x\n[END]", 2: "b\n## PORTRAIT ##\n- y\n", 3: "c[END]"}
    got = [r[0] for r in profiles.orderBy("client_id").select(dataset.with_sequence_section(F.col("text"), F.lit("e</s>f"))).collect()]
    assert got[0] == "a\n\n## RAW_SEQUENCE ##\n```\ne</s>f\n```\n[END]" and got[1] == "b\n## RAW_SEQUENCE ##\n```\ne</s>f\n```"
    again = spark.createDataFrame([("x ## RAW_SEQUENCE ## y",)], "t string").select(dataset.with_sequence_section(F.col("t"), F.lit("e"))).first()[0]
    assert again == "x ## RAW_SEQUENCE ## y"


def test_failing_generators_say_so(spark):
    def broken(texts):
        raise ValueError("x" * 80)

    def hungry(texts):
        if len(texts) > 2 or "c" in texts:
            raise MemoryError
        return [f"- {t}" for t in texts]

    t = spark.createDataFrame([(i, x) for i, x in enumerate("abcd")], "client_id long, text string").coalesce(1)
    assert {r["portrait"] for r in dataset.generated(t, "client_id", "text", broken).collect()} == {"- ERR : " + "x" * 50 + " — FIN —"}
    got = {r["client_id"]: r["portrait"] for r in dataset.generated(t, "client_id", "text", hungry).collect()}
    assert got == {0: "- a", 1: "- b", 2: "- OOM (MemoryError) — FIN —", 3: "- OOM (MemoryError) — FIN —"}
    assert all(tx_failed for (tx_failed,) in dataset.generated(t, "client_id", "text", broken).select(tx.is_failure(F.col("portrait"))).collect())


def test_records_of_failures(spark):
    f = spark.createDataFrame([(7, "e" * 600)], "client_id long, error string")
    r = dataset.error_records(f).first()
    assert r["status"] == "error" and r["rich_text"] == "ERROR: " + "e" * 200 and json.loads(r["profile"]) == json.loads(r["json_str"]) == {"client_id": 7, "error": "e" * 500}
    assert tuple(dataset.error_records(f, whole_batch=True).first()) == (7, "batch_error", "e" * 500)


def test_samples_and_texts_by_client(spark, tmp_path):
    ids = spark.range(2000).withColumnRenamed("id", "client_id")
    picked = {r[0] for r in dataset.sampled(ids, "client_id", 10).collect()}
    assert picked == {i for i in range(2000) if int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:13], 16) % 10 == 0}
    few = [r[0] for r in dataset.sampled(ids, "client_id", 10, most=5).collect()]
    assert sorted(few) == sorted(sorted(picked, key=lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:13], 16), i))[:5])
    files.write_text_per_client(spark.createDataFrame([(1, "a\nb"), (2, "c")], "client_id long, text string"), str(tmp_path / "t"), "client_id", "text")
    assert {r["client_id"]: r["value"] for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()} == {1: "a\nb\n", 2: "c\n"}


def test_stand_ins_give_the_values_they_promise(spark):
    """Tokens, vectors and portraits of texts against the plain stand-ins."""
    t = spark.createDataFrame([(1, PROFILE), (2, ""), (3, "x y x")], "client_id long, text string")
    texts = {r["client_id"]: r["text"] for r in t.collect()}
    for r in dataset.tokenized(t, "client_id", "text", limit=4).collect():
        assert r["input_ids"] == dataset.whitespace_tokens([texts[r["client_id"]]])[0][:4]
    for r in dataset.encoded(t, "client_id", "text", rendering_queries.hashed_vectors, 16).collect():
        assert r["vector"] == rendering_queries.hashed_vectors([texts[r["client_id"]]])[0] and r["error"] is None
    for r in dataset.generated(t, "client_id", "text", rendering_queries.first_lines).collect():
        assert r["portrait"] == rendering_queries.first_lines([texts[r["client_id"]]])[0]


def test_pagerank_stops_at_its_tolerance(spark):
    e = spark.createDataFrame([(i, (i * 7 + 1) % 11, 1 + i % 3) for i in range(11)] + [(i, (i + 1) % 11, 1) for i in range(11)], "src long, dst long, w long")
    rank = lambda **k: {r["node"]: r["pagerank"] for r in graph.pagerank(e, digits=12, **k).collect()}
    long, stopped = rank(rounds=60), rank(rounds=60, every=2, tolerance=1e-6)
    assert stopped != long and max(abs(long[n] - stopped[n]) for n in long) < 1e-5
    assert graph.pagerank(spark.createDataFrame([], "src long, dst long, w long"), tolerance=1e-6).count() == 0


def test_a_round_of_pagerank_exchanges_only_what_is_sent(spark):
    e = spark.createDataFrame([(i, (i * 7 + 1) % 50, 1) for i in range(50)], "src long, dst long, w long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.pagerank(e, rounds=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(dst") == 3 and "Exchange hashpartitioning(src" not in plan


@pytest.mark.parametrize("at_once", [100_000, 50])
def test_quantiles_are_exact(spark, monkeypatch, at_once):
    monkeypatch.setattr(stats, "AT_ONCE", at_once)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=3000), rng.integers(0, 9, 2000).astype(float), np.repeat(4.0, 500), np.concatenate([np.repeat(1.0, 900), rng.random(700)]), np.array([2.5]), np.zeros(0)):
        rows = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        got = stats.quantiles(rows, "x", [0.0, 0.25, 0.33, 0.5, 0.66, 1.0])
        assert got == (pytest.approx(np.quantile(values, [0.0, 0.25, 0.33, 0.5, 0.66, 1.0]).tolist()) if len(values) else [None] * 6)


def test_walks_leave_nodes_by_weight(spark):
    hub = [(0, i, i) for i in range(1, 41)]
    walks = graph.random_walks(spark.createDataFrame([*hub, *((b, a, 1) for a, b, _ in hub)], "src long, dst long, w long"), per_node=3000, steps=2).where("start = 0")
    got = {r["to"]: r["n"] for r in walks.select(F.col("path")[1].alias("to")).groupBy("to").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 3000 and set(got) <= set(range(1, 41))
    assert all(abs(got.get(i, 0) - 3000 * i / 820) < 6 * (3000 * i / 820) ** 0.5 + 3 for i in range(1, 41))
    again = graph.random_walks(spark.createDataFrame([*hub, *((b, a, 1) for a, b, _ in hub)], "src long, dst long, w long"), per_node=2, steps=7)
    one = sorted(map(str, again.collect()))
    assert one == sorted(map(str, again.collect())) and all(len(r["path"]) == 7 and all((0 in p) and p[0] != p[1] for p in zip(r["path"], r["path"][1:])) for r in again.collect())


def test_versions_limits_and_stats(spark, tmp_path):
    root = str(tmp_path / "t")
    assert files.versions(spark, root) == [] and [files.write_versioned(spark.range(n), root) for n in (3, 5)] == [1, 2]
    assert files.read_version(spark, root).count() == 5 and files.read_version(spark, root, 1).count() == 3 and files.versions(spark, root) == [1, 2]
    with pytest.raises(FileNotFoundError):
        files.read_version(spark, root, 7)
    for n in range(3):
        (tmp_path / f"f{n}.jsonl").write_text("".join(f'{{"a": {n * 10 + i}}}\n' for i in range(6)))
    assert sorted(r[0] for r in files.read_json_lines(spark, str(tmp_path / "f*.jsonl"), "a long", 2).collect()) == [0, 1, 10, 11, 20, 21]
    table = spark.createDataFrame([(1, 2.5, "x")], "n long, m double, s string")
    files.write_stats(table, str(tmp_path / "stats"))
    assert files.read_stats(spark, str(tmp_path / "stats"), table.schema).collect() == table.collect()


def test_clustering_through_a_hub(spark):
    import itertools

    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39, 2)] + [(5, 9)]
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    got = {r["node"]: (r["degree"], r["triangles"], r["clustering"]) for r in graph.clustering_coefficient(spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, w long")).collect()}
    for n, near in around.items():
        t = sum(b in around[a] for a, b in itertools.combinations(sorted(near), 2))
        pairs = len(near) * (len(near) - 1) / 2
        assert got[n] == (len(near), t, round(t / pairs, 6) if pairs else 0.0)


def test_raw_sequences_begin_with_their_first_kept_event(spark):
    rows = [(1, 0, "page_visit", 4), (1, 60, "add_to_cart", 5, 7, 9), (1, 90, "remove_from_cart", 5, 7, 9), (1, 9000, "search_query"), (2, 0, "product_buy")]
    e = frame(spark, rows).withColumn("query", F.when(F.col("event_type") == "search_query", "odd")).withColumn("url", F.when(F.col("event_type") == "page_visit", "http://x"))
    names = spark.createDataFrame([(5, [1.0, 2.0])], "sku long, name array<double>")
    quantiles = spark.createDataFrame([(5, "Q3")], "sku long, quantile string")
    conf = EngineConf(as_of=T0 + timedelta(days=40))
    got = {r["client_id"]: r["raw_sequence"].split("</s>") for r in sequence.raw_sequence_text(sequence.raw_sequence(e, conf, 3, names, quantiles)).collect()}
    assert got[1] == [
        "<SESS_START>", "EVENT: add_to_cart SKU:[SKU_5] CAT:[CAT_7] PRICE:[PRICE_9] NAME_EMB:[1 2] POP_Q:[Q3] AGE:[D_30-180] TOD:[Afternoon] DOW:[Weekday] TIME_DELTA:[T_SessionStart]",
        "EVENT: remove_from_cart SKU:[SKU_5] NAME_EMB:[1 2] POP_Q:[Q3] AGE:[D_30-180] TOD:[Afternoon] DOW:[Weekday] TIME_DELTA:[T_5-30s]", "<SESS_END>",
        "<SESS_START>", "EVENT: search_query QUERY_EMB:[InvalidFormat] POP_Q:[Q0] AGE:[D_30-180] TOD:[Afternoon] DOW:[Weekday] TIME_DELTA:[T_SessionStart]", "<SESS_END>",
    ]
    assert got[2][1].startswith("EVENT: product_buy POP_Q:[Q0]")
    whole = sequence.raw_sequence_text(sequence.raw_sequence(e, conf)).where("client_id = 1").first()["raw_sequence"].split("</s>")
    assert whole[1] == "EVENT: page_visit URL:[URL_http://x] AGE:[D_30-180] TOD:[Afternoon] DOW:[Weekday] TIME_DELTA:[T_SessionStart]" and "TIME_DELTA:[T_30s-2m]" in whole[2]


def test_lines_of_sparse_clients(spark):
    """Gates: one event, a few, none with a sku or a price; nothing is said where nothing is known."""
    rows = [(1, 0, "search_query")] + [(2, 86400 * i, "page_visit", 3, 4) for i in range(6)] + [(3, 0, "product_buy", 1, 2, 30), (3, 3600, "page_visit")]
    e = frame(spark, rows)
    conf = EngineConf(as_of=datetime(2024, 1, 31))
    tables = rendering.derived_tables(e, top_skus=spark.createDataFrame([(3,)], "sku long"))
    lines = {}
    for r in rendering.long_lines(rendering.profile_lines(rendering.client_facts(e, tables, conf), tables, conf)).orderBy("client_id", "pos").collect():
        lines.setdefault(r["client_id"], []).append((r["extractor"], r["line"]))
    one, two, three = ([x for _, x in lines[c]] for c in (1, 2, 3))
    assert {"Very limited activity", "No price data.", "CAT_PROPENSITY:NO_CATEGORY_EVENTS", "SKU_PROPENSITY:NO_SKU_EVENTS", "No top-SKU interactions", "Funnel Stage: Research", "Cart conversion: no cart activity", "No valid search queries found.", "User Type: browser"} <= set(one)
    assert not [x for n, x in lines[1] if n == "graph"] and "Sessions: 1" not in one
    assert "Product graph skipped (few events or no sku)." in two and "No price data." in two and "Single-category focus browse" in two and "CHURN_STATUS:NO_PURCHASE" in two and "H_cat:-0.0" in two
    assert "Top-SKU coverage:100%" in two and "Shallow browser (~1.0 pages/session)" in two and "Max Inactivity Gap: 1.0 days" in two
    assert {"Single-purchase buyer", "CHURN_RISK:HIGH", "POST_PURCHASE:BROWSING", "LTV_INDICATOR:30", "User Type: buyer", "  Purchases: 1 (direct or uncaptured cart add)", "RFM:20:1:30"} <= set(three)
    assert not any(x.startswith("AVG_PURCHASE_INTERVAL") for x in three) and all(x for v in lines.values() for _, x in v)


@pytest.mark.parametrize("compat", [False, True])
def test_day_labels(spark, compat):
    e = frame(spark, [(1, 86400 * (i + 3), "page_visit") for i in range(2)])  # Saturday and Sunday
    conf = EngineConf(compat_weekday=compat)
    lines = [r[0] for r in rendering.totals(e, conf).join(rendering.in_time(e, conf), "client_id").select(F.explode(rendering.as_array(rendering.temporal_lines(conf)))).collect()]
    assert ("Active days: Mon, Sun" in lines) if compat else ("Active days: Sat, Sun" in lines and "Weekend-dominant" in lines)
