"""Portraits that failed don't look like results."""

from pyspark.sql import functions as F

from profilis.functions import text as tx
from profilis.operators import dataset

FIN = "\n— FIN —"


def test_failures_have_an_error_and_no_portrait(spark):
    said = {1: "- one\nx\n- two — FIN — more", 2: None, 3: "- ERR : ```out``` — FIN —", 4: " - OOM (MemoryError) — FIN —", 5: "nothing of use", 6: "- Portrait generation failed"}
    raw = spark.createDataFrame(list(said.items()), "client_id long, portrait string")
    got = {r["client_id"]: (r["portrait"], r["error"]) for r in dataset.cleaned_portraits(raw).collect()}
    assert got == {
        1: ("- one\n- two" + FIN, None), 2: (None, "nothing was generated"), 3: (None, "- ERR : ```out```"), 4: (None, "- OOM (MemoryError)"),
        5: ("- Behavioural signal too sparse to summarise." + FIN, "no bullet in what was generated"), 6: (None, "- Portrait generation failed"),
    }
    cleaned = {r["client_id"]: r["p"] for r in raw.select("client_id", tx.clean_portrait(F.col("portrait")).alias("p")).collect()}
    assert cleaned[2] is None and all(cleaned[i] == said[i] for i in (3, 4, 6))


def test_generators_that_give_nothing(spark):
    """A generator that skips a text, and one that breaks."""

    def skips(texts):
        return [None if t == "b" else f"- {t}" for t in texts]

    def broken(texts):
        raise ValueError("no model")

    t = spark.createDataFrame([(1, "a"), (2, "b")], "client_id long, text string").coalesce(1)
    run = lambda g: {r["client_id"]: (r["portrait"], r["error"]) for r in dataset.cleaned_portraits(dataset.generated(t, "client_id", "text", g)).collect()}
    assert run(skips) == {1: ("- a" + FIN, None), 2: (None, "nothing was generated")}
    assert run(broken) == dict.fromkeys((1, 2), (None, "- ERR : no model"))
