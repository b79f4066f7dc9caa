"""What Python workers hold at once."""

from profilis.operators import dataset


def test_encoders_get_small_batches(spark):
    """By default a batch holds 10000 texts, however long they are."""
    rows = spark.range(2000).selectExpr("id", "repeat('x ', 50) as t").coalesce(1)
    sizes = {r["vector"][0] for r in dataset.encoded(rows, "id", "t", lambda texts: [[float(len(texts))]] * len(texts), 1).collect()}
    assert max(sizes) <= 512
