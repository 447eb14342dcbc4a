"""What a task makes of its rows at once is bounded by bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from webgrain.functions import batches, bodies
from webgrain.operators import pages
from webgrain.sources import payloads


def test_parts():
    texts = ["x" * n for n in [10] * 500 + [3000, 0, 200_000] + [1000] * 50] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    made = list(batches.parts(iter([batch, batch.slice(0, 0)]), 10_000))
    assert [t for p in made for t in p.column("t").to_pylist()] == texts
    assert all(p.nbytes <= 20_000 or p.num_rows == 1 for p in made) and len(made) > 8


def test_operators_read_in_parts(spark, monkeypatch):
    """Every operator of texts hands out parts: a batch of many rows never becomes one of results."""
    monkeypatch.setattr(batches.parts, "__defaults__", (2000,))
    rows = spark.range(40).coalesce(1).select(F.col("id").alias("k"), F.lit("https://example.com/").alias("url"), F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 40), F.col("id").cast("string")).alias("html"))
    seen = pages.extracted(rows, "k", fields=["text"], deal=False).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in bs), "n long").collect()
    assert sum(r.n for r in seen) == 40
    raw = rows.select("k", F.encode("html", "UTF-16").alias("body"), F.lit("text/plain").alias("content_type"))
    got = {r.k: (r.text, r.decode_error) for r in payloads.decoded(raw).collect()}
    assert got == {r.k: (r.html, None) for r in rows.collect()}
    assert spark.conf.get(batches.BATCH) == "1000" and bodies.body("", "text/html", "")["error"]
