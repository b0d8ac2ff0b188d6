"""Search through the stored index against a scan."""

import random

from pyspark.sql import functions as F

from tallyweave.operators.search import SearchIndex


def test_index_equals_scan_and_reads_the_asked_runs_only(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "".join(rng.choice("abC dé") for _ in range(rng.randrange(0, 12)))]), f"INV-{rng.randrange(10**5)}") for i in range(500)]
    made = spark.createDataFrame(rows, "id long, vendor string, number string")
    fields = [F.col("vendor"), F.col("number"), F.col("id").cast("string")]
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.write(made.filter("id < 300"), "id", fields)
    index.write(made.filter("id >= 250"), "id", fields)
    for text in ("abc", " ABC ", "inv-1", "12", "a", "b c", "dé", "ca d", "499", "nothing here", "", "ccc", "v-9"):
        wanted = text.strip().lower()
        expected = sorted(i for i, v, n in rows if wanted in (v or "").lower() or wanted in n.lower() or wanted in str(i))
        assert sorted(r["id"] for r in index.find(made, "id", fields, text).collect()) == expected, text
    plan = index.keys("inv-1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [bucket" in plan
    assert "In(gram" in plan or "EqualTo(gram" in plan
