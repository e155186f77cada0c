"""How requests meet their documents."""

from datetime import datetime

from pyspark.sql import functions as F

from quotewright.operators import uploads

T0 = datetime(2024, 1, 1)


def test_requests_are_computed_once(spark):
    """What makes the requests, here a hash, is written and not in the plan again."""
    docs = spark.createDataFrame(
        [("d", 1, 0, "a.pdf", "text", T0)], "device_id string, upload_id bigint, pos int, filename string, text string, ts timestamp_ntz")
    asks = spark.createDataFrame([(1, "d", T0), (2, "", T0), (3, None, T0)], "request_id bigint, device_id string, ts timestamp_ntz")
    found = uploads.with_reference_text(asks.withColumn("tags", F.array(F.md5("device_id"))), docs, "s")
    assert "md5(" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.request_id: r for r in found.collect()}
    assert "text" in rows[1].reference_text and rows[1].tags[0] and rows[2].reference_text == rows[3].reference_text == ""
