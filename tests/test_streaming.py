"""Incremental CSV ingestion (S1 as a stream)."""

from __future__ import annotations

import os
import tempfile

from regiolens.streaming import daily_totals_stream, ingest
from regiolens.streaming.ingest import csv_stream

HEADER = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"


def _write(d, name, lines):
    with open(os.path.join(d, name), "w") as f:
        f.write(HEADER + "".join(lines))


def test_ingest_reads_each_file_once(spark):
    base = tempfile.mkdtemp(prefix="regiolens-stream-", dir="/tmp")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    _write(src, "a.csv", ["01-01-2025,Bihar,Patna,800001,1,2,3\n", "02-01-2025,Bihar,Gaya,823001,4,5,6\n"])
    ingest(spark, src, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    _write(src, "b.csv", ["03-01-2025,Bihar,Patna,800001,7,8,9\n"])
    ingest(spark, src, out, ck).awaitTermination()
    df = spark.read.parquet(out)
    assert df.count() == 3
    assert sorted(r.total_enrollment for r in df.collect()) == [6, 15, 24]


def test_daily_totals_stream_in_memory(spark):
    base = tempfile.mkdtemp(prefix="regiolens-stream-", dir="/tmp")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _write(src, "a.csv", ["01-01-2025,Bihar,Patna,800001,1,2,3\n", "01-01-2025,Bihar,Gaya,823001,4,5,6\n",
                          "10-01-2025,Bihar,Gaya,823001,1,1,1\n"])
    q = (daily_totals_stream(csv_stream(spark, src)).writeStream.format("memory").queryName("daily_totals_t")
         .outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    rows = {r.date.day: r.total_enrollment for r in spark.sql("SELECT * FROM daily_totals_t").collect()}
    assert rows == {1: 21, 10: 3}
