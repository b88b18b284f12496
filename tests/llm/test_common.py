from __future__ import annotations

import glob
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from regiolens.llm import jaccard_join as J
from regiolens.llm.common import LEAN, Scratch


def shuffle_files(spark):
    """Blocks of shuffles in the session's local folder (local mode: below the temp folder)."""
    top = spark.sparkContext.getConf().get("spark.local.dir", None) or tempfile.gettempdir()
    return set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data"))


def test_stored_tables_leave_no_shuffle_files(spark):
    before, settings = shuffle_files(spark), {k: spark.conf.get(k, None) for k in LEAN}
    scratch = Scratch(spark, "test")
    df = scratch.store("a", spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "k"))
    assert df.count() == 100 and sum(r["count"] for r in df.collect()) == 10_000
    scratch.store("b", spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count())
    # the counts above are the caller's own queries: one shuffle each at most
    assert len(shuffle_files(spark) - before) <= spark.sparkContext.defaultParallelism
    assert {k: spark.conf.get(k, None) for k in LEAN} == settings


def test_similar_components_leave_no_shuffle_files(spark):
    """Every step's shuffle files went with the step, whatever the rounds."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 40}x{j}" for j in range(60)) + f" end{i}") for i in range(120)], "doc_id long, text string")
    docs = docs.repartition(4)
    before, settings = shuffle_files(spark), {k: spark.conf.get(k, None) for k in LEAN}
    out = J.similar_components(docs)
    after = shuffle_files(spark) - before
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i % 40 for i in range(120)}
    assert not after and {k: spark.conf.get(k, None) for k in LEAN} == settings


def test_batches_of_long_rows_are_small(spark):
    """Rows of a megabyte reach Python a few at a time."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    got = [r.n for r in Scratch(spark, "test").store("n", long.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) == 40 and max(got) <= 10
