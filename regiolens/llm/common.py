"""Helpers shared by the training-data operators.

Tables are only opened by Spark's readers (the input may lie in a store that
no local file call reaches).  Intermediate tables go to the shared folder of
``spark.checkpoint.dir``; they cut the lineage, so a lost executor re-reads
files instead of repeating the stages before.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolens.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)  # the Python workers import regiolens
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LEAN = {
    # a written table replaces its shuffle files: they go when the query ends, not when the driver happens to collect garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # rows can be megabytes: a batch on its way to Python holds a few of them, not a whole task's
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def lean_settings(spark: SparkSession) -> Iterator[None]:
    """Settings for queries that run once and end in a written table or a number;
    the session's own are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in LEAN}
    try:
        for k, v in LEAN.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def lean(operator):
    """``operator(docs, ...)``, which returns a stored table, under these settings."""
    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with lean_settings(docs.sparkSession):
            return operator(docs, *args, **kwargs)

    return run


class Scratch:
    """Written intermediate tables of one operator run, under one folder of the
    shared checkpoint directory.  ``drop`` removes a table that is done with."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/regiolens-llm/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def store(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with lean_settings(self.spark):
            df.write.options(**options).parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if name in self.paths:
            self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Hands freed memory back to the system.  Python workers are kept between tasks,
    several an executor, and each would go on holding what its largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def releasing(run: Callable) -> Callable:
    """``run(batches)`` of a ``mapInArrow``, which gives back memory when a task ends."""
    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def releasing_group(run: Callable) -> Callable:
    """``run(table)`` of an ``applyInArrow``, which gives back memory after each group."""
    @wraps(run)
    def group(t):
        try:
            return run(t)
        finally:
            give_back()

    return group


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (a null id counts as remainder 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod), F.lit(0))


def comma_sorted(labels) -> str:
    return ",".join(sorted(set(labels)))


_A, _Z = 65, 90
ASCII_LOWER = bytes(b + 32 if _A <= b <= _Z else b for b in range(256))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator, in place on a copy."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batches, text: int, limit: int = 1_000_000):
    """The batches in slices of about ``limit`` bytes of the column ``text``, so
    that what is worked out from the texts at one time is bounded."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
        for a, e in zip(cut, cut[1:], strict=False):
            yield b.slice(a, e - a)


def rows_of(batch):
    """The rows of a batch as dicts, one at a time (rows can be megabytes)."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


UNIT = "unit long, ids array<long>, texts array<string>"


def read_units(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, unit_bytes: int) -> DataFrame:
    """Rows of one scan in units of about ``unit_bytes`` of text, stored once, so
    that later passes meet the same texts under the same unit number."""
    from pyspark import TaskContext

    @releasing
    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "text", unit_bytes)):
            ids, texts = pa.array([b.column(0).to_pylist()]), pa.array([b.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), ids.cast(pa.list_(pa.int64())), texts], names=["unit", "ids", "texts"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # few, long rows: small row groups keep what a reader holds small
    return scratch.store("units", src.mapInArrow(run, UNIT), compression="zstd", **{"parquet.block.size": str(16 << 20)})


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clusters_of(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)`` with root the
    smallest node reached.  Alternating large-star / small-star rounds
    (pre-aggregated minima per node, written tables) until the edges are stars;
    the number of rounds grows with the logarithm of the longest path.  Nothing
    is collected but whether any node is left that is no star's."""
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    e = scratch.store("cc", edges.where(F.col("a") != F.col("b")).select(*pair(F.col("a"), F.col("b"))).distinct())

    def settled(df: DataFrame) -> bool:
        """Whether the edges are stars: every node points to one root, or is one."""
        ends = df.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")),
                                           F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("s"))
        per = ends.groupBy("s.x").agg(F.sum("s.out").alias("out"), F.max("s.in").alias("in"))
        return per.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()

    while not settled(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
                 .where("u > v"))
        large = scratch.store("cc_large", large)
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_min, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        e = scratch.store("cc", small)
    scratch.drop("cc_large")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
