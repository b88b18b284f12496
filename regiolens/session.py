"""SparkSession helpers.

On a cluster the session is created by the platform; ``ensure_checkpoint_dir``
only reads ``spark.checkpoint.dir`` and sets a local folder when nothing is set
(local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.files.maxPartitionBytes": "128m",
    # report sections run as concurrent jobs; FAIR lets a long chain of small
    # model-fitting jobs (own pool) take free slots between the report's stages
    "spark.scheduler.mode": "FAIR",
}


_POOLS_XML = """<?xml version="1.0"?>
<allocations>
  <pool name="models"><schedulingMode>FIFO</schedulingMode><weight>10</weight><minShare>1</minShare></pool>
</allocations>
"""


def _pool_file() -> str:
    """FAIR pools: ``models`` (long chains of one-task model-fitting jobs) gets
    the first free slot; everything else shares the default pool."""
    path = os.path.join(tempfile.mkdtemp(prefix="regiolens-pools-"), "fairscheduler.xml")
    with open(path, "w") as f:
        f.write(_POOLS_XML)
    return path


def local_session(cpus: int | str = "*", app: str = "regiolens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.scheduler.allocation.file", _pool_file())
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="regiolens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back;
    ``paths`` collects what has been written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/regiolens-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a stored table (any file system Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``regiolens`` importable in the Python workers (pandas UDFs pickle
    references to its modules): zip the package once and ``addPyFile`` it,
    as ``--py-files`` would.  The zip is only read by the driver; Spark's file
    server distributes it to the executors."""
    import zipfile

    import regiolens

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(regiolens.__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="regiolens-pyfiles-"), "regiolens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
