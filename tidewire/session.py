"""Session defaults, table access and staged intermediate tables."""

from __future__ import annotations

import atexit
import gc
import json
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids or hashes up to which a side is broadcast after it has been counted (about 16 bytes each).
BROADCAST_ROWS = 1_000_000


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "tidewire") -> SparkSession:
    """A session for one machine: tests, the bench and trials."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TIDEWIRE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.driver.extraJavaOptions", "-Dderby.system.home=/tmp/tidewire-derby")
        .config("spark.sql.warehouse.dir", "/tmp/tidewire-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application; Spark copies the archive to every executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tidewire-")) / "tidewire.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Timestamps without a zone are read as UTC ones."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on one machine, one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.environ.get("TIDEWIRE_SHARED_DIR", "/tmp/tidewire-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder, so that lineage ends there.

    A lost executor costs a re-read, never a result. drop() frees a table that no later
    plan reads; whatever is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewire/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small file of settings, written at once, without a job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def get_json(spark: SparkSession, path: str) -> dict | None:
    """What put_json wrote, or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    held = fs.open(at)
    try:
        return json.loads(bytes(held.readAllBytes()).decode())
    finally:
        held.close()


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows stay within limit; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


#: Rows of one key from which a join takes it out of the shuffle.
HOT_ROWS = 1_000_000


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """left join right on key, where right has a key once and one key may hold a large part of left.

    Keys of more than hot_rows rows, at most rows / hot_rows of them, are joined with a broadcast of
    their few rows of right, so that left's stay where they lie; the others are shuffled. rows: how
    many left has, if known; a left of no more than hot_rows rows isn't looked through.
    """
    if (left.count() if rows is None else rows) <= hot_rows:
        return left.join(right, key, how)
    hot = left.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    keys = [r[0] for r in hot.collect()]  # at most rows / hot_rows
    if not keys:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    few = F.broadcast(right.where(is_hot))
    return left.where(~is_hot).join(right, key, how).unionByName(left.where(is_hot).join(few, key, how))
