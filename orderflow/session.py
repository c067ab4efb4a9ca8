"""A session with the settings the library is tuned for, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# Settings that matter for skewed keys and file sizes.  All are runtime settings, so
# apply() works on a session somebody else built; a value set there is kept.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle for the next step.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Order lines shrink to a few bytes each in a shuffle and take a kilobyte in an aggregation by
# product and order, so partitions are cut by shuffled bytes far below Spark's own 64 MB; there are
# enough of them to stay at that size however many lines come.
SETTINGS = BASE | {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    # The JVM never compiles a method of more than 8000 bytes of code, and cleaning all columns in one
    # stage is such a method; beyond that each operator's expressions are split into small ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Hand-over tables and states hold long texts that repeat; zstd leaves less of them.
    "spark.sql.parquet.compression.codec": "zstd",
}


def apply(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    """Set every setting of ``settings`` the session does not set itself, and no other of SETTINGS."""
    explicit = dict(spark.sparkContext.getConf().getAll())
    for key in SETTINGS.keys() - settings.keys() - explicit.keys():
        spark.conf.unset(key)
    for key, value in settings.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def build(app: str = "orderflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; keyword names use ``__`` for dots.

    One given its number of shuffle partitions begins with that many.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    given = {k.replace("__", "."): v for k, v in conf.items()}
    if "spark.sql.shuffle.partitions" in given:
        given = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": given["spark.sql.shuffle.partitions"]} | given
    for key, value in {**SETTINGS, **given}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, root: str | None = None) -> str:
    """The folder for tables that cut lineage, on storage that all executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, ``root`` (a table
    folder, shared by its nature) takes it.  Without both, only a local session may make a
    temporary folder of its own: on a cluster every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or root
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"orderflow-{application}-")


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system, for what no DataFrame call offers."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def delete_folder(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside one; none if it does not exist."""
    target, files = _file_system(spark, path)
    found = files.listStatus(target) if files.exists(target) else []
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def concurrently(spark: SparkSession, *jobs: Callable[[], T]) -> list[T]:
    """Run independent actions at once, so that the small ones fill idle executors."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(len(jobs), 1)) as pool:
        futures = [pool.submit(inherit(job)) for job in jobs]
        return [f.result() for f in futures]


class Stage:
    """Hand-off tables of one run in the shared folder.

    Writing a table and reading it back cuts the lineage on reliable storage, so a lost
    executor costs a re-read and not a recomputation, and gives Catalyst real sizes.
    """

    def __init__(self, spark: SparkSession, run: str | None = None, root: str | None = None):
        self.spark = spark
        self.root = f"{shared_folder(spark, root)}/_stage/{run or uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        # The schema is known, so reading back starts no job to infer it.
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def clear(self) -> None:
        """Delete this run's hand-off tables."""
        delete_folder(self.spark, self.root)
