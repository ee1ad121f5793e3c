"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def build_session(name: str = "tipoff", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Feature tables are wide. A generated method above this size is never compiled by the
    # JVM; operators past it run as ordinary iterators instead, which is about 3x faster.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Window stages are heavy on CPU and light on bytes: let small shuffles keep all cores.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    # A Python worker holds a batch of texts several times over, as bytes, as strings and as results.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    # A task that writes the few parts of a table keeps a file open for each and does not sort its rows.
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    build = tempfile.mkdtemp(prefix="tipoff-ship-")
    copied = os.path.join(build, "src", "tipoff")
    shutil.copytree(package, copied, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(build, "tipoff"), "zip", os.path.dirname(copied))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tipoff-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs one file read, and lets several later
    reads of the same intermediate skip its shuffles and prune its columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_in_slices(df: DataFrame, label: str, key: str, slices: int = 4) -> DataFrame:
    """As ``staged``, in ``slices`` runs, each over the rows whose ``key`` hashes alike.

    For a wide table behind a join by ``key``: every run shuffles its own rows only, and what it
    shuffled goes before the next one starts. Rows without a key are in one of the runs.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    # not the hash that shuffles deal rows out by: a slice would fill only some of their partitions
    mine = F.pmod(F.xxhash64(key), F.lit(slices))
    for i in range(slices):
        df.where(mine == i).write.mode("append").parquet(path)
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def staged_in_parts(df: DataFrame, label: str, key: str, parts: int = 4) -> dict[str, DataFrame]:
    """As ``staged``, as ``parts`` tables by the folder of each, of the rows whose ``key`` hashes alike.

    One run writes all of them. Two tables of the same keys meet part by part, and a part can be
    removed when it has been read for the last time, see ``stored_by_parts``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    # not the hash that shuffles deal rows out by: a part would fill only some of their partitions
    mine = F.pmod(F.xxhash64(key), F.lit(parts))
    df.withColumn("_part", mine).write.partitionBy("_part").parquet(path, compression="zstd")
    folders = [f"{path}/_part={i}" for i in range(parts)]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).mkdirs(at)  # a part may have no rows
    _STAGED.setdefault(spark.sparkContext.applicationId, []).extend(folders)
    return {folder: spark.read.schema(df.schema).parquet(folder) for folder in folders}


def stored_by_parts(parts: Mapping[str, DataFrame], made: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """One stored table of what ``made`` gives for each part; a part goes when its rows are stored."""
    path, out = "", None
    for folder, part in parts.items():
        out = made(part)
        spark = out.sparkSession
        if not path:
            path = fresh_path(spark, label)
            _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
        out.write.mode("append").parquet(path)
        drop_staged(spark, [folder])
        free_shuffles(spark)
    return spark.read.schema(out.schema).parquet(path)


def staged_tables(spark: SparkSession) -> list[str]:
    """Folders of the tables that ``staged`` has written in this application and that are still there, oldest first."""
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def drop_staged(spark: SparkSession, paths: Iterable[str] | None = None) -> int:
    """Remove tables that ``staged`` has written, all of this application or only ``paths``.

    What was read from them must have been stored before. Folders that ``staged`` did not write
    are left alone. Returns how many tables went.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known = staged_tables(spark)
    wanted = set(known if paths is None else paths)
    going = [path for path in known if path in wanted]
    for path in going:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _STAGED[spark.sparkContext.applicationId] = [path for path in known if path not in wanted]
    return len(going)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove shuffle files that no DataFrame needs any more.

    It does so when the garbage collector of the driver finds them unused. In a chain of large
    steps that would come too late, so it is asked for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
