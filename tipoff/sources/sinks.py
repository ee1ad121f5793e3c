"""Result and snapshot writers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tipoff.session import fresh_path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def publish(df: DataFrame, root: str) -> int:
    """Write the next snapshot of a table below ``root`` and return its version.

    Readers take the largest version with a success marker, so a failed write is never seen
    and the snapshot a job reads is never overwritten by it.
    """
    version = (latest_version(df.sparkSession, root) or 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return version


#: Manifests that are kept; a reader has as many writes to finish in.
KEPT_MANIFESTS = 3
MANIFEST = "manifest"


def publish_parts(df: DataFrame, root: str, column: str) -> int:
    """Write the parts of a table that ``df`` holds, one for each value of ``column``; the others stay.

    A manifest names the newest version of every part. It is written after the data, so a failed
    write is never seen and a repeated one takes the same version. Versions that no kept manifest
    names are removed: what a write or a read lists does not grow with the number of writes.
    """
    spark = df.sparkSession
    manifests = _manifests(spark, root)
    version = max(manifests, default=0) + 1
    df.write.mode("overwrite").partitionBy(column).parquet(f"{root}/version={version}")
    folders = _folders(spark, f"{root}/version={version}")
    parts = _parts(spark, root, max(manifests, default=0))
    parts |= {name.split("=", 1)[1]: version for name in folders if name.startswith(f"{column}=")}
    rows = spark.createDataFrame(sorted(parts.items()), "part string, version long").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{root}/{MANIFEST}/version={version}")
    kept = sorted([*manifests, version])[-KEPT_MANIFESTS:]
    old = [v for v in manifests if v not in kept]
    if old:
        named = {v for m in kept for v in (parts if m == version else _parts(spark, root, m)).values()}
        for m in old:
            for v in {*_parts(spark, root, m).values(), m} - named:
                _remove(spark, f"{root}/version={v}")
            _remove(spark, f"{root}/{MANIFEST}/version={m}")
    return version


def _manifests(spark: SparkSession, root: str) -> list[int]:
    """Versions of the complete manifests."""
    found = _folders(spark, f"{root}/{MANIFEST}")
    return sorted(int(name.split("=")[1]) for name, path in found.items() if is_complete(spark, path))


def _parts(spark: SparkSession, root: str, manifest: int) -> dict[str, int]:
    if not manifest:
        return {}
    return dict(spark.read.parquet(f"{root}/{MANIFEST}/version={manifest}").select("part", "version").collect())


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Names of the folders in a folder, with their paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(at) if fs.exists(at) else []
    return {s.getPath().getName(): s.getPath().toString() for s in found if s.isDirectory()}


def newest_parts(spark: SparkSession, root: str, column: str) -> dict[str, str]:
    """For each value of ``column`` the folder of its newest version, by the newest manifest."""
    parts = _parts(spark, root, max(_manifests(spark, root), default=0))
    return {part: f"{root}/version={version}/{column}={part}" for part, version in parts.items()}


def is_complete(spark: SparkSession, folder: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def latest_version(spark: SparkSession, root: str) -> int | None:
    versions = {name: path for name, path in _folders(spark, root).items() if name.startswith("version=")}
    return max((int(n.split("=")[1]) for n, path in versions.items() if is_complete(spark, path)), default=None)


def snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete snapshot, or None when nothing was published."""
    version = latest_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/version={version}")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def round_trip_csv(df: DataFrame) -> DataFrame:
    """``df`` after a write to and a read from CSV with its own schema."""
    path = write_csv(df, fresh_path(df.sparkSession, "csv"))
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
