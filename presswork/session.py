"""Session settings, table access and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("presswork")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the plans made inside the block; it is put back afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per context, wherever they were started.

    A zip of its modules is put into the shared folder and added to the context; executors fetch it from there.
    """
    context = spark.sparkContext
    if getattr(context, "_presswork_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    path = f"{new_path(spark, 'package')}/{os.path.basename(root)}.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path)
    context._presswork_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; projections and filters put on it reach the parquet scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and driver and executors are one process (tests, local runs) a folder of our own is
    made and set; it goes when the process ends. On a cluster without the setting there is no folder to use.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        given = tempfile.mkdtemp(prefix="presswork-")
        atexit.register(shutil.rmtree, given, True)
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; release() removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/presswork-{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._presswork_paths = [*getattr(context, "_presswork_paths", []), *([] if label == "package" else [path])]
    return path


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Remove all intermediate tables written so far; frames built on them can no longer be read. Returns their number.

    Frames are lazy, so only the caller knows when a result has been read or stored.
    """
    context = spark.sparkContext
    paths, context._presswork_paths = getattr(context, "_presswork_paths", []), []
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder written by new_path/written, on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_cores() -> str:
    return os.environ.get("BENCH_CPUS", "8")
