"""Sinks. Tables are committed by Spark's own protocol; a staged write replaces its target only when it is complete."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def recover_table(spark: SparkSession, path: str) -> bool:
    """Put back the table that a replacement took aside, if it broke off before the new one was in place."""
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path.rstrip('/')}.replaced")
    if not fs.exists(aside):
        return False
    if fs.exists(target):
        fs.delete(aside, True)
        return False
    return fs.rename(aside, target)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write beside the target, take the old table aside, move the new one in, remove the old.

    A folder cannot be replaced in one step on every file system: between the two renames the path is absent, and no row
    is ever lost. A job that breaks off there leaves the old table aside; the next call, or recover_table(), puts it back.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    recover_table(spark, path)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(staged)
    fs, target = _fs(spark, path)
    _, source = _fs(spark, staged)
    _, aside = _fs(spark, f"{path.rstrip('/')}.replaced")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        recover_table(spark, path)
        raise OSError(f"could not move {staged} to {path}")
    if had:
        fs.delete(aside, True)


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_batch(df: DataFrame, batch: int, path: str, fmt: str = "parquet") -> None:
    """One micro-batch of a stream under its number: a batch that is run again after a failure replaces its own rows."""
    df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={batch}")


def write_requests(df: DataFrame, path: str) -> None:
    """Request lines as JSON, one file per chunk_no if there is such a column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("chunk_no") if "chunk_no" in df.columns else writer).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file, written beside its target and renamed."""
    fs, target = _fs(spark, path)
    _, staged = _fs(spark, path + ".staged")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(target, False)
    fs.rename(staged, target)


def write_summary(spark: SparkSession, path: str, values: dict) -> None:
    write_text(spark, path, json.dumps(values, indent=2, default=str, sort_keys=True))


def write_workbook(df: DataFrame, path: str) -> str:
    """A small table as a workbook where a writer for those is installed, else as one CSV file beside that name; returns
    the path written. Its rows go through the driver, as a workbook is one file."""
    pdf = text_columns(df).toPandas()
    try:
        pdf.to_excel(path, index=False)
        return path
    except ImportError:
        other = path.rsplit(".", 1)[0] + ".csv"
        write_text(df.sparkSession, other, pdf.to_csv(index=False))
        return other


def write_batches(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """JSON lines of each batch in a folder of its own; a batch written again replaces only itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).json(path)


def write_topics(path: str, summary: dict, **tables: DataFrame) -> None:
    """Tables of a topic model, each in a folder of its name, and the summary beside them; the summary comes last, so it is
    there only if the tables are."""
    for name, df in tables.items():
        replace_table(text_columns(df), f"{path.rstrip('/')}/{name}", "csv")
    write_summary(next(iter(tables.values())).sparkSession, f"{path.rstrip('/')}/summary.json", summary)


def text_columns(df: DataFrame, mark: str = " | ") -> DataFrame:
    """Array columns as joined text, for formats without arrays."""
    arrays = {n for n, t in df.dtypes if t.startswith("array<string>")}
    return df.select(*[F.array_join(F.col(f"`{c}`"), mark).alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns])
