"""Reading traffic tables, bounded or as streams, and writing alerts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def load_traffic(spark: SparkSession, path: str, fmt: str = "parquet", mapping: Mapping[str, str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """O1. Read a table of any Spark format; mapping gives output column -> SQL expression over the input's columns."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return mapped(reader.load(path), mapping)


def mapped(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    return df if mapping is None else df.select(*[F.expr(e).alias(name) for name, e in mapping.items()])


def stream_traffic(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, mapping: Mapping[str, str] | None = None, time_col: str = "ts", **options: str
) -> DataFrame:
    """O2. The same table as a stream of files. The schema is given, never inferred, and the time column becomes a
    timestamp, as watermarks need one; run streams with the session zone UTC."""
    if schema is None:
        raise ValueError("a stream needs a schema")
    df = mapped(spark.readStream.format(fmt).schema(schema).options(**options).load(path), mapping)
    return df.withColumn(time_col, F.col(time_col).cast("timestamp"))


def write_alerts(df: DataFrame, path: str, checkpoint: str | None = None, fmt: str = "parquet", partition_by: str | None = None) -> StreamingQuery | None:
    """O3. Append alerts to a table of files. A stream needs a checkpoint folder, runs over what is there, and is returned."""
    if not df.isStreaming:
        writer = df.write.format(fmt).mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).save(path)
        return None
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")
    stream = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (stream.partitionBy(partition_by) if partition_by else stream).start(path)


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in one, in any store; none if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()] if files.exists(where) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
