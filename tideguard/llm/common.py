"""Helpers shared by the training-data operators: shared storage, clashing names, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. On a local master a new one if that is unset; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = tempfile.mkdtemp(prefix="tideguard-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: made: the folders named so far in each scratch() block that this thread has open.
_SCRATCH = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_SCRATCH, "made", []):
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, every folder that was named within it. What the block keeps it writes elsewhere."""
    made: list[str] = []
    outer = getattr(_SCRATCH, "made", [])
    _SCRATCH.made = [*outer, made]
    try:
        yield
    finally:
        _SCRATCH.made = outer
        discard(spark, *made)


def stored(df: DataFrame, name: str, compression: str | None = None, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, *paths: str | DataFrame) -> None:
    """Remove folders, or what stored() wrote, once nothing reads them any more."""
    for path in paths:
        files, where = file_system(spark, path if isinstance(path, str) else path.stored_at)
        files.delete(where, True)


def rename_files(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give the files of a written folder another ending."""
    files, where = file_system(spark, path)
    for status in files.listStatus(where):
        at = status.getPath()
        if at.getName().endswith(old):
            files.rename(at, where.suffix("/" + at.getName().removesuffix(old) + new))


#: A key of at least one in so many rows is hot in a join, so there are no more hot keys than that.
HOT_SHARE, SALTS = 1_024, 64


def hot_keys(rows: DataFrame, key: str, n: int | None = None) -> list:
    """The keys of at least one in HOT_SHARE of the n rows (counted unless given), null left out; HOT_SHARE at most."""
    n = rows.count() if n is None else n
    found = rows.groupBy(key).count().where(F.col("count") * HOT_SHARE >= n).select(key).collect()
    return [r[0] for r in found if r[0] is not None]


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """rows joined with keyed, which has one row a key. The rows of hot keys (found unless given) stay where they are: the at most
    HOT_SHARE rows of keyed that they need are broadcast. rows should be stored, as they're read several times."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(keyed, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(keyed.where(is_hot)), key).unionByName(rows.where(~is_hot).join(keyed, key))


def salted_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], counts: DataFrame) -> DataFrame:
    """rows left-joined with keyed, which has one row a key, where both may be wide. Rows of hot keys are dealt over SALTS tasks,
    to each of which goes a copy of the key's row. counts has the first key and n, how many rows have it."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.groupBy(keys[0]).agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SHARE >= total).select(keys[0]).collect()  # HOT_SHARE at most
    hot = [r[0] for r in found if r[0] is not None]
    if not hot:
        return rows.join(keyed, list(keys), "left")
    is_hot = F.coalesce(F.col(keys[0]).isin(hot), F.lit(False))
    dealt = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = keyed.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "__salt"], "left").drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of df, less those that an output of one of these names replaces (case is ignored, as Spark does)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(col: str = "text") -> Column:
    """A text column as its UTF-8 bytes, null as none."""
    return F.coalesce(quoted(col).cast("string"), F.lit("")).cast("binary")


def extended(fields: Sequence[StructField], more: str) -> StructType:
    """A schema of fields and of those that a DDL string names."""
    return StructType([*fields, *StructType.fromDDL(more).fields])


def arrow_map(
    df: DataFrame,
    inputs: Sequence[Column],
    outputs: str,
    start: Callable[[], Callable[..., Sequence]],
    keep: Sequence[str],
) -> DataFrame:
    """Append computed columns, one Arrow batch at a time, without a shuffle.

    inputs are handed over as Python lists; outputs is a DDL string; start() runs once per task and returns
    the function of those lists that gives the output columns (lists or Arrow arrays). keep names the input
    columns that pass through; those named as an output are replaced.
    """
    new = StructType.fromDDL(outputs)
    kept = [c for c in keep if c in set(without(df, new.names))]
    held = [f"c{i}" for i in range(len(kept))]  # so that no name can clash
    plan = df.select(*[quoted(c).alias(h) for c, h in zip(kept, held)], *[x.alias(f"in{i}") for i, x in enumerate(inputs)])
    made = [f"out{i}" for i in range(len(new.names))]
    schema = StructType([*plan.schema.fields[: len(kept)], *[StructField(m, f.dataType, f.nullable) for m, f in zip(made, new.fields)]])
    n, width = len(kept), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        compute = start()
        for batch in batches:
            got = compute(*[batch.column(n + i).to_pylist() for i in range(width)])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*held, *made])

    found = plan.mapInArrow(run, schema)
    return found.select(*[F.col(h).alias(c) for c, h in zip([*kept, *new.names], [*held, *made])])
