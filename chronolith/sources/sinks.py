"""Sinks: appends, dynamic partition replacement, upserts by latest row, schema widening and JSON artifacts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def place(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (spark.checkpoint.dir); a local one only in local mode where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
    where = where or "file://" + tempfile.mkdtemp(prefix="chronolith-")
    return f"{where.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Rows dealt to all cores, in parts of ``rows`` at most, where a table's bytes make fewer splits than its work needs."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts)


def appended(df: DataFrame, split: str) -> DataFrame:
    """Rows appended in one write per value of a small column, read back."""
    path = place(df.sparkSession, "append")
    for row in df.select(split).distinct().collect():
        df.where(F.col(split) == row[0]).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def replaced(old: DataFrame, new: DataFrame, *partitions: str) -> DataFrame:
    """The old table after the partitions that ``new`` holds are replaced, atomically by partition."""
    spark, path = old.sparkSession, place(old.sparkSession, "replace")
    old.write.partitionBy(*partitions).parquet(path)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    return spark.read.parquet(path)


def latest(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The row of greatest ``order`` of each key."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__k", k).where("__k = 1").drop("__k")


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """A new version of the table with the rows of ``new`` in place of those of equal key and no later ``order``."""
    path = place(old.sparkSession, "upsert")
    latest(old.unionByName(new), keys, order).write.parquet(path)
    return old.sparkSession.read.schema(old.schema).parquet(path)


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the union of their columns."""
    return old.unionByName(new, allowMissingColumns=True)


def json_artifact(df: DataFrame) -> DataFrame:
    """Rows as JSON text written and read back with the same schema."""
    path = place(df.sparkSession, "artifact")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
