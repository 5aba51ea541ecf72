"""Session defaults: UTC, adaptive execution, and a shuffle width that a cluster overrides."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "chronolith", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if master:
        builder = builder.master(master)
    if shuffle_partitions or os.environ.get("CHRONOLITH_SHUFFLE"):
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.environ["CHRONOLITH_SHUFFLE"]))
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python operators find it wherever they run."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chronolith-")) / "chronolith.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"chronolith/{f.relative_to(root)}")
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
