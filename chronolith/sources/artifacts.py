"""A store of versioned artifacts: tables, models and their notes, that readers never see half written.

A version's data go to a folder of their own, and its manifest (place, schema, notes) is written
beside it under another name and renamed last. Readers take the manifest of the highest number, so
a writer that dies leaves nothing but an unnamed folder. Two writers can't take one number, as a
rename onto an existing file fails; the later one takes the next.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.operators.boosting import Member


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self, name: str) -> list[int]:
        return [int(n[9:-5]) for n in self._names(f"{self.base}/{name}") if n.startswith("manifest-") and n.endswith(".json")]

    def save(self, df: DataFrame, name: str, notes: dict[str, Any] | None = None) -> int:
        """Write a new version; its number is returned once readers see it."""
        folder, own = f"{self.base}/{name}", uuid.uuid4().hex
        df.write.parquet(f"{folder}/data-{own}")
        body = json.dumps({"data": f"data-{own}", "schema": json.loads(df.schema.json()), "notes": notes or {}}, sort_keys=True, indent=2)
        hidden = self._path(f"{folder}/.manifest-{own}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(body.encode("utf-8")))
        finally:
            out.close()
        version = max(self.versions(name), default=0) + 1
        while self._fs.exists(self._path(f"{folder}/manifest-{version:08d}.json")) or not self._fs.rename(hidden, self._path(f"{folder}/manifest-{version:08d}.json")):
            version += 1
            if version > max(self.versions(name), default=0) + 1000:
                raise OSError(f"no version of {name} can be named in {folder}")
        return version

    def manifest(self, name: str, version: int | None = None) -> dict[str, Any]:
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{name} has no version {version or ''} in {self.base}")
        path = f"{self.base}/{name}/manifest-{version or max(known):08d}.json"
        return json.loads("\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """A version, the latest by default."""
        m = self.manifest(name, version)
        return self.spark.read.schema(T.StructType.fromJson(m["schema"])).parquet(f"{self.base}/{name}/{m['data']}")

    def migrate(self, aliases: dict[str, str]) -> list[str]:
        """Move artifacts from old names to new ones; those whose new name is taken stay. Returns the names moved."""
        moved = []
        for old, new in sorted(aliases.items()):
            a, b = self._path(f"{self.base}/{old}"), self._path(f"{self.base}/{new}")
            if old != new and self._fs.exists(a) and not self._fs.exists(b):
                self._fs.mkdirs(b.getParent())
                if self._fs.rename(a, b):
                    moved.append(old)
        return moved

    def save_model(self, trees: DataFrame, name: str, members: tuple[Member, ...], features: list[str], **notes: Any) -> int:
        """A boosted ensemble: its trees, members and features."""
        return self.save(trees, name, {"members": [asdict(m) for m in members], "features": features} | notes)

    def load_model(self, name: str, version: int | None = None) -> tuple[DataFrame, tuple[Member, ...], list[str]]:
        notes = self.manifest(name, version)["notes"]
        return self.load(name, version), tuple(Member(**m) for m in notes["members"]), notes["features"]


def pretty(columns: dict[str, Column]) -> Column:
    """A JSON object of the columns, keys in order, two spaces of indent; nulls are null."""
    lines = []
    for name in sorted(columns):
        value = F.to_json(F.array(columns[name]))
        lines.append(F.concat(F.lit(f"  {json.dumps(name)}: "), F.substring(value, F.lit(2), F.length(value) - 2)))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
