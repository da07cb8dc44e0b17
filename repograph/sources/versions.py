"""Tables at rest that are changed in part: buckets by key, and a manifest for each version.

A table is a folder with ``data`` and ``versions``. A version is one small file that names the folder of each bucket; it is put in place by a rename that fails
if the version is there already, so readers see the old version or the new one, and of two writers that started from the same version one gets an error and may
try again. A change reads and writes only the buckets that its keys fall into; what a failed write leaves is named by no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer has put the next version in place first."""


class VersionedTable:
    """Rows by the hash of ``key`` in ``buckets`` folders. Rows with equal keys are in one bucket; a null key is one key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, df: DataFrame, root: str, key: str, buckets: int = 64) -> VersionedTable:
        """A new table of the rows of df, as version 0."""
        table = cls(df.sparkSession, root)
        if table.exists():
            raise VersionConflict(f"{root} is a table already")
        folders = table._written(df, key, buckets, range(buckets))
        table._commit({"version": 0, "key": key, "buckets": buckets, "schema": df.schema.json(), "folders": folders})
        return table

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The buckets' folders of a version, the newest by default."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _frame(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._frame(self.manifest(version))

    def _bucket(self, key: str | Column, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(n)).cast("int")

    def _written(self, df: DataFrame, key: str, n: int, wanted) -> dict[str, str]:
        """Write rows into a new folder, one for each bucket; the buckets that got rows, by number."""
        name = uuid.uuid4().hex
        rows = df.withColumn("_bucket", self._bucket(key, n))
        rows.repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        at = self._path(f"{self.root}/data/{name}")
        there = {s.getPath().getName() for s in self._fs.listStatus(at)}
        return {str(b): f"{name}/_bucket={b}" for b in wanted if f"_bucket={b}" in there}

    def _commit(self, manifest: dict) -> None:
        path = f"{self.root}/versions"
        draft = self._path(f"{path}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._path(f"{path}/{manifest['version']:08d}.json")
        # Rename does not replace on file systems of clusters; on a local disk it would, so the name is looked for as well.
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise VersionConflict(f"version {manifest['version']} of {self.root} is there already")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the buckets that keys(<key>) fall into by change(rows) and commit; returns the numbers of those buckets.

        ``change`` may only add, drop or alter rows whose keys fall into these buckets.
        """
        manifest = self.manifest()
        key, n = manifest["key"], manifest["buckets"]
        # As many numbers as there are buckets at most.
        touched = sorted(r["b"] for r in keys.select(self._bucket(key, n).alias("b")).distinct().collect())
        if not touched:
            return []
        folders = self._written(change(self._frame(manifest, touched)), key, n, touched)
        kept = {b: f for b, f in manifest["folders"].items() if int(b) not in touched}
        self._commit(manifest | {"version": manifest["version"] + 1, "folders": kept | folders})
        return touched

    def merge(self, new: DataFrame) -> list[int]:
        """Upsert by key: given values replace, nulls keep what was there, unknown keys are added. Keys of new are unique."""
        key = self.manifest()["key"]

        def change(old: DataFrame) -> DataFrame:
            o, n = old.alias("o"), new.alias("n")
            joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
            return joined.select(*(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns))

        return self.rewrite(new, change)

    def add(self, new: DataFrame, same: list[str]) -> list[int]:
        """Add the rows of new that differ in the columns ``same`` (the key among them) from all that are there, each once."""

        def change(old: DataFrame) -> DataFrame:
            fresh = new.dropDuplicates(same).join(old.select(*same), same, "left_anti")
            return old.unionByName(fresh.select(*[c for c in old.columns if c in fresh.columns]), allowMissingColumns=True)

        return self.rewrite(new, change)

    def delete(self, gone: DataFrame, same: list[str] | None = None) -> list[int]:
        """Drop the rows that are equal to one of gone in the columns ``same`` (by default the key)."""
        same = same or [self.manifest()["key"]]
        return self.rewrite(gone, lambda old: old.join(gone.select(*same).distinct(), same, "left_anti"))

    def update(self, updates: DataFrame, column: str) -> list[int]:
        """Set a column from updates(<key>, value) where the key is there; null values keep what is there."""
        key = self.manifest()["key"]
        given = updates.select(key, F.col("value").alias("_value"))
        return self.rewrite(updates, lambda old: old.join(given, key, "left").withColumn(column, F.coalesce("_value", column)).select(*old.columns))
