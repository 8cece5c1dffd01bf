"""A stored table with a unique key, merged in place: upsert, insert-or-ignore and update by key.

Rows lie in buckets by the hash of their key. A merge reads and rewrites only the buckets that its rows touch, as new folders; a version file, written once all is there, names the folder of every bucket, and a reader follows the
newest version. So a broken merge changes nothing, a reader never sees half of one, and a merge that runs again gives the same table. Keys are checked to be unique in the pass that writes them.

A bucket is one task's work: choose ``buckets`` so that one fits in it. The version file holds a line a bucket. One writer at a time: the second of two that start from the same version fails, as its version's name is taken."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("upsert", "insert", "update")


class StoredTable:
    """The table at a path. Columns and key are given once, to ``create``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 16) -> StoredTable:
        table = cls(spark, path)
        table._publish({"version": 0, "schema": schema.json(), "keys": list(keys), "buckets": {str(b): None for b in range(buckets)}})
        return table

    def read(self) -> DataFrame:
        return self._read(self._current())

    def merge(self, rows: DataFrame, mode: str = "upsert", order: str | None = None) -> list[int]:
        """Merge rows (the table's columns; update: the key and those to change) and return the buckets that were rewritten. Of several rows of a key the last by `order` counts, or any without one.

        upsert: rows replace those of their key, whole. insert: rows whose key is there are ignored. update: rows of the key take the given columns, null among them; nothing is inserted. A key with a null in it is refused."""
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}")
        now = self._current()
        keys, names = now["keys"], T.StructType.fromJson(json.loads(now["schema"])).names
        given = names if mode != "update" else [c for c in names if c in rows.columns]
        best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order) if order else F.lit(0)))
        new = rows.select(*given, best.alias("__n")).where("__n = 1").drop("__n").withColumn("__bucket", self._bucket(now))
        if new.where(" OR ".join(f"{k} IS NULL" for k in keys)).head(1):
            raise ValueError(f"null in the key {', '.join(keys)}")
        touched = sorted(r["__bucket"] for r in new.select("__bucket").distinct().collect())
        if not touched:
            return []
        old = self._read(now, touched).withColumn("__bucket", self._bucket(now))
        own = [*keys, "__bucket"]
        if mode == "upsert":
            merged = new.unionByName(old.join(new.select(*own), own, "left_anti"))
        elif mode == "insert":
            merged = old.unionByName(new.join(old.select(*own), own, "left_anti"))
        else:
            change = [c for c in given if c not in keys]
            marked = new.select(*own, *(F.col(c).alias(f"__{c}") for c in change), F.lit(True).alias("__hit"))
            merged = old.join(marked, own, "left").select("__bucket", *(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in change else c for c in names))
        self._write(now, merged.select("__bucket", *names), touched)
        return touched

    def _bucket(self, now: dict[str, Any]) -> Column:
        return F.pmod(F.xxhash64(*now["keys"]), F.lit(len(now["buckets"]))).cast("int")

    def _write(self, now: dict[str, Any], merged: DataFrame, touched: list[int]) -> None:
        at, seen = f"data/{uuid.uuid4().hex}", Observation()
        twice = F.count(F.lit(1)).over(Window.partitionBy("__bucket", *now["keys"]))
        checked = merged.repartition(len(touched), "__bucket").withColumn("__same", twice).observe(seen, F.max("__same").alias("most"))
        checked.drop("__same").write.partitionBy("__bucket").parquet(f"{self.path}/{at}")
        if (seen.get["most"] or 0) > 1:
            raise ValueError(f"not unique: {', '.join(now['keys'])}")
        written = {f.getPath().getName() for f in self._files.listStatus(self._place(f"{self.path}/{at}"))}
        buckets = now["buckets"] | {str(b): f"{at}/__bucket={b}" if f"__bucket={b}" in written else None for b in touched}
        self._publish(now | {"version": now["version"] + 1, "buckets": buckets})

    def _read(self, now: dict[str, Any], only: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        held = [f"{self.path}/{p}" for b, p in now["buckets"].items() if p and (only is None or int(b) in only)]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def _current(self) -> dict[str, Any]:
        where = self._place(f"{self.path}/versions")
        if not self._files.exists(where):
            raise FileNotFoundError(f"no table at {self.path}")
        newest = max((f.getPath() for f in self._files.listStatus(where) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
        stream = self._files.open(newest)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, state: dict[str, Any]) -> None:
        """The version's file appears whole, by a rename, and never in place of another."""
        name, draft = self._place(f"{self.path}/versions/{state['version']}"), self._place(f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._files.exists(name) or not self._files.rename(draft, name):
            self._files.delete(draft, False)
            raise FileExistsError(f"version {state['version']} of {self.path} is there already")
