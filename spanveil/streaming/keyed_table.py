"""A keyed table that a stream keeps up to date, compacted as it grows (H2, H4).

Each micro-batch adds a delta: its rows, in a folder of its own.  After some deltas they are merged into the base, which holds
one row of each key in buckets by key; only the buckets that the deltas touch are written anew.  A manifest names the folders
that make up the table.  A new manifest is written aside and renamed to the next version, so that a reader sees the table before
or after a step and never between.  The folders of the manifest before stay for readers on their way; older ones are removed.
So the number of folders depends on ``buckets`` and ``every``, not on the number of batches.  One stream writes a table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: manifests that stay, with their folders
KEPT = 2
_EMPTY = {"upto": -1, "deltas": {}, "base": {}, "buckets": None, "schema": None}


class KeyedTable:
    """The table at ``path`` (a folder all executors share) with one row for each ``key``: that of the last batch that has it.  A
    batch holds a key once (the output of a stream in update mode does); a null key is a key like any other.

    ``buckets`` is chosen so that the rows of one fit a task; it is fixed when the table is made.  ``every`` deltas are
    merged at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", buckets: int = 16, every: int = 8):
        self.spark, self.path, self.key, self.buckets, self.every = spark, path, key, buckets, every
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _versions(self) -> list[str]:
        return [n for n in self._names("manifests") if n.endswith(".json")]

    def _read(self, version: str) -> dict:
        stream = self.fs.open(self._at("manifests", version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        versions = self._versions()
        return self._read(versions[-1]) if versions else dict(_EMPTY)

    def _commit(self, manifest: dict) -> None:
        versions = self._versions()
        number = int(versions[-1].split(".")[0]) + 1 if versions else 0
        aside, name = self._at("manifests", f"{uuid.uuid4().hex}.tmp"), f"{number:012d}.json"
        self.fs.mkdirs(self._at("manifests"))
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if not self.fs.rename(aside, self._at("manifests", name)):
            raise RuntimeError(f"another writer has committed {name} of {self.path}")
        self._clean([*versions, name][-KEPT:])

    def _clean(self, kept: list[str]) -> None:
        """Removes what no kept manifest names: merged deltas, replaced buckets, leavings of a stopped attempt."""
        named = {f for v in kept for m in [self._read(v)] for f in [*m["deltas"].values(), *m["base"].values()]}
        tops = {f.split("/")[0] for f in named}
        for name in self._names("data"):
            if name not in tops:
                self.fs.delete(self._at("data", name), True)
            elif name.startswith("base-"):
                for part in self._names("data", name):
                    if part.startswith("bucket=") and f"{name}/{part}" not in named:
                        self.fs.delete(self._at("data", name, part), True)
        for name in self._names("manifests"):
            if name not in kept:
                self.fs.delete(self._at("manifests", name), False)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _folders(self, manifest: dict, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*[os.path.join(self.path, "data", f) for f in folders])

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key (combined before the shuffle, so a key of many batches is no hot key)."""
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key]), "batch_id").alias("_r"))
        return last.select(self.key, "_r.*").select(*rows.columns)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch.  A replayed one takes the place of its first attempt, or is left out when it is already merged."""
        manifest = self.manifest()
        if batch_id <= manifest["upto"]:
            return
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        if manifest["schema"] is None:
            manifest |= {"schema": json.loads(rows.schema.json()), "buckets": self.buckets}
        name = f"delta-{batch_id:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(os.path.join(self.path, "data", name))
        manifest["deltas"] = {**manifest["deltas"], str(batch_id): name}
        if len(manifest["deltas"]) >= self.every:
            manifest = self._merged(manifest)
        self._commit(manifest)

    def _merged(self, manifest: dict) -> dict:
        buckets = manifest["buckets"]
        bucket = self._bucket(buckets)
        deltas = self._folders(manifest, list(manifest["deltas"].values()))
        touched = sorted(r[0] for r in deltas.select(bucket.alias("b")).distinct().collect())  # ``buckets`` numbers at most
        upto = max(map(int, manifest["deltas"]))
        old = [manifest["base"][str(b)] for b in touched if str(b) in manifest["base"]]
        rows = deltas.unionByName(self._folders(manifest, old)) if old else deltas
        name = f"base-{upto:012d}-{uuid.uuid4().hex}"
        (self._last(rows).withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket")
         .parquet(os.path.join(self.path, "data", name)))
        new = {str(b): f"{name}/bucket={b}" for b in touched}
        return manifest | {"upto": upto, "deltas": {}, "base": manifest["base"] | new}

    def read(self) -> DataFrame:
        """The table as of the last committed batch."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            raise ValueError(f"no batch has been added to {self.path}")
        folders = [*manifest["base"].values(), *manifest["deltas"].values()]
        if not folders:  # batches without rows, merged
            return self.spark.createDataFrame([], StructType.fromJson(manifest["schema"])).drop("batch_id")
        return self._last(self._folders(manifest, folders)).drop("batch_id")


def keyed_batch(path: str, key: str = "doc_id", buckets: int = 16, every: int = 8) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of a compacted keyed table; ``KeyedTable(spark, path, key).read()`` gives it."""
    return lambda batch, batch_id: KeyedTable(batch.sparkSession, path, key, buckets, every).add(batch, batch_id)
