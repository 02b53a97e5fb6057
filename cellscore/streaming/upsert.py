"""A table with one row for each key, merged batch by batch.

Rows lie in buckets of keys. A batch reads, merges and writes only the buckets that it touches, each as a new version in a
folder of the batch; a manifest then names the version of every bucket, so a reader sees whole batches and opens as many
folders as there are buckets, however many batches there were. A batch that is run again starts from the manifest before
it and replaces its own folder, so nothing counts twice. Versions that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Files of a folder through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears whole, under its own name, or not at all."""
        hidden = self._at(f"_{name}")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self._at(name), False)
        self._fs.mkdirs(self._at(name).getParent())
        self._fs.rename(hidden, self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class UpsertTable:
    """``combine`` makes one row for each key of rows with the columns of a batch, and may be applied again to its result."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.keys, self.combine, self.buckets = spark, path, list(keys), combine, buckets
        self.files = Folder(spark, path)

    def last_epoch(self) -> int:
        """The last epoch that was merged, -1 before the first."""
        return max((int(n.split("-")[1]) for n in self.files.names("manifests") if n.startswith("epoch-")), default=-1)

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """The epoch whose folder holds each bucket, as of the last epoch (below ``before``)."""
        epochs = [int(n.split("-")[1]) for n in self.files.names("manifests") if n.startswith("epoch-")]
        some = [e for e in epochs if before is None or e < before]
        return {int(b): e for b, e in json.loads(self.files.read(f"manifests/epoch-{max(some):012d}")).items()} if some else {}

    def _rows(self, held: dict[int, int], schema=None) -> DataFrame | None:
        if not held:
            return None
        paths = [f"{self.path}/data/epoch={e}/_b={b}" for b, e in sorted(held.items())]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Merge ``batch``; the same epoch again replaces what it did before."""
        before = self._manifest(epoch)
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
        new = self.combine(batch).withColumn("_b", bucket)
        new.persist()
        try:
            touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # at most one row a bucket
            old = self._rows({b: before[b] for b in touched if b in before}, new.drop("_b").schema)
            both = new.drop("_b") if old is None else old.unionByName(new.drop("_b"))
            merged = self.combine(both).withColumn("_b", bucket)
            if touched:
                merged.repartition(len(touched), "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/data/epoch={epoch}")
        finally:
            new.unpersist()
        now = before | {b: epoch for b in touched}
        self.files.write(f"manifests/epoch-{epoch:012d}", json.dumps(now))
        self._clean(epoch, {(e, b) for m in (before, now) for b, e in m.items()})

    def _clean(self, epoch: int, used: set[tuple[int, int]]) -> None:
        for folder in self.files.names("data"):
            e = int(folder.split("=")[1])
            for part in self.files.names(f"data/{folder}"):
                if e < epoch and part.startswith("_b=") and (e, int(part.split("=")[1])) not in used:
                    self.files.remove(f"data/{folder}/{part}")
            if not any(p.startswith("_b=") for p in self.files.names(f"data/{folder}")):
                self.files.remove(f"data/{folder}")
        last = [n for n in self.files.names("manifests") if n.startswith("epoch-")][:-2]
        for name in last:
            self.files.remove(f"manifests/{name}")

    def read(self, schema=None) -> DataFrame | None:
        """The rows of all keys; None before the first batch with rows."""
        return self._rows(self._manifest(), schema)
