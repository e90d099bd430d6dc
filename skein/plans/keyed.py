"""Tables that batches change by key: counted rows in buckets, and a manifest that makes a batch take effect at once.

A row is identified by its key columns and carries sums; differences are added, and rows whose sums are all zero
fall away. Only the buckets that a batch's keys hash to are read and written again. A batch takes effect when its
manifest (which bucket is in which folder) is created under its number, a name that must be free: batches are all or
nothing, of two writers of a number one wins, and readers keep the version they opened.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import discarded, settled, shuffles_dropped

BUCKETS = 64
#: Versions whose folders ``vacuum`` keeps.
KEPT = 2


def columns(schema: str) -> list[str]:
    """Names of a schema of plain columns."""
    return [c.split()[0] for c in schema.split(", ")]


def summed(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums per key, without keys whose sums are all zero."""
    out = rows.groupBy(*keys).agg(*(F.sum(s).cast("long").alias(s) for s in sums))
    some = F.lit(False)
    for s in sums:
        some |= F.col(s) != 0
    return out.where(some)


class Keyed:
    """A folder of states: name -> (schema of the key columns, the one that buckets go by, columns that are summed).

    ``buckets`` is set once for a folder: at least as many as a batch's work should be spread over.
    """

    def __init__(self, spark: SparkSession, folder: str, states: dict[str, tuple[str, str, list[str]]], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.states, self.buckets = spark, folder.rstrip("/"), states, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        self.reopen()

    def reopen(self) -> None:
        """Take the newest version, which another writer may have made."""
        found = self._versions()
        self.version = found[-1] if found else 0
        self._where = self._manifest(self.version) if found else {name: {} for name in self.states}

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict[str, dict[str, str]]:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{version}", wholetext=True).first()[0])

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        keys, _, sums = self.states[name]
        schema = f"{keys}, " + ", ".join(f"{s} bigint" for s in sums)
        paths = [p for b, p in self._where[name].items() if buckets is None or int(b) in buckets]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.select(*columns(keys), *sums)

    def _at(self, name: str, ids: DataFrame) -> DataFrame:
        """A state's rows of some ids (id); only their buckets are read, at most one number a bucket comes to the driver."""
        _, by, _ = self.states[name]
        if not self._where[name]:
            return self._read(name, [])
        buckets = [r[0] for r in ids.select(self._bucket("id")).distinct().collect()]
        named = ids.select(F.col("id").alias(by)).distinct()
        return self._read(name, buckets).join(named, by, "left_semi")

    def _merged(self, name: str, delta: DataFrame, number: int, ready: bool = False) -> dict[str, str]:
        """Where each bucket of a state is once the differences are in it; buckets without any stay where they are.

        ``ready`` differences are settled and summed by their keys already.
        """
        schema, by, sums = self.states[name]
        keys = columns(schema)
        delta = delta if ready else settled(summed(delta, keys, sums), f"delta-{name}")
        buckets = [r[0] for r in delta.select(self._bucket(by)).distinct().collect()]
        if not buckets:
            return self._where[name]
        rows = delta.select(*keys, *sums)
        if any(str(b) in self._where[name] for b in buckets):
            rows = summed(self._read(name, buckets).unionByName(rows), keys, sums)
        place = f"{self.folder}/{name}/{number}"
        with shuffles_dropped(self.spark):
            rows.withColumn("_bucket", self._bucket(by)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(place)
        if not ready:
            discarded(delta)
        written = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._path(place))}
        out = {b: p for b, p in self._where[name].items() if int(b) not in buckets}
        return out | {str(b): f"{place}/_bucket={b}" for b in buckets if str(b) in written}

    def _commit(self, number: int, where: dict) -> None:
        out = self._fs.create(self._path(f"{self.folder}/manifests/{number}"), False)
        out.write(bytearray(json.dumps(where).encode()))
        out.close()
        self.version, self._where = number, where

    def vacuum(self, keep: int = KEPT) -> None:
        """Delete the folders that only manifests before the last ``keep`` name."""
        found = self._versions()
        used = {p for n in found[-keep:] for held in self._manifest(n).values() for p in held.values()}
        for n in found[:-keep]:
            for held in self._manifest(n).values():
                for p in set(held.values()) - used:
                    self._fs.delete(self._path(p), True)
            self._fs.delete(self._path(f"{self.folder}/manifests/{n}"), False)
