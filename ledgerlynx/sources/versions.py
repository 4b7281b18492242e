"""Keyed tables in versions: an upsert rewrites only the buckets its keys fall into.

Rows are dealt to buckets by a hash of their key, so the keys of an upsert say exactly which
buckets it touches.  A version is a stored list of one folder per bucket; untouched buckets
keep the folder of an earlier version.  Data is written first and the version last, so readers
see one whole version, and a crash in between leaves only a folder that no version names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """A table below ``path`` with the columns ``ddl``; ``buckets`` stays the same for its life.

    The driver handles one row per bucket.  One writer at a time: a second one that
    publishes the same version number fails.
    """

    spark: SparkSession
    path: str
    key: str
    ddl: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    # -- versions -------------------------------------------------------------

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        folders = [s.getPath() for s in files.listStatus(root)]
        whole = [p for p in folders if files.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Folder of every bucket that has rows, in a version or the newest one."""
        known = self.versions()
        if not known:
            return {}
        stored = self.spark.read.parquet(f"{self.path}/versions/{known[-1] if version is None else version}")
        return {r["bucket"]: r["folder"] for r in stored.collect()}

    def _publish(self, folders: dict[int, str]) -> int:
        version = (self.versions() or [-1])[-1] + 1
        rows = self.spark.createDataFrame(list(folders.items()), "bucket int, folder string")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/{version}")
        return version

    # -- rows -----------------------------------------------------------------

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows of one version, of all buckets or of some."""
        folders = self.folders(version)
        paths = [f for b, f in folders.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*paths)

    def _store(self, rows: DataFrame) -> dict[int, str]:
        """Write rows by bucket to a fresh folder; returns the buckets that got any."""
        folder = f"{self.path}/data/{uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(folder)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names}

    def create(self, rows: DataFrame) -> int:
        """Publish ``rows`` as the whole table."""
        return self._publish(self._store(rows))

    def upsert(self, fresh: DataFrame, merge: Merge) -> int:
        """Publish the newest version with ``merge(old, fresh)`` in the buckets of ``fresh``.

        ``merge`` sees all rows of these buckets and no others; ``fresh`` is read twice, so it
        should be a stored table.  Applying the same rows again changes no row.
        """
        touched = {r[0] for r in fresh.select(self.bucket()).distinct().collect()}  # at most ``buckets``
        known = self.folders()
        if not touched:
            return self._publish(known)
        merged = merge(self.read(buckets=touched), fresh)
        written = self._store(merged)
        kept = {b: f for b, f in known.items() if b not in touched}
        return self._publish(kept | written)

    def expire(self, keep: int) -> None:
        """Drop all but the newest ``keep`` versions, and the folders only they name."""
        known = self.versions()
        old, new = known[: max(0, len(known) - keep)], known[-keep:]
        named = {f.rsplit("/", 1)[0] for v in new for f in self.folders(v).values()}
        gone = {f.rsplit("/", 1)[0] for v in old for f in self.folders(v).values()} - named
        for path in [*(f"{self.path}/versions/{v}" for v in old), *gone]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
