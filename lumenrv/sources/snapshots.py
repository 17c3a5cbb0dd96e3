"""A table whose rows come from sources, each with a hash: a commit replaces the rows of changed sources, readers see one snapshot.

Folder: data/<id> (rows of one commit, with __source), manifests/<id> (source, hash, folder: what is live) and versions/<n>, a
small file that names the manifest of version n and is created by one writer only. A commit that is killed before that
leaves folders that nobody reads; run again it writes them anew. vacuum() removes what no kept version needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; nothing of this commit is visible."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def _manifest_name(self, version: int) -> str:
        stream = self._fs.open(self._path(f"versions/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """source, hash, folder of a version (default: the last one), or None where there is none."""
        known = self.versions()
        if not known:
            return None
        name = self._manifest_name(known[-1] if version is None else version)
        return self.spark.read.schema("source string, hash string, folder string").parquet(f"{self.folder}/manifests/{name}")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with __source; None before the first commit.

        What was replaced or left is taken out by a join on source and folder, so that the work grows with what is stored.
        """
        live = self.manifest(version)
        if live is None:
            return None
        folders = [r.folder for r in live.select("folder").distinct().collect()]  # one a commit that still has live rows
        if not folders:
            return self.spark.read.parquet(*[f"{self.folder}/data/{n}" for n in self._names("data")[:1]]).limit(0)
        rows = None
        for name in folders:
            part = self.spark.read.parquet(f"{self.folder}/data/{name}").withColumn("__folder", F.lit(name))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        named = live.select(F.col("source").alias("__s"), F.col("folder").alias("__f"))
        return rows.join(named, (F.col("__source") == F.col("__s")) & (F.col("__folder") == F.col("__f")), "left_semi").drop("__folder")

    def commit(self, hashes: DataFrame, work: Callable[[DataFrame], DataFrame], *, gone: bool = False) -> int | None:
        """Make hashes (source, hash) the table's state and return the version, or None if nothing has changed.

        work(sources) gives the rows of some sources (a frame with source), each with __source; it is asked for new and changed
        ones only. With gone, sources that hashes lacks leave the table. Of a source with several hashes the greatest counts;
        null sources do not. Raises Conflict if another commit came first.
        """
        known = self.versions()
        version = known[-1] + 1 if known else 1
        now = hashes.filter("source is not null").groupBy(F.col("source").cast("string").alias("source")).agg(F.max("hash").alias("hash"))
        old = self.manifest() if known else self.spark.createDataFrame([], "source string, hash string, folder string")
        before = old.select(F.col("source").alias("__s"), F.col("hash").alias("__h"))
        from lumenrv.sources.scratch import materialize

        changed = materialize(now.join(before, F.col("source") == F.col("__s"), "left").filter("not hash <=> __h or __s is null").select("source", "hash"))
        left = old.join(now.select(F.col("source").alias("__n")), F.col("source") == F.col("__n"), "left_anti") if gone else None
        if changed.isEmpty() and (left is None or left.isEmpty()):
            return None
        name = uuid.uuid4().hex
        work(changed.select("source")).write.parquet(f"{self.folder}/data/{name}")
        stay = old.join(changed.select(F.col("source").alias("__c")), F.col("source") == F.col("__c"), "left_anti")
        if gone:
            stay = stay.join(now.select(F.col("source").alias("__n")), F.col("source") == F.col("__n"), "left_semi")
        stay.select("source", "hash", "folder").union(changed.select("source", "hash", F.lit(name))).write.parquet(f"{self.folder}/manifests/{name}")
        self._publish(version, name)
        return version

    def _publish(self, version: int, name: str) -> None:
        """The one step that others see: a file that only one writer can create."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(f"versions/{version}"), False)
        except Py4JJavaError as failed:
            if "AlreadyExists" in str(failed.java_exception.getClass().getName()):
                raise Conflict(f"version {version} is there already") from None
            raise
        out.write(bytearray(name.encode()))
        out.close()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove versions but the last ones and every data and manifest folder that they do not name; returns what went.

        Only while no commit is under way: what an unfinished one has written goes too.
        """
        known = self.versions()
        stays = known[-keep:] if keep else []
        manifests = {self._manifest_name(v) for v in stays}
        data = {r.folder for v in stays for r in self.manifest(v).select("folder").distinct().collect()}
        away = [f"versions/{v}" for v in known if v not in stays] + [f"manifests/{n}" for n in self._names("manifests") if n not in manifests] + [f"data/{n}" for n in self._names("data") if n not in data]
        for name in away:
            self._fs.delete(self._path(name), True)
        return away
