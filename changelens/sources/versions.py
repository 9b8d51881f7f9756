"""Stored tables with versions: keyed rows that several jobs may update at a time.

A table is a folder of Parquet data and one small manifest per version. Rows lie in a
fixed number of buckets by a hash of their key; a manifest names, for every bucket, the
folder that holds its rows, so it has as many entries as buckets, however large the table.

An update reads the touched buckets of the latest version, puts the new rows in, writes
the result to a folder of its own, and publishes a manifest with the next number, which
succeeds only if no one has published that number before. If someone has, the update is
made again on top of theirs. A job that dies before publishing leaves files that no
manifest names. A manifest also names the run that made it; a run that is repeated finds
its name and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_bucket"
_RETRIES = 100


class Conflict(Exception):
    """Another job has published the version."""


@dataclass(frozen=True)
class Manifest:
    version: int
    run: str
    schema: str
    buckets: dict[int, str]

    def text(self) -> str:
        return json.dumps(
            {"version": self.version, "run": self.run, "schema": json.loads(self.schema), "buckets": self.buckets}
        )

    @classmethod
    def of(cls, body: str) -> Manifest:
        found = json.loads(body)
        return cls(found["version"], found["run"], json.dumps(found["schema"]), {int(k): v for k, v in found["buckets"].items()})


class VersionedTable:
    """Rows with the key columns `keys`; of several rows with one key the largest by the
    columns `newest` stays, and of equal ones the row of the later update."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], newest: list[str] | None = None, buckets: int = 64):
        self.spark, self.folder, self.keys, self.newest, self.n_buckets = spark, folder.rstrip("/"), keys, newest or [], buckets
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._path = self._fs.Path(f"{self.folder}/versions")
        self._context = self._fs.FileContext.getFileContext(self._path.toUri(), spark._jsc.hadoopConfiguration())
        self._system = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._system.mkdirs(self._path)

    def versions(self) -> list[int]:
        """Numbers of all published versions, ascending."""
        names = [status.getPath().getName() for status in self._system.listStatus(self._path)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != "_")

    def manifest(self, version: int) -> Manifest:
        rows = self.spark.read.text(f"{self.folder}/versions/{version:08d}.json", wholetext=True).collect()
        return Manifest.of(rows[0]["value"])

    def _publish(self, manifest: Manifest) -> None:
        """Write a manifest under a hidden name and rename it, unless its number is taken."""
        hidden = self._fs.Path(f"{self.folder}/versions/_{uuid.uuid4().hex}")
        stream = self._system.create(hidden)
        stream.write(bytearray(manifest.text().encode()))
        stream.close()
        target = self._fs.Path(f"{self.folder}/versions/{manifest.version:08d}.json")
        modes = self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._context.rename(hidden, target, modes)
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict(manifest.version) from error

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; a table without versions has none."""
        known = self.versions()
        if not known:
            raise ValueError(f"{self.folder} has no version")
        return self._rows(self.manifest(known[-1] if version is None else version))

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        wanted = manifest.buckets if buckets is None else {b: manifest.buckets[b] for b in buckets if b in manifest.buckets}
        folders = [f"{self.folder}/data/{made}/{_BUCKET}={b}" for b, made in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket_of(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def _merged(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new.withColumn("_later", F.lit(1))
        if old is not None:
            rows = old.withColumn("_later", F.lit(0)).unionByName(rows)
        order = [F.col(c).desc_nulls_last() for c in (*self.newest, "_later")]
        first = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))  # versions of one row
        return rows.withColumn("_rank", first).where("_rank = 1").drop("_later", "_rank")

    def upsert(self, rows: DataFrame, run: str) -> int:
        """Put the rows in and give the number of the version that holds them. `run` names the
        job: a name that has been published before changes nothing."""
        marked = rows.withColumn(_BUCKET, self._bucket_of())
        touched = sorted(r[_BUCKET] for r in marked.select(_BUCKET).distinct().collect())  # n_buckets at most
        checked = 0
        for _ in range(_RETRIES):
            known = self.versions()
            for version in known[checked:]:
                if self.manifest(version).run == run:
                    return version
            checked = len(known)
            last = self.manifest(known[-1]) if known else Manifest(0, "", rows.schema.json(), {})
            old = self._rows(last, touched) if known else None
            made = uuid.uuid4().hex
            merged = self._merged(old, rows).withColumn(_BUCKET, self._bucket_of())
            merged.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/data/{made}")
            following = replace(last, version=last.version + 1, run=run, buckets=last.buckets | dict.fromkeys(touched, made))
            try:
                self._publish(following)
            except Conflict:
                continue
            return following.version
        raise Conflict(f"{run}: {_RETRIES} other versions came first")
