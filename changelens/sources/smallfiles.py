"""Directories of very many small files, read by a data source that plans by bytes.

The folders are listed by tasks, one subtree each, into a table sorted by (repo, pr_id,
path). The reader plans from that table: it goes through the sizes, never through the
folders, and makes a partition of as many neighbouring files as come to `target` bytes,
so neither millions of tiny tasks nor a huge one result. Conditions on repo and pr_id
are pushed down; listed row groups that can't hold them are skipped by their statistics.

Files lie below `root/<repo>/<pr_id>/`; paths are relative to that. A file that is gone or
is not UTF-8 when it is read is an error that names it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

LISTED = "repo STRING, pr_id BIGINT, path STRING, place STRING, bytes BIGINT"
READ = "repo STRING, pr_id BIGINT, path STRING, content STRING"
TARGET = 64 << 20
_PUSHED = ("repo", "pr_id")


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """LISTED rows of all files; the driver lists repositories only, tasks the rest."""
    system, top = _filesystem(root)
    repos = [info.base_name for info in system.get_file_info(fs.FileSelector(top)) if info.type == fs.FileType.Directory]

    def subtree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, folder = _filesystem(root)
        for batch in batches:
            for repo in batch["repo"]:
                rows = []
                for info in held.get_file_info(fs.FileSelector(f"{folder}/{repo}", recursive=True)):
                    request, _, path = info.path.removeprefix(f"{folder}/{repo}/").partition("/")
                    if info.type == fs.FileType.File and path and request.isdigit():
                        rows.append((repo, int(request), path, info.path, info.size))
                yield pd.DataFrame(rows, columns=["repo", "pr_id", "path", "place", "bytes"])

    names = spark.createDataFrame([(r,) for r in repos], "repo STRING").repartition(max(1, len(repos)), "repo")
    return names.mapInPandas(subtree, LISTED)


def write_listing(spark: SparkSession, root: str, listing: str) -> None:
    list_files(spark, root).repartitionByRange("repo", "pr_id", "path").sortWithinPartitions("repo", "pr_id", "path").write.mode(
        "overwrite"
    ).parquet(listing)


@dataclass
class FileRange(InputPartition):
    """Rows `start` to `stop` of one row group of the listing."""

    listing: str
    group: int
    start: int
    stop: int


class SmallFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.wanted: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            values = [one.value] if isinstance(one, EqualTo) else list(one.value) if isinstance(one, In) else None
            column = getattr(one, "attribute", ("",))
            if values is not None and len(column) == 1 and column[0] in _PUSHED and column[0] not in self.wanted:
                self.wanted[column[0]] = values
            else:
                yield one

    def _condition(self):
        found = None
        for name, values in self.wanted.items():
            one = ds.field(name).isin(pa.array(values, pa.string() if name == "repo" else pa.int64()))
            found = one if found is None else found & one
        return found

    def _fragments(self):
        system, folder = _filesystem(self.options["listing"])
        for fragment in ds.dataset(folder, filesystem=system, format="parquet", exclude_invalid_files=True).get_fragments():
            kept = fragment.split_by_row_group(self._condition()) if self.wanted else fragment.split_by_row_group()
            for part in kept:
                yield fragment.path, part.row_groups[0].id, part

    def partitions(self) -> list[FileRange]:
        target, made = int(self.options.get("target", TARGET)), []
        for path, group, part in self._fragments():
            sizes = part.to_table(columns=["bytes"]).column(0).to_numpy()
            start = total = 0
            for i, size in enumerate(sizes.tolist()):
                if total and total + size > target:
                    made.append(FileRange(path, group, start, i))
                    start, total = i, 0
                total += size
            made.append(FileRange(path, group, start, len(sizes)))
        return made or [FileRange("", 0, 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        system, _ = _filesystem(self.options["listing"])
        files = ds.ParquetFileFormat().make_fragment(partition.listing, system, row_groups=[partition.group]).to_table()
        rows = files.slice(partition.start, partition.stop - partition.start).to_pylist()
        for row in rows:
            if any(row[name] not in values for name, values in self.wanted.items()):
                continue
            with system.open_input_stream(row["place"]) as stream:
                data = stream.read()
            try:
                text = data.decode()
            except UnicodeDecodeError as error:
                raise ValueError(f"{row['place']} is not UTF-8") from error
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["repo"]]), pa.array([row["pr_id"]], pa.int64()), pa.array([row["path"]]), pa.array([text])],
                ["repo", "pr_id", "path", "content"],
            )


class SmallFiles(DataSource):
    """Format `small_files`; options `listing` (folder) and `target` (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "small_files"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> SmallFilesReader:
        return SmallFilesReader(dict(self.options))


def read_small_files(spark: SparkSession, listing: str, target: int = TARGET) -> DataFrame:
    """repo, pr_id, path and content of the listed files."""
    spark.dataSource.register(SmallFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # concerns Python data sources only
    return spark.read.format("small_files").option("listing", listing).option("target", str(target)).load()


def write_small_files(files: DataFrame, root: str) -> None:
    """One file per row (repo, pr_id, path, content), written by tasks."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _filesystem(root)
        for batch in batches:
            for row in batch.itertuples():
                place = f"{top}/{row.repo}/{row.pr_id}/{row.path}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as stream:
                    stream.write((row.content or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("repo", "pr_id", "path", "content").mapInPandas(write, "n LONG").agg(F.sum("n")).collect()
