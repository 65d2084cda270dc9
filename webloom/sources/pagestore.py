"""A page store as a data source, and event text as a streaming sink.

    spark.dataSource.register(PageStore); spark.read.format("pagestore").load(path).where("host = 'example.com'")

A store is a folder of Parquet files sorted by host (write_store), so each file holds a range of hosts. A scan has one partition a file,
leaves out the files whose range its filters exclude, and filters the rest by row group and row. Another kind of store is a
DataSource with the same columns. Paths are URIs that pyarrow's file systems know (file, hdfs, s3) or local paths.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from webloom.functions import urls

COLUMNS = "host string, url string, status_code int, final_url string, error string, html string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Columns that are sorted or unique enough to be filtered here.
FILTERED = ("host", "url")


def write_store(pages: DataFrame, path: str, n_files: int) -> None:
    """A store of pages (url, html and what else of COLUMNS they have), dealt out by ranges of (host, url)."""
    have = set(pages.columns)
    rows = pages.withColumn("host", urls.host(F.col("url")))
    kinds = [x.split() for x in COLUMNS.split(", ")]
    rows = rows.select(*[(F.col(n) if n in have or n == "host" else F.lit(None)).cast(k).alias(n) for n, k in kinds])
    rows.repartitionByRange(n_files, "host", "url").sortWithinPartitions("host", "url").write.parquet(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class HostRange(InputPartition):
    """A file and the least and greatest host in it."""

    path: str
    least: str | None
    most: str | None


class PageStoreReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of host or url are done here; the others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in FILTERED:
                self.filters.append(f)
            else:
                yield f

    def _may_hold(self, p: HostRange) -> bool:
        for f in self.filters:
            if f.attribute[0] != "host" or p.least is None:
                continue
            if isinstance(f, In) and not any(v is not None and p.least <= v <= p.most for v in f.value):
                return False
            if isinstance(f, EqualTo) and not p.least <= f.value <= p.most:
                return False
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and p.most < f.value or isinstance(f, (LessThan, LessThanOrEqual)) and p.least > f.value:
                return False
        return True

    def partitions(self) -> list[HostRange]:
        system, root = _open(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.type != fs.FileType.File or not info.base_name.endswith(".parquet"):
                continue
            meta = pq.read_metadata(info.path, filesystem=system)
            stats = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
            whole = stats and all(s is not None and s.has_min_max for s in stats)
            if meta.num_rows:
                out.append(HostRange(info.path, min(s.min for s in stats) if whole else None, max(s.max for s in stats) if whole else None))
        return [p for p in sorted(out, key=lambda p: p.path) if self._may_hold(p)]

    def read(self, partition: HostRange) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        test = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=names):
                for f in self.filters:
                    c = batch.column(f.attribute[0])
                    keep = pc.is_in(c, pa.array([v for v in f.value if v is not None], pa.string())) if isinstance(f, In) else test[type(f)](c, f.value)
                    batch = batch.filter(keep)
                if batch.num_rows:
                    yield batch


class PageStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagestore"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return PageStoreReader(self.options["path"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a store; the source is registered, and filters go into it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PageStore)
    return spark.read.format("pagestore").load(path)


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int


class TextSinkWriter(DataSourceStreamWriter):
    """Tasks write the column text to files of their own aside; a commit moves them to their batch's names and notes the batch. A batch
    that comes again replaces what it had written, and what a failed one left aside is deleted."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        system, root = _open(self.path)
        aside, n = f"{root}/_aside/{uuid.uuid4().hex}", 0
        system.create_dir(f"{root}/_aside")
        with system.open_output_stream(aside) as out:
            for r in rows:
                out.write(r["text"].encode())
                n += 1
        if not n:
            system.delete_file(aside)
        return Written(aside if n else None, n)

    def commit(self, messages: list, batchId: int) -> None:
        system, root = _open(self.path)
        system.create_dir(f"{root}/_batches")
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(f"batch-{batchId:010d}-"):
                system.delete_file(info.path)
        names = []
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            names.append(f"batch-{batchId:010d}-{i:05d}.txt")
            system.move(m.path, f"{root}/{names[-1]}")
        with system.open_output_stream(f"{root}/_batches/{batchId:010d}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list, batchId: int) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class TextSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventtext"

    def schema(self) -> str:
        return "text string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return TextSinkWriter(self.options["path"])


def write_text(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """A running query that writes the stream's column text to files; each batch once, whatever is tried again."""
    stream.sparkSession.dataSource.register(TextSink)
    q = stream.select("text").writeStream.format("eventtext").option("path", path).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
