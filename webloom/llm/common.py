"""Helpers the operators share: Arrow row mapping, shared storage, size-checked collection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from webloom.checkpointing import shared_folder

#: Rows that one output batch of a Python stage holds, and bytes of text it works on at a time.
SLICE_ROWS = 1024
SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch, text_col: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has much more than SLICE_BYTES of text (a longer text stands alone)."""
    start, size = 0, 0
    column = batch.column(text_col)
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and (size + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, text_col: str, make: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """Apply make()(columns as lists) to slices of each partition; make runs once a partition.

    Rows stay where they are: no shuffle, and memory is bounded by a slice or the longest text."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    at = df.columns.index(text_col)

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, at):
                out = f({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                columns = [out[x.name] for x in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(x.type) if isinstance(c, pa.Array) else pa.array(c, x.type) for c, x in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def map_columns(df: DataFrame, run: Callable) -> DataFrame:
    """mapInArrow to the same columns, whatever their names (with dots, or twice); run sees them as c0, c1, ..."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (tests)."""
    return shared_folder(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def drop_stored(spark: SparkSession) -> None:
    """Delete what stored() wrote in this process; results that still read it must have been written out before."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
