"""Lines of JSON or Python literals, and array files."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_loose(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of ``schema`` with ``row_ord``; lines that JSON can't parse are read as Python literals. Blank lines are skipped.

    Compressed text is one partition, so it is dealt out after the line numbers are given.
    """
    lines = spark.read.text(path).withColumn("row_ord", F.monotonically_increasing_id()).where(F.trim("value") != "")
    if partitions:
        lines = lines.repartition(partitions)

    good = F.get_json_object("value", "$").isNotNull()

    def literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for line in b.column(0).to_pylist():
                try:
                    out.append(json.dumps(ast.literal_eval(line)))
                except (ValueError, SyntaxError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(1)], names=["value", "row_ord"])

    other = lines.where(~F.coalesce(good, F.lit(False))).mapInArrow(literals, "value string, row_ord long")  # only lines that aren't JSON go to Python
    return lines.where(good).unionByName(other).withColumn("r", F.from_json("value", schema)).select("row_ord", "r.*")


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class ArrayFile(DataSource):
    """format("array_file").load(x.npy or x.npz with option key): (row_id, values), a partition a range of rows."""

    @classmethod
    def name(cls) -> str:
        return "array_file"

    def schema(self) -> str:
        return "row_id long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self.options["path"], self.options.get("key"), int(self.options.get("rows", 65536)))


class _ArrayReader(DataSourceReader):
    def __init__(self, path: str, key: str | None, rows: int):
        self.path, self.key, self.rows = path, key, rows

    def _open(self):
        import numpy as np

        x = np.load(self.path, mmap_mode=None if self.key else "r", allow_pickle=False)
        return x[self.key] if self.key else x

    def partitions(self) -> list[_Rows]:
        n = len(self._open())
        return [_Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        x = self._open()[partition.start : partition.end]
        for i, row in enumerate(x.reshape(len(x), -1).astype(float).tolist()):
            yield partition.start + i, row


def profile(df: DataFrame, column: str) -> DataFrame:
    """n, least, most, mean, population deviation and distinct values of a numeric column."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count_distinct(c).alias("distinct_values"))
