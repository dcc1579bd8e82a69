"""Codes for new items as they arrive, and windowed counts of late events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.quantize import residual_codes


def assign_stream(items: DataFrame, key: str, column: str, books: list[np.ndarray], path: str, checkpoint: str):
    """Starts a query that appends (key, codes, error) of each new item by frozen codebooks."""
    return residual_codes(items, key, column, books).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()


def counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Events of each kind in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
