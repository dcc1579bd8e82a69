"""Tables of codes and samples as CSV, JSON lines and Parquet, and one-row measures as JSON.

Spark writes one file a partition; nothing but one-row aggregates and stated heads passes through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sid_table(codes: DataFrame, key: str, sizes: list[int], column: str = "codes") -> DataFrame:
    """key, sid_0.., sid_offset_0.., sid and sid_offset: one column a position, and both as text."""
    from quillon.functions.vectors import code_text, offset_codes

    at = lambda c, i: F.get(c, F.lit(i))
    shifted: Column = offset_codes(F.col(column), sizes)
    each = [at(F.col(column), i).alias(f"sid_{i}") for i in range(len(sizes))] + [at(shifted, i).alias(f"sid_offset_{i}") for i in range(len(sizes))]
    return codes.select(key, *each, code_text(F.col(column)).alias("sid"), code_text(shifted).alias("sid_offset"))


def write_csv(df: DataFrame, path: str, head: tuple[str, int] | None = None) -> None:
    """Rows with a header; with ``head`` (column, n) only rows whose column is below n, which the scan can push down."""
    if head:
        df = df.where(F.col(head[0]) < head[1])
    flat = [F.array_join(F.col(f.name).cast("array<string>"), " ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("error").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row; arrays stay arrays, nulls are left out."""
    df.write.mode("error").json(path)


def measures(df: DataFrame) -> str:
    """A one-row table as a JSON object; more rows are an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("measures are one row")
    return json.dumps(rows[0].asDict(recursive=True), default=str, sort_keys=True)


def report(title: str, parts: dict[str, DataFrame], most: int = 100) -> str:
    """Markdown of some small tables; the first ``most`` rows of each, said where there are more."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out += ["", f"The first {most} rows."]
    return "\n".join(out) + "\n"
