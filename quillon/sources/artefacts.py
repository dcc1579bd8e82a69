"""A build's results as Parquet: codes, codebooks, projection and category tables; and small charts."""

from __future__ import annotations

import json
from html import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_codes(codes: DataFrame, path: str) -> None:
    """Codes or projected vectors, a row an item."""
    codes.write.mode("error").parquet(path)


def write_matrices(spark: SparkSession, matrices: dict[str, np.ndarray], path: str) -> None:
    """(name, row, vector) of codebooks, rotations, components and category tables (all of a model's size)."""
    rows = [(name, i, [float(v) for v in np.atleast_1d(row)]) for name, m in matrices.items() for i, row in enumerate(np.atleast_2d(m))]
    spark.createDataFrame(rows, "name string, row int, vector array<double>").write.mode("error").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    out: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "row").collect():
        out.setdefault(r.name, []).append(r.vector)
    return {k: np.array(v) for k, v in out.items()}


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A small list of objects as CSV with a header; an empty list is an empty folder of one empty file."""
    if rows:
        columns = list(rows[0])
        spark.createDataFrame([tuple(str(r.get(c, "")) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.mode("error").option("header", True).csv(path)
    else:
        spark.createDataFrame([], "value string").coalesce(1).write.mode("error").text(path)


def human_bytes(n: float) -> str:
    """A size with a unit of 1,024."""
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TiB"


def axis(values: list[float]) -> tuple[float, float]:
    """A range with a twentieth to spare around the finite values."""
    x = [v for v in values if v is not None and np.isfinite(v)]
    lo, hi = (min(x), max(x)) if x else (0.0, 1.0)
    room = (hi - lo) * 0.05 or abs(hi) * 0.05 or 1.0
    return lo - room, hi + room


def bars(title: str, labels: list[str], values: list[float], width: int = 640, height: int = 320) -> str:
    """An SVG bar chart of a small table; numbers that aren't finite have no bar."""
    top = max(axis([0.0, *values])[1], 1e-12)
    step = (width - 80) / max(1, len(values))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', f'<text x="40" y="24">{escape(title)}</text>']
    for i, (name, v) in enumerate(zip(labels, values)):
        if v is None or not np.isfinite(v):
            continue
        h = max(0.0, v) / top * (height - 90)
        x = 40 + i * step
        out.append(f'<rect x="{x:.1f}" y="{height - 40 - h:.1f}" width="{step * 0.8:.1f}" height="{h:.1f}"><title>{escape(str(name))}: {v:g}</title></rect>')
        out.append(f'<text x="{x:.1f}" y="{height - 20}" font-size="10">{escape(str(name))}</text>')
    return "\n".join([*out, "</svg>"])


def chart(df: DataFrame, title: str, label: str, value: str, most: int = 300) -> str:
    """The chart of a table's first ``most`` rows."""
    rows = df.select(F.col(label).cast("string"), F.col(value).cast("double")).limit(most).collect()
    return bars(title, [r[0] for r in rows], [r[1] for r in rows])


def metadata(values: dict) -> str:
    """A model's settings and measures as JSON, keys sorted."""
    return json.dumps(values, sort_keys=True, default=str, indent=1)
