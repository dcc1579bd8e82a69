"""Readers of the engine's own files, with the checks that a build relies on."""

from __future__ import annotations

import json
import struct
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contiguous(rows: DataFrame, key: str) -> DataFrame:
    """The rows, if their keys are 0 to n - 1, each once; others are an error."""
    r = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if r.n and (r.lo, r.hi, r.d) != (0, r.n - 1, r.n):
        raise ValueError(f"{key} is not 0 to {r.n - 1}: {r.d} values from {r.lo} to {r.hi}")
    return rows


def item_text(spark: SparkSession, path: str) -> DataFrame:
    """(item_idx, description) of a CSV file with a header; ids must be contiguous."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return contiguous(rows.select(F.col("item_idx").cast("int").alias("item_idx"), F.coalesce("description", F.lit("")).alias("description")), "item_idx")


def sequences(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """(user_idx, items) of JSON lines, of ``least`` items or more."""
    return spark.read.schema("user_idx int, items array<int>").json(path).where(F.size("items") >= least)


def samples(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """(row_ord, history, target) of JSON lines; the first ``most``, all if it is 0."""
    rows = spark.read.schema("history array<int>, target int").json(path).withColumn("row_ord", F.monotonically_increasing_id())
    return rows.orderBy("row_ord").limit(most) if most > 0 else rows


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a place column that counts from 0, by a filter that scans can push down."""
    return rows.where(F.col(order) < n)


def config(path: str) -> dict:
    """A JSON object; empty if the file isn't there."""
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def layout(codes: DataFrame, known: dict | None = None) -> list[tuple[int, str, int]]:
    """(position, name, clusters) of code lists: from a configuration's "sizes" if it has them, else by the greatest code; lists of several lengths or without codes are an error."""
    r = codes.agg(F.min(F.size("codes")).alias("lo"), F.max(F.size("codes")).alias("hi")).first()
    if not r.lo or r.lo != r.hi:
        raise ValueError("code lists are of one length of 1 or more")
    sizes = list((known or {}).get("sizes", []))
    if sizes and len(sizes) != r.lo:
        raise ValueError(f"{len(sizes)} sizes for codes of {r.lo} positions")
    if not sizes:
        top = codes.select(F.posexplode("codes").alias("pos", "code")).groupBy("pos").agg(F.max("code").alias("most")).collect()  # a row a position
        sizes = [x.most + 1 for x in sorted(top, key=lambda x: x.pos)]
    return [(i, f"code_{i}", int(n)) for i, n in enumerate(sizes)]


def tokens(codes: DataFrame, key: str, least: int = 0) -> tuple[DataFrame, int, int, int]:
    """(key, tokens) of items' offset codes with the parting token, the first token and the vocabulary: one, two and three over the greatest code. Keys must be contiguous and ``least`` or more."""
    r = contiguous(codes, key).agg(F.count("*").alias("n"), F.max(F.array_max("codes")).alias("most")).first()
    if r.n < least:
        raise ValueError(f"codes of {r.n} items, {least} are wanted")
    most = -1 if r.most is None else int(r.most)
    return codes.select(key, F.col("codes").cast("array<long>").alias("tokens")), most + 1, most + 2, most + 3


def catalogue(path: str) -> list[dict]:
    """Name, shape, type, order, sizes and compression of an archive's arrays, from their headers alone."""
    out = []
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            with z.open(info) as f:
                if f.read(6) != b"\x93NUMPY":
                    continue
                major = f.read(2)[0]
                size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
                about = f.read(size).decode("latin-1").strip()
            import ast

            d = ast.literal_eval(about)
            out.append({"name": info.filename.removesuffix(".npy"), "shape": list(d["shape"]), "dtype": str(d["descr"]), "order": "F" if d["fortran_order"] else "C", "bytes": info.file_size, "stored": info.compress_size, "compressed": info.compress_type != zipfile.ZIP_STORED})
    return out
