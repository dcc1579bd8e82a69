"""Nearest codewords, residual and product codebooks, and principal components.

Dense arithmetic runs in numpy over Arrow batches; what leaves a task is of the codebook's size. Training
is Lloyd's iteration from rows picked by a hash, sums in double, so results do not hang on partitions beyond rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest of the nearest centers, and its squared distance."""
    half = (centers * centers).sum(axis=1)
    k, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 4096):  # a batch's products; centers that rounding can't part are measured again
        part = x[a : a + 4096]
        s = half[None, :] - 2 * (part @ centers.T)
        best = s.argmin(axis=1)
        low = s[np.arange(len(part)), best]
        tied = np.flatnonzero((s <= (low + 1e-9 * (1 + np.abs(low)))[:, None]).sum(axis=1) > 1)
        for i in tied:
            best[i] = ((part[i] - centers) ** 2).sum(axis=1).argmin()
        k[a : a + 4096], d[a : a + 4096] = best, ((part - centers[best]) ** 2).sum(axis=1)
    return k, d


def residual_codes(rows: DataFrame, key: str, column: str, books: list[np.ndarray], rotation: np.ndarray | None = None, products: list[np.ndarray] | None = None) -> DataFrame:
    """(key, codes, error): a code a level of residual codebooks, then one a product codebook of the rotated rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, codes = _matrix(b.column(1)), []
            if not len(x):
                continue
            for book in books:
                k, d = nearest(x, book)
                codes.append(k)
                x = x - book[k]
            if products:
                y = x @ rotation
                d = np.zeros(len(x))
                wide = y.shape[1] // len(products)
                for i, book in enumerate(products):
                    k, e = nearest(y[:, i * wide : (i + 1) * wide], book)
                    codes.append(k)
                    d += e
            flat = pa.array(np.stack(codes, axis=1).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(codes), dtype=np.int32)), flat), pa.array(d)], names=["key", "codes", "error"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>")).mapInArrow(run, "key long, codes array<int>, error double")


def _fit(rows: DataFrame, column: str, change, start: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's iteration on change(matrix); a center without rows stays."""
    centers = start
    for _ in range(rounds):
        now = centers

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros_like(now), np.zeros(len(now))
            for b in batches:
                x = change(_matrix(b.column(0))) if len(b.column(0)) else np.zeros((0, now.shape[1]))
                k = nearest(x, now)[0] if len(x) else np.zeros(0, int)
                np.add.at(sums, k, x)
                count += np.bincount(k, minlength=len(now))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), pa.array(count), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "n", "s"])

        parts = rows.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "k long, n double, s array<double>")
        total = parts.select("k", "n", F.posexplode("s").alias("j", "v")).groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        centers = centers.copy()
        for r in total.where("n > 0").collect():  # as many rows as the codebook has numbers
            centers[r.k, r.j] = round(r.v / r.n, 9)
    return centers


def _seeds(rows: DataFrame, key: str, column: str, k: int, salt: int) -> np.ndarray:
    few = rows.orderBy(F.xxhash64(F.col(key), F.lit(salt)), key).limit(k).select(F.col(column).cast("array<double>").alias("x")).collect()
    x = np.array([r.x for r in few], float)
    return np.resize(x, (k, x.shape[1]))


def train_residual(rows: DataFrame, key: str, column: str, levels: int, clusters: int, rounds: int = 5) -> list[np.ndarray]:
    """A codebook a level, each fitted to what the ones before leave."""
    books: list[np.ndarray] = []
    for level in range(levels):
        have = list(books)
        books.append(_fit(rows, column, lambda x, have=have: _rest(x, have), _rest(_seeds(rows, key, column, clusters, level), have), rounds))
    return books


def _rest(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    for b in books:
        x = x - b[nearest(x, b)[0]]
    return x


def train_product(rows: DataFrame, key: str, column: str, books: list[np.ndarray], parts: int, clusters: int, outer: int = 2, rounds: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation, and a codebook for each slice of the rotated rest; the rotation is the orthogonal fit of rest to its codewords, none after the last round."""
    first = _rest(_seeds(rows, key, column, clusters, 1009), books)
    dim = first.shape[1]
    wide, rotation = dim // parts, np.eye(dim)
    products = [first[:, i * wide : (i + 1) * wide].copy() for i in range(parts)]
    for step in range(outer):
        now = rotation
        products = [_fit(rows, column, lambda x, i=i, now=now: (_rest(x, books) @ now)[:, i * wide : (i + 1) * wide], products[i], rounds) for i in range(parts)]
        if step + 1 < outer:
            have = list(products)

            def run(batches: Iterator[pa.RecordBatch], now=now, have=have) -> Iterator[pa.RecordBatch]:
                total = np.zeros((dim, dim))
                for b in batches:
                    if len(b.column(0)):
                        r = _rest(_matrix(b.column(0)), books)
                        y = r @ now
                        total += r.T @ np.hstack([c[nearest(y[:, i * wide : (i + 1) * wide], c)[0]] for i, c in enumerate(have)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

            cross = np.zeros((dim, dim))
            for r in rows.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
                cross[r.i, r.j] = r.v
            u, _, vt = np.linalg.svd(cross)
            rotation = u @ vt
    return rotation, products


def principal(rows: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k components (the largest loading positive) and their shares of variance, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b.column(0)):
                x = _matrix(b.column(0))
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    found = rows.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max(r.i for r in found) + 1
    m = np.zeros((d, d))
    for r in found:
        m[r.i, r.j] = r.v
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = (m[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k].T
    top *= np.sign(top[np.arange(k), np.abs(top).argmax(axis=1)])[:, None]
    return mean, top, values[::-1][:k] / values.sum()


def unrotated(codes: np.ndarray, products: list[np.ndarray], rotation: np.ndarray) -> np.ndarray:
    """Codewords of product codes, turned back by the rotation's inverse (its transpose)."""
    return np.hstack([book[codes[:, i]] for i, book in enumerate(products)]) @ rotation.T


def reconstructed(codes: DataFrame, key: str, books: list[np.ndarray], rotation: np.ndarray | None = None, products: list[np.ndarray] | None = None) -> DataFrame:
    """(key, vector): the sum of the residual codewords and, with products, of the product codewords turned back."""
    products = products or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = sum(book[c[:, i]] for i, book in enumerate(books))
                if products:
                    y = y + unrotated(c[:, len(books) :], products, rotation)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["key", "vector"])

    return codes.select(F.col(key).cast("long").alias("key"), "codes").mapInArrow(run, "key long, vector array<double>")
