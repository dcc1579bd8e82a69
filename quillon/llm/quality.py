"""Text quality by supervised subword embeddings.

Words (ASCII case ignored), pairs of one word twice, and byte 3- and 5-grams (case kept) are hashed to buckets with learned
vectors; a text is the average of its features' vectors, and a softmax over it gives the classes.
Training is numpy stochastic gradient descent with per-weight step sizes, on a bounded sample: at most
``PER_CLASS`` labelled rows a class, those with the smallest hashes of doc_id, outside the held-out fold; both classes weigh the same.

As the average is linear, scoring adds one number a feature: each bucket's vector times the classes'
difference, in fixed point, so equal texts have equal scores wherever they stand. Null and empty texts
have no feature and get the share that the biases give. Without labels of both classes scores are that of the one, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Words, free, lean, mix, rows
from .langid import held_out

#: Labelled rows a class that training takes at most.
PER_CLASS = 3000
BITS, DIM, EPOCHS, RATE, BATCH = 17, 8, 8, 0.1, 32
GRAMS = (3, 5)
#: The bucket of all word pairs of one word twice.
REPEAT = 0
_SCALE = float(1 << 24)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each feature, by kind."""
    w = Words(texts, SPACE_WORDS)
    shift = np.uint64(64 - BITS)
    yield (mix(w.hash) >> shift).astype(np.int32), w.doc
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1
    yield np.full(len(again), REPEAT, np.int32), w.doc[again]
    of = np.repeat(np.arange(len(texts)), np.diff(w.text_ends, prepend=0))
    left = w.text_ends[of] - np.arange(len(w.buf))
    b = w.buf.astype(np.uint64)
    for n in GRAMS:
        g = np.zeros(max(0, len(b) - n + 1), np.uint64)
        for k in range(n):
            g |= b[k : k + len(g)] << np.uint64(8 * k)
        ok = left[: len(g)] > n  # the line end that parts the texts is in no gram
        g = g[ok] | np.uint64(n << 56)
        yield ((g * np.uint64(0x9E3779B97F4A7C15) ^ (g >> np.uint64(13))) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift).astype(np.int32), of[: len(ok)][ok]


class Model:
    def __init__(self, texts: list[bytes], labels: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.table, self.bias = np.zeros(1 << BITS, np.int64), 0.0
        if len(set(labels.tolist())) < 2:
            self.bias = 20.0 * (2 * self.prior - 1)
            return
        index, weight = [], []
        for t in texts:
            f = np.concatenate([x for x, _ in features([t])])
            u, c = np.unique(f, return_counts=True)
            index.append(u)
            weight.append((c / max(1, len(f))).astype(np.float32))
        e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        share = (len(labels) / 2 / np.bincount(labels, minlength=2)).astype(np.float32)
        sums = [np.full_like(x, 1e-8) for x in (e, out, bias)]
        for _ in range(EPOCHS):
            todo = rng.permutation(len(texts))
            for a in range(0, len(todo), BATCH):
                part = [i for i in todo[a : a + BATCH] if len(index[i])]
                if not part:
                    continue
                size = np.array([len(index[i]) for i in part])
                idx, wt = np.concatenate([index[i] for i in part]), np.concatenate([weight[i] for i in part])
                h = np.add.reduceat(e[idx] * wt[:, None], np.cumsum(size) - size, axis=0)
                z = h @ out + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                d = p / p.sum(axis=1, keepdims=True)
                d[np.arange(len(part)), labels[part]] -= 1
                d *= share[labels[part]][:, None]
                back = np.repeat(d @ out.T, size, axis=0) * wt[:, None]
                rows_, inv = np.unique(idx, return_inverse=True)
                ge = np.stack([np.bincount(inv, back[:, k], len(rows_)) for k in range(DIM)], axis=1).astype(np.float32)
                for x, s, g, r in ((e, sums[0], ge, rows_), (out, sums[1], h.T @ d, slice(None)), (bias, sums[2], d.sum(axis=0), slice(None))):
                    s[r] += g * g
                    x[r] -= RATE * g / np.sqrt(s[r])
        self.table = np.round((e @ (out[:, 1] - out[:, 0])).astype(np.float64) * _SCALE).astype(np.int64)
        self.bias = float(bias[1] - bias[0])

    def predict(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for f, of in features(texts):
            run = np.concatenate([[0], np.cumsum(self.table[f])])
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            total += np.diff(run[ends])
            count += np.diff(ends)
        z = total / _SCALE / np.maximum(1, count) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("id", 5, 0)).distinct()
    known = known.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= PER_CLASS)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    sample = sorted({(r.id, r.y, r.text or "") for r in picked.collect()})
    return Model([t.encode() for *_, t in sample], np.array([y for _, y, _ in sample], int))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """All rows and columns, with how likely the label is 1 in a column ``name`` (which replaces the table's own)."""
    (text,) = free(docs, "__text")
    out = lean(docs).withColumns({text: F.col(text_col).cast("string"), name: F.lit(0.0).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches, text):
            new = {name: pa.array(np.round(shared.value.predict(texts), 9))}
            yield pa.RecordBatch.from_arrays([new.get(f, batch.column(i)) for i, f in enumerate(batch.schema.names)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema).drop(text)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
