"""Language identification with blended-spectrum string kernels.

A text is the set of its byte 1- to 4-grams (ASCII lower-cased). The kernel of two texts is the size
of the sets' intersection over the root of the product of their sizes. Landmark texts give a
Nystroem approximation, in which one ridge regression per language is fitted against the rest.
Texts are scored in batches: presence rows times landmark rows, over norms, times coefficients.

The classifier is fitted on a bounded sample: at most ``PER_LANG`` labelled rows a language and
``SAMPLE_ROWS`` in all, those with the smallest hashes of doc_id. Every text is scored whole.
Null texts and texts without a letter are ``und`` with score 0; so is all if no row has a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, lean, rows

#: Labelled rows for fitting: per language and in all. Landmarks per language and in all.
PER_LANG, SAMPLE_ROWS, LANDMARKS, MAX_LANDMARKS = 200, 4096, 24, 512
RIDGE = 1e-3
BATCH = 128


def spectrum(text: bytes, order: int = 4) -> list[np.ndarray]:
    """Sorted distinct n-grams of 1 to ``order`` (at most 4) bytes; first byte lowest."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    out: list[np.ndarray] = []
    for n in range(order, 0, -1):
        if out and len(b) > n:  # prefixes of the longer grams, and the last gram
            g = np.append(out[-1] & np.uint32((1 << 8 * n) - 1), sum(b[len(b) - n + k] << np.uint32(8 * k) for k in range(n)))
        elif len(b) >= n:
            g = sum(b[k : len(b) - n + 1 + k] << np.uint32(8 * k) for k in range(n))
        else:
            g = np.zeros(0, np.uint32)
        out.append(np.unique(g))
    return out[::-1]


class Model:
    """Landmarks, their features and one column of coefficients a language."""

    def __init__(self, sample: list[tuple[bytes, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted({lang for _, lang in sample})
        picked, seen = [], dict.fromkeys(self.langs, 0)
        for text, lang in sample:
            if seen[lang] < min(landmarks, MAX_LANDMARKS // len(self.langs) or 1) and text:
                seen[lang] += 1
                picked.append(text)
        marks = [spectrum(t) for t in picked]
        self.grams = [np.unique(np.concatenate([m[n] for m in marks])) if marks else np.zeros(0, np.uint32) for n in range(4)]
        self.base = np.cumsum([0, *map(len, self.grams)])
        rows_, norm = self._presence(marks)
        self.marks = np.ascontiguousarray((rows_ / norm[:, None]).T)
        k = rows_ @ self.marks / norm[:, None]
        w, v = np.linalg.eigh(k.astype(np.float64))
        keep = w > 1e-6 * max(1e-12, w.max(initial=0))
        half = v[:, keep] / np.sqrt(w[keep])
        phi = np.concatenate([self._kernel([spectrum(t) for t, _ in sample[a : a + BATCH]]) for a in range(0, len(sample), BATCH)]) @ half
        y = np.array([[lang == x for x in self.langs] for _, lang in sample], float)
        weight = (1 / (len(self.langs) * y.sum(axis=0)))[y.argmax(axis=1)] * len(y)
        gram = (phi * weight[:, None]).T @ phi
        self.coef = (half @ np.linalg.solve(gram + ridge * len(y) * np.eye(len(gram)), (phi * weight[:, None]).T @ y)).astype(np.float32)

    def _presence(self, specs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(specs), int(self.base[-1])), np.float32)
        for i, s in enumerate(specs):
            for n, g in enumerate(s):
                if len(g) and len(self.grams[n]):
                    at = np.searchsorted(self.grams[n], g)
                    at[at == len(self.grams[n])] = 0
                    out[i, self.base[n] + at[self.grams[n][at] == g]] = 1
        return out, np.sqrt(np.maximum(1, np.array([sum(map(len, s)) for s in specs], np.float32)))

    def _kernel(self, specs: list[list[np.ndarray]]) -> np.ndarray:
        p, norm = self._presence(specs)
        return p @ self.marks / norm[:, None]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for a in range(0, len(texts), BATCH):
            part = texts[a : a + BATCH]
            f = self._kernel([spectrum(t) for t in part]) @ self.coef
            best = f.argmax(axis=1)
            for i, t in enumerate(part):
                if any(map(str.isalpha, t.decode("utf-8", "replace"))):
                    names.append(self.langs[best[i]])
                    scores[a + i] = min(1.0, max(0.0, round(float(f[i, best[i]]), 6)))
                else:
                    names.append("und")
        return names, scores


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, train: Column | None = None) -> Model | None:
    """A model of the rows that ``train`` allows; None if none of them has a language and a text."""
    ok = (train if train is not None else ~held_out()) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ids = docs.where(ok).select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= PER_LANG)
    few = ranked.orderBy("r", "h", "lang").limit(SAMPLE_ROWS).select(F.col("doc_id").alias("id"), "r")
    picked = docs.where(ok).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("id")), "inner").select("r", "doc_id", "lang", "text")
    sample = sorted({(r.r, str(r.doc_id), r.lang, r.text) for r in picked.collect()})
    return Model([(t.encode(), lang) for _, _, lang, t in sample]) if sample else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """All rows and columns, with language and score in columns of these ``names`` (which replace the table's own)."""
    (text,) = free(docs, "__text")
    lang, score = names
    out = lean(docs).withColumns({text: F.col(text_col).cast("string"), lang: F.lit("und").cast("string"), score: F.lit(0.0).cast("double")})
    if model is None:
        return out.drop(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches, text):
            found, scores = shared.value.predict(texts)
            new = {lang: pa.array(found, pa.string()), score: pa.array(scores)}
            yield pa.RecordBatch.from_arrays([new.get(f, batch.column(i)) for i, f in enumerate(batch.schema.names)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema).drop(text)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language, at any score; if no row has a label to learn from, those with a letter."""
    lang, score = free(docs, "__lang", "__score")
    model = fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, model, names=(lang, score)).where(F.col(lang) != "und").select(*docs.columns)


def op2_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
