"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a run of documents of one input partition. Its words become 64-bit hashes, documents
are kept apart by sentinels, and prefix doubling sorts all suffixes by as many words as the
longest test item has. Every suffix of every test item is then searched by binary search, word
by word, which gives its longest verbatim match and the range of all its places; where the match is at
least as long as a window, its places are hits. ``longest_matches`` takes the longest over all shards.

A document is one row of one shard, so there is no shuffle. The test items are written in blocks of about ``BLOCK_BYTES`` to the
shared folder, which tasks read one after another for each shard: one pass over the documents, and memory for one block, whatever the test items' size.

Null and empty texts have no words and no hits. Items without an id or a word are no items; several rows of one id are one item. Repeated rows give a row
each; an empty table gives none. A text is handled whole by one task, which takes some 60 bytes a byte of a text of over a mebibyte.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Words, free, lean, rows, scratch, text_bytes
from .files import get, put

WINDOW = 13
#: UTF-8 bytes of test items that are sent to the executors at once.
BLOCK_BYTES = 4 << 20


class Items:
    """Test items as one sequence of word hashes."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        w = Words([t for _, t in items], ALNUM_WORDS)
        self.ids = [i for i, _ in items]
        self.hash, self.item = w.hash, w.doc
        self.stop = (w.first + w.counts)[w.doc] if len(w.doc) else w.doc
        left = self.stop - np.arange(len(self.hash))
        size = w.counts[w.doc] if len(w.doc) else w.doc
        #: Words of the window that starts here; 0: none starts here.
        self.window = np.where(left >= window, window, np.where(left == size, size, 0))
        self.depth = int(w.counts.max()) if len(w.counts) else 0


def stable_order(key: np.ndarray) -> np.ndarray:
    """argsort(kind="stable"); narrow keys are sorted together with their places, which is much faster."""
    n = len(key)
    bits = max(1, n - 1).bit_length()
    if n and int(key.max()).bit_length() + bits <= 63:
        return np.sort(key.astype(np.int64) << bits | np.arange(n)) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` words or more; 0 is a sentinel that differs from any other."""
    n = len(seq)
    order = stable_order(seq)
    s = seq[order]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (s[1:] == 0)
    slot = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    k = 1
    while k < depth and len(tied):
        sub = order[tied]
        key = rank[sub] * np.int64(n + 1) + rank[np.minimum(sub + k, n)]
        by = stable_order(key)
        sub, key = sub[by], key[by]
        order[tied] = sub
        fresh = np.ones(len(sub), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[sub] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(sub)), 0))]
        tied = tied[~fresh | np.append(~fresh[1:], False)]
        k *= 2
    return order


def _bound(seq, order, lo, hi, j, word, upper: bool):
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        at = seq[np.minimum(order[mid] + j, len(seq) - 1)]
        right = at <= word[open_] if upper else at < word[open_]
        lo[open_] = np.where(right, mid + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], mid)


def search(seq: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, lo, hi) of each test suffix's longest match, and hits: (suffix, lo, hi) of windows that occur."""
    m = len(items.hash)
    length, first, last = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    live = np.arange(m)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(seq))
    hits, j = [], 0
    while len(live):
        word = items.hash[live + j]
        lo, hi = _bound(seq, order, lo, hi, j, word, False), _bound(seq, order, lo, hi, j, word, True)
        found = lo < hi
        live, lo, hi, j = live[found], lo[found], hi[found], j + 1
        length[live], first[live], last[live] = j, lo, hi
        at = items.window[live] == j
        if at.any():
            hits.append(np.stack([live[at], lo[at], hi[at]]))
        more = live + j < items.stop[live]
        live, lo, hi = live[more], lo[more], hi[more]
    return length, first, last, np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), np.int64)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the places of all ranges one after another."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[which]


class Shard:
    """The words of some documents with their suffix array."""

    def __init__(self, texts: list[bytes], depth: int):
        w = Words(texts, ALNUM_WORDS)
        self.words, n = w, len(texts)
        self.at = np.arange(len(w.hash)) + w.doc
        self.seq = np.zeros(len(w.hash) + n, np.uint64)
        self.seq[self.at] = w.hash
        self.doc = np.repeat(np.arange(n), w.counts + 1)
        self.base = w.first + np.arange(n)
        self.order = suffix_array(self.seq, depth)


@lru_cache(2)
def _load(uri: str) -> Items:
    return pickle.loads(get(uri))


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[list[str], int]:
    """Files of the test items in blocks of about ``BLOCK_BYTES``, and the words of the longest item."""
    known = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    folder, most = scratch(benchmark.sparkSession, "items"), BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, held, room, files = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            items = Items(held, window)
            put(uri := f"{folder}/{k:06d}-{files:06d}", pickle.dumps(items))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([items.depth])], names=["uri", "depth"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                held.append((i, t))
                room += len(t) + 1
                if room >= most:
                    yield flush()
                    held, room, files = [], 0, files + 1
        if held:
            yield flush()

    dealt = known.repartition(max(1, -(-size // BLOCK_BYTES)), F.xxhash64("id", "text"))
    found = dealt.mapInArrow(run, "uri string, depth long").collect()  # a row a block
    return sorted(r.uri for r in found), max((r.depth for r in found), default=0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", names: tuple[str, str, str] = ("__n", "__hits", "__items")) -> DataFrame:
    """All rows and columns, with words, places of words that some test window covers (as 64-bit integers) and items' ids in columns of these ``names`` (which replace the table's own)."""
    (text,) = free(docs, "__text")
    n, hits, ids = names
    out = lean(docs).withColumns({text: F.col(text_col).cast("string"), n: F.lit(0).cast("long"), hits: F.lit(b"").cast("binary"), ids: F.array().cast("array<string>")})
    blocks, depth = _blocks(benchmark, window, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches, text):
            shard = Shard(texts, depth)
            hit = np.zeros(len(shard.seq) + 1, np.int64)
            found: list[set] = [set() for _ in texts]
            for uri in blocks:
                items = _load(uri)
                _, _, _, (which, lo, hi) = search(shard.seq, shard.order, items)
                if len(which):
                    k, slot = _spread(lo, hi)
                    pos = shard.order[slot]
                    np.add.at(hit, pos, 1)
                    np.add.at(hit, pos + items.window[which[k]], -1)
                    for d, i in np.unique(np.stack([shard.doc[pos], items.item[which[k]]]), axis=1).T.tolist():
                        found[d].add(items.ids[i])
            inside = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            of = shard.doc[inside]
            place = (inside - shard.base[of]).astype(np.int64)
            ends = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            new = {n: pa.array(shard.words.counts), hits: pa.array([place[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), ids: pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(f, batch.column(i)) for i, f in enumerate(batch.schema.names)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema).drop(text)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """item_id, item_word, length, doc_id, doc_word: the longest verbatim match of each test suffix in all documents, if it is of ``least`` words or more, with all its places."""
    rows_in = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks, depth = _blocks(benchmark, WINDOW, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches):
            shard = Shard(texts, depth)
            for it in map(_load, blocks):
                begin = np.searchsorted(it.item, it.item)
                length, lo, hi, _ = search(shard.seq, shard.order, it)
                sel = np.flatnonzero(length >= least)
                k, slot = _spread(lo[sel], hi[sel])
                pos, q = shard.order[slot], sel[k]
                doc = shard.doc[pos]
                yield pa.RecordBatch.from_arrays([pa.array([it.ids[i] for i in it.item[q]], pa.string()), pa.array(q - begin[q]), pa.array(length[q]), batch.column(0).take(pa.array(doc)), pa.array(pos - shard.base[doc])], names=["item_id", "item_word", "length", "doc_id", "doc_word"])

    each = rows_in.mapInArrow(run, "item_id string, item_word long, length long, doc_id long, doc_word long")
    best = each.groupBy("item_id", "item_word").agg(F.max("length").alias("length"))
    return each.join(best, ["item_id", "item_word", "length"]).select(each.columns)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows whose words are not covered by test windows to a twentieth or more."""
    n, hits, items = free(docs, "__n", "__hits", "__items")
    c = contamination(docs, benchmark, window, names=(n, hits, items))
    return c.where(~contaminated((F.octet_length(hits) / 8).cast("long"), F.col(n))).select(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = c.withColumn("__n_hit", F.expr("octet_length(__hits) div 8"))
    return c.select("doc_id", F.col("__n").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("__items")), 256).alias("items_sha256"), contaminated(F.col("__n_hit"), F.col("__n")).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows by plain search, for tests."""
    import re

    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for d, t in docs:
        w, covered, ids = words(t), set(), set()
        for i, s in items:
            x = words(s)
            if i is None or not x:
                continue
            n = min(window, len(x))
            for a in range(len(x) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        covered.update(range(p, p + n))
                        ids.add(str(i))
        out.append((d, len(w), len(covered), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(covered) and 20 * len(covered) >= len(w)))
    return out
