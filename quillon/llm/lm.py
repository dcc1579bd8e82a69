"""A hierarchical Pitman-Yor language model over words.

Each context (the word before, as one of 2**k hash classes, k growing with the text) is a restaurant whose customers are the training tokens that follow it; its
tables are customers of the one parent restaurant, whose base is uniform over the V training words and one unseen word. Seatings are kept as the number of
tables that serve a word. A Gibbs sweep takes every word's customers out of their restaurants and seats them anew, all of one context at once: the number of tables is drawn from its exact conditional
distribution given the parent (generalised Stirling numbers, up to ``EXACT`` customers; beyond, one by one, then in blocks with the block's first probability), then that of the parent given its new customers, ``INNER`` times in turn.
Restaurants' totals are those of the sweep before. After ``BURN`` sweeps, ``DRAWS`` more are averaged into
predictive probabilities. Discounts are estimated from the counts of counts, the strength ``THETA`` is fixed.

Chunks of texts become lists of distinct (word, class) pairs with training counts, dealt by word to buckets that hold a word
with all its contexts. Sweeps run over the buckets; only the totals of each class meet. The buckets' answers go back to the chunks, which are read again,
as streams of places in those lists, and scored. A chunk's name holds a hash of its words: if a second reading gives other chunks, scoring stops with an error, so documents should come
from a table. Model and shuffle grow with the corpus; the driver sees two numbers a class, whose number grows with the text without a bound. A bucket's row of a very frequent word grows with the number of chunks.

Tokens are words (runs of bytes other than white space, ASCII case ignored) and one end a text; null texts are empty. Words are told apart by 64-bit hashes.
Repeated rows are scored one by one; rows without an id are training rows; an empty table gives none. Other columns are left out. A text is handled whole by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Words, cut, lean, rows, tidy
from .langid import held_out

BURN, DRAWS, INNER, THETA = 2, 3, 2, 1.0
#: Customers whose tables are drawn exactly, and that are seated one by one.
EXACT, ONE_BY_ONE = 64, 128
#: Contexts are at least 2**MIN_BITS classes, and one for every 64 KiB of text.
MIN_BITS = 16
#: Bytes of text in a chunk and in a bucket's share.
CHUNK, BUCKET = 3 << 20, 16 << 20
END, BEGIN = np.uint64(2), np.uint64(4)  # word hashes are odd


def _kind(classes: int) -> type:
    return np.uint16 if classes <= 1 << 16 else np.uint32


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, classes: int, stream: bool) -> Iterator[pa.RecordBatch]:
    """Rows for buckets (target, chunk, words, rest), or each chunk's stream, with target -1."""
    shift, seq = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None, 0
    for batch, texts in rows(batches, "text", CHUNK):
        w = Words(texts, SPACE_WORDS)
        n = len(w.hash) + len(texts)
        at = np.arange(len(w.hash)) + w.doc
        token = np.full(n, END)
        token[at] = w.hash
        size = w.counts + 1
        first = np.cumsum(size) - size
        before = np.append(BEGIN, token[:-1])
        before[first] = BEGIN
        context = ((before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (classes - 1).bit_length())).astype(np.int64)
        words, inv = np.unique(token, return_inverse=True)
        pairs, place = np.unique(inv * classes + context, return_inverse=True)
        train = np.repeat(~batch.column(2).to_numpy(zero_copy_only=False), size)
        count = np.bincount(place[train], minlength=len(pairs)).astype(np.uint32)
        each = np.bincount(pairs // classes, minlength=len(words)).astype(np.uint32)
        of = (words >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(words), np.int64)
        chunk = int((token * np.arange(1, 2 * n, 2, dtype=np.uint64)).sum() >> np.uint64(24)) ^ (TaskContext.get().partitionId() << 40 | seq << 20)
        seq += 1
        cuts = np.searchsorted(of, np.arange(buckets + 1))
        ends = np.concatenate([[0], np.cumsum(each.astype(np.int64))])
        out = []
        for b in range(0 if stream else buckets):
            i, j = cuts[b], cuts[b + 1]
            if i < j:
                p = slice(ends[i], ends[j])
                out.append((b, chunk, words[i:j].tobytes(), _squeeze(each[i:j], (pairs[p] % classes).astype(_kind(classes)), count[p])))
        if stream:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            head = np.concatenate([ids.fill_null(0).to_numpy(), null.astype(np.int64), size.astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)])
            out.append((-1, chunk, head.tobytes(), _squeeze(place.astype(np.uint32), each)))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["target", "chunk", "words", "rest"])


def _open(words: bytes, rest: bytes, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, pairs of each, classes and counts."""
    w, raw, kind = np.frombuffer(words, np.uint64), zlib.decompress(rest), np.dtype(_kind(classes))
    each = np.frombuffer(raw, np.uint32, len(w))
    n = int(each.sum())
    return w, each, np.frombuffer(raw, kind, n, 4 * len(w)), np.frombuffer(raw[4 * len(w) + kind.itemsize * n :], np.uint32, n)


_ASKED = pa.list_(pa.struct([("chunk", pa.int64()), ("words", pa.binary()), ("rest", pa.binary())]))


def _merge(table: pa.Table, classes: int) -> pa.Table:
    """A bucket's training pairs of all chunks, with the chunks' lists."""
    words, keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows_ = list(zip(table.column("words").to_pylist(), table.column("rest").to_pylist()))
    for a in range(0, len(rows_), 32):  # a few chunks at a time
        opened = [_open(*r, classes) for r in rows_[a : a + 32]]
        all_, inv = np.unique(np.concatenate([words, *(x[0] for x in opened)]), return_inverse=True)
        own, at = [inv[keys // classes] * classes + keys % classes], len(words)
        num = [counts]
        for w, each, k, c in opened:
            own.append(np.repeat(inv[at : at + len(w)], each) * classes + k)
            num.append(c.astype(np.int64))
            at += len(w)
        key, num_ = np.concatenate(own), np.concatenate(num)
        by = np.argsort(key, kind="stable")
        key, num_ = key[by], num_[by]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        keys, counts, words = key[head], np.add.reduceat(num_, head) if len(head) else num_, all_
        keep = counts > 0
        keys, counts = keys[keep], counts[keep]
        used = np.unique(keys // classes)
        new = np.zeros(len(words), np.int64)
        new[used] = np.arange(len(used))
        words, keys = words[used], new[keys // classes] * classes + keys % classes
    each = np.bincount(keys // classes, minlength=len(words)).astype(np.uint32)
    asked = pa.array([[{"chunk": c, "words": w, "rest": r} for c, (w, r) in zip(table.column("chunk").to_pylist(), rows_)]], _ASKED)
    return pa.table({"target": pa.array([table.column("target")[0].as_py()], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()), "rest": pa.array([_squeeze(each, (keys % classes).astype(_kind(classes)), counts.astype(np.uint32))], pa.binary()), "asked": asked})


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one; ``fresh`` is the weight of a new table."""
    tables = np.ones(len(customers), np.int64)
    live, seated = np.flatnonzero(customers > 1), 1
    while len(live):
        step = 1 if seated < ONE_BY_ONE else max(1, seated // 16)
        t, a = tables[live], fresh[live]
        p = a / (a + seated - discount * t)
        left = np.minimum(step, customers[live] - seated)
        new = rng.random(len(live)) < p if step == 1 else rng.binomial(left, p)
        tables[live] = t + new
        seated += step
        live = live[customers[live] > seated]
    return tables


def stirling(size: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of 0 to ``size`` customers at 0 to ``size`` tables."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, size + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(size):
            stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def tables(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish given its customers: t tables weigh S(customers, t) * fresh**t, drawn exactly up to ``EXACT`` customers."""
    out = np.minimum(customers, 1)
    s, most = stirling(EXACT, discount), int(customers.max(initial=0))
    for c in range(2, min(EXACT, most) + 1):
        at = np.flatnonzero(customers == c)
        if len(at):
            z = s[c, 1 : c + 1][None, :] + np.log(fresh[at])[:, None] * np.arange(1, c + 1)
            p = np.cumsum(np.exp(z - z.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (p < (rng.random(len(at)) * p[:, -1])[:, None]).sum(axis=1)
    if len(at := np.flatnonzero(customers > EXACT)):
        out[at] = seat(customers[at], fresh[at], discount, rng)
    return out


class State:
    """Discounts and totals that a sweep is drawn with."""

    def __init__(self, d: float, d0: float, customers: np.ndarray, tables: np.ndarray, root: float, root_tables: float, words: int):
        self.d, self.d0, self.customers, self.tables = d, d0, customers, tables
        self.root, self.root_tables, self.words = max(1.0, root), root_tables, words

    def base(self, n: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of words with n customers at r tables."""
        return (np.maximum(n - self.d0 * r, 0) + (THETA + self.d0 * self.root_tables) / (self.words + 1)) / (THETA + self.root)

    def draw(self, each: np.ndarray, k: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of each pair, and each word's customers and tables in the parent."""
        of = np.repeat(np.arange(len(each)), each)
        n = each.astype(np.int64)
        r, own = np.minimum(n, 1), np.full(len(n), (THETA + self.d0 * self.root_tables) / (self.words + 1))
        for _ in range(INNER):
            t = tables(c.astype(np.int64), (THETA + self.d * self.tables[k]) * self.base(n, r)[of], self.d, rng)
            n = np.bincount(of, t, len(each)).astype(np.int64)
            r = tables(n, own, self.d0, rng)
        return t, n, r


def _sweep(model: DataFrame, state: State, seed: int) -> State:
    """Draws all seatings and adds up their totals."""
    classes = len(state.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes + 2)
        for batch in batches:
            for target, words, rest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _, each, k, c = _open(words, rest, classes)
                t, n, r = state.draw(each, k, c, np.random.default_rng([seed, target]))
                total[:classes] += np.bincount(k, t, classes)
                total[classes:] += n.sum(), r.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "x"])

    total = np.zeros(classes + 2)
    for r in model.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        total[r.k] = r.x
    return State(state.d, state.d0, state.customers, total[:classes], total[classes], total[classes + 1], state.words)


def _start(model: DataFrame, classes: int) -> tuple[State, int]:
    """Totals of one table a pair, discounts from the counts of counts, and the training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(2 * classes + 6)
        for batch in batches:
            for words, rest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w, each, k, c = _open(words, rest, classes)
                x[:classes] += np.bincount(k, c, classes)
                x[classes : 2 * classes] += np.bincount(k, minlength=classes)
                x[2 * classes :] += (c == 1).sum(), (c == 2).sum(), (each == 1).sum(), (each == 2).sum(), len(w), c.sum()
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(x[at])], names=["k", "x"])

    x = np.zeros(2 * classes + 6)
    for r in model.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        x[r.k] = r.x
    c1, c2, e1, e2, words, tokens = x[2 * classes :]
    guess = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    tables = x[classes : 2 * classes]
    return State(guess(c1, c2), guess(e1, e2), x[:classes], tables, tables.sum(), words, int(words)), int(tokens)


def classes_of(size: int) -> int:
    """Classes of contexts for so many bytes of text."""
    return 1 << max(MIN_BITS, (size >> 16).bit_length())


def score(docs: DataFrame, train_held: tuple[int, int] = (5, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    known = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held", held_out("doc_id", *train_held))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(0, (size // BUCKET).bit_length())
    classes = classes_of(size)
    cut_up = "target long, chunk long, words binary, rest binary"
    merged = tidy(cut(known.mapInArrow(lambda x: _chunks(x, buckets, classes, False), cut_up).groupBy("target").applyInArrow(lambda t: _merge(t, classes), "target long, words binary, rest binary, asked array<struct<chunk: long, words: binary, rest: binary>>")))
    model = merged.drop("asked")
    state, tokens = _start(model, classes)
    for i in range(BURN):
        state = _sweep(model, state, i)
    states = [state]
    for i in range(DRAWS - 1):
        states.append(_sweep(model, states[-1], BURN + i))

    denominator = THETA + states[0].customers
    after = [*states[1:], _sweep(model, states[-1], BURN + DRAWS - 1)]  # what each draw makes of its state
    back = np.mean([THETA + s.d * s.tables for s in after], axis=0) / denominator

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk's list: each word's training count, and each pair's averaged log10 probability."""
        unseen = float(np.mean([s.base(np.zeros(1), np.zeros(1))[0] for s in after]))
        for batch in batches:
            for row, target in enumerate(batch.column(0).to_pylist()):
                w, each, k, c = _open(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), classes)
                of = np.repeat(np.arange(len(w)), each)
                p, weight = np.zeros(len(w)), np.zeros(len(c))
                for i, (s, made) in enumerate(zip(states, after)):
                    t, n, r = s.draw(each, k, c, np.random.default_rng([BURN + i, target]))
                    p += made.base(n, r) / len(states)
                    weight += np.maximum(c - s.d * t, 0) / len(states)
                keys, total = of * classes + k, np.bincount(of, c, len(w)).astype(np.uint32)
                for ask in batch.column(3)[row]:
                    x, each_, k_, _ = _open(ask["words"].as_py(), ask["rest"].as_py(), classes)
                    at = np.minimum(np.searchsorted(w, x), max(0, len(w) - 1))
                    hit = w[at] == x if len(w) else np.zeros(len(x), bool)
                    count, prob = np.zeros(len(x), np.uint32), np.full(len(x), unseen)
                    count[hit], prob[hit] = total[at[hit]], p[at[hit]]
                    want = np.repeat(np.where(hit, at, -1), each_) * classes + k_
                    j = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                    val = np.where(keys[j] == want, weight[j], 0) if len(keys) else np.zeros(len(want))
                    log = np.log10(val / denominator[k_] + back[k_] * np.repeat(prob, each_))
                    yield pa.RecordBatch.from_arrays([pa.array([ask["chunk"].as_py()]), pa.array([target]), pa.array([_squeeze(count)], pa.binary()), pa.array([_squeeze(log.astype(np.float32))], pa.binary())], names=["chunk", "bucket", "byword", "bypair"])

    # The lists that were dealt are in the checkpoint too: they go before the answers take their place.
    answers = tidy(merged).select("target", "words", "rest", "asked").mapInArrow(answer, "chunk long, bucket long, byword binary, bypair binary")

    def judge(key: tuple, stream: pa.Table, heard: pa.Table) -> pa.Table:
        """Scores of a chunk's texts."""
        if stream.num_rows != 1 or not heard.num_rows:
            raise ValueError("the documents were cut into other chunks when they were read again")
        order = np.argsort(heard.column("bucket").to_numpy(), kind="stable")
        whole = lambda f, kind: np.concatenate([np.frombuffer(zlib.decompress(heard.column(f)[int(i)].as_py()), kind) for i in order])
        count, log_model = whole("byword", np.uint32), whole("bypair", np.float32).astype(float)
        head = np.frombuffer(stream.column("words")[0].as_py(), np.int64).reshape(4, -1)
        raw = zlib.decompress(stream.column("rest")[0].as_py())
        n = int(head[2].sum())
        place, word = np.frombuffer(raw, np.uint32, n), np.repeat(np.arange(len(count)), np.frombuffer(raw, np.uint32, len(count), 4 * n))
        log_base = np.log10((count + 0.5) / (tokens + 0.5 * (state.words + 1)))[word]
        starts = np.cumsum(head[2]) - head[2]
        add = lambda v: np.add.reduceat(v[place], starts)
        return pa.table({"doc_id": pa.array(head[0], mask=head[1].astype(bool)), "held_out": pa.array(head[3].astype(bool)), "n_tokens": pa.array(head[2]), "n_known": pa.array(add((count > 0)[word].astype(np.int64))), "train_tokens": pa.array(np.full(len(starts), tokens)), "base_score": pa.array(np.round(add(log_base), 6)), "score": pa.array(np.round(add(log_model), 6))})

    streams = known.mapInArrow(lambda x: _chunks(x, buckets, classes, True), cut_up).select("chunk", "words", "rest")
    return streams.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """Each text's score by the model, and by single words."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
