"""Token ids in files coded by a static range asymmetric numeral system.

A task writes one range of the documents in files of about ``FILE_BYTES`` of text (a longer text is a file of its own), one after another, so its
memory doesn't grow with the range. A file's frequency table is counted over all its ids and shared by
its blocks; a block is coded on its own by up to ``LANES`` interleaved states and has a checkpoint (place, first id, checksum) in
the footer, so that blocks decode in parallel and in any order: a reading task takes ``RUN`` blocks of a file. Layout, little-endian:

magic, ids, documents, symbols, size of the tables | zlib: symbols, frequencies, document ids, null marks, document lengths | blocks |
checkpoints: place, first id, ids, crc32 | place of the checkpoints, their crc32, magic

A block: 64-bit states, then 32-bit words in the order in which decoding takes them.

Null and empty texts have the end id alone. Ids are in ascending order of doc_id, null first; repeated rows stay, rows of one id are in the order of their texts' 64-bit hashes
and may go to several tasks. Other columns are not stored. An empty table has no files and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACE_WORDS, Words, chunked, cut, lean, scratch, text_bytes
from .files import get, put

MAGIC = b"QRNS0001"
PRECISION, LANES, BLOCK = 20, 1024, 1 << 18
#: Bytes of text of a file, ranges at most (more text makes ranges of several files), and blocks that one task reads.
FILE_BYTES, MAX_RANGES, RUN = 16 << 20, 20000, 8
#: Distinct words that a worker remembers.
MEMO = 800_000
#: Marks that are cut off where they end a word.
MARKS = b".,;:!?#*%&$"
#: Words of a-z and the small letters U+00DF to U+00FF, as UTF-8.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Bytes: marks, those of a-z, and what a word's marks may follow.
_MARK, _SMALL, _ENDS = (np.isin(np.arange(256), list(x)) for x in (MARKS, b"abcdefghijklmnopqrstuvwxyz", b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Words that go to the library in one text.
JOINED = 16384
#: The characters that byte-level models have for bytes: printable ones for themselves, the others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = dict(zip(sorted(set(range(256)) - set(_SHOWN)), range(0x100, 0x200)))
#: Ids below this are counted in a table, others are sorted.
TABLE = 1 << 22
_LOW, _HEAD, _POINT, _TAIL = np.uint64(1 << 31), struct.Struct("<8sQQII"), np.dtype([("place", "<u8"), ("first", "<u8"), ("n", "<u4"), ("crc", "<u4")]), struct.Struct("<QI8s")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive whole shares of 2**PRECISION."""
    total, size = 1 << PRECISION, int(counts.sum())
    f = np.maximum(1, counts * total // max(1, size)).astype(np.int64)
    over = int(f.sum()) - total
    for i in np.argsort(-f, kind="stable"):
        if not over:
            break
        step = max(over, -over if over < 0 else 0) if over < 0 else min(over, int(f[i]) - 1)
        f[i] -= over if over < 0 else step
        over = 0 if over < 0 else over - step
    return f.astype(np.uint64)


def encode_block(s: np.ndarray, f: np.ndarray, c: np.ndarray) -> bytes:
    lanes = min(LANES, len(s))
    x, words = np.full(lanes, _LOW), []
    for a in range((len(s) - 1) // lanes * lanes, -1, -lanes):
        part = s[a : a + lanes]
        y, g = x[: len(part)], f[part]
        full = y >= g << np.uint64(63 - PRECISION)
        words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // g
        x[: len(part)] = (q << np.uint64(PRECISION)) + (y - q * g) + c[part]
    return x.astype("<u8").tobytes() + np.concatenate(words[::-1]).tobytes()


def decode_block(raw: bytes, n: int, f: np.ndarray, c: np.ndarray, slots: np.ndarray) -> np.ndarray:
    lanes = min(LANES, n)
    x = np.frombuffer(raw, "<u8", lanes).copy()
    words, at = np.frombuffer(raw, "<u4", offset=8 * lanes).astype(np.uint64), 0
    out = np.empty(n, np.int64)
    mask = np.uint64((1 << PRECISION) - 1)
    for a in range(0, n, lanes):
        y = x[: min(lanes, n - a)]
        low = y & mask
        s = slots[low]
        y = f[s] * (y >> np.uint64(PRECISION)) + low - c[s]
        need = np.flatnonzero(y < _LOW)
        y[need] = y[need] << np.uint64(32) | words[at : at + len(need)]
        at += len(need)
        x[: len(y)] = y
        out[a : a + len(y)] = s
    return out


def pack(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of some documents' ids."""
    if len(ids) and int(ids.max()) < TABLE:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        s, counts = (np.cumsum(counts > 0) - 1)[ids], counts[symbols]
    else:
        symbols, s, counts = np.unique(ids, return_inverse=True, return_counts=True)
    f = frequencies(counts) if len(ids) else np.zeros(0, np.uint64)
    c = np.cumsum(f) - f
    tables = zlib.compress(symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + lengths.astype("<u8").tobytes())
    out = [_HEAD.pack(MAGIC, len(ids), len(docs), len(symbols), len(tables)), tables]
    place, points = sum(map(len, out)), []
    for a in range(0, len(ids), block):
        raw = encode_block(s[a : a + block], f, c)
        points.append((place, a, min(block, len(ids) - a), zlib.crc32(raw)))
        out.append(raw)
        place += len(raw)
    foot = np.array(points, _POINT).tobytes()
    return b"".join([*out, foot, _TAIL.pack(place, zlib.crc32(foot), MAGIC)])


class File:
    """A file's tables and checkpoints; blocks are read when they are asked for."""

    def __init__(self, data: bytes | None, uri: str = ""):
        self.data, self.uri = data, uri
        tail = get(uri, -_TAIL.size) if data is None else data[-_TAIL.size :]
        self.foot, crc, end = _TAIL.unpack(tail)
        magic, self.n, docs, symbols, size = _HEAD.unpack(self._read(0, _HEAD.size))
        foot = get(uri, self.foot)[: -_TAIL.size] if data is None else data[self.foot : -_TAIL.size]
        if magic != MAGIC or end != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError("not a whole token file")
        raw = zlib.decompress(self._read(_HEAD.size, size))
        self.points = np.frombuffer(foot, _POINT)
        self.symbols = np.frombuffer(raw, "<u4", symbols)
        self.f = np.frombuffer(raw, "<u4", symbols, 4 * symbols).astype(np.uint64)
        self.c = np.cumsum(self.f) - self.f
        self.slots = np.repeat(np.arange(symbols), self.f.astype(np.int64))
        ids, null = np.frombuffer(raw, "<i8", docs, 8 * symbols), np.frombuffer(raw, np.uint8, docs, 8 * symbols + 8 * docs)
        self.docs = [None if z else int(i) for i, z in zip(ids, null)]
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * symbols + 9 * docs).astype(np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths

    def _read(self, start: int, size: int) -> bytes:
        return get(self.uri, start, size) if self.data is None else self.data[start : start + size]

    def block(self, k: int) -> np.ndarray:
        """Ids of block k; a wrong checksum is an error."""
        p = self.points[k]
        end = int(self.points[k + 1]["place"]) if k + 1 < len(self.points) else self.foot
        raw = self._read(int(p["place"]), end - int(p["place"]))
        if zlib.crc32(raw) != p["crc"]:
            raise ValueError(f"block {k} is damaged")
        return self.symbols[decode_block(raw, int(p["n"]), self.f, self.c, self.slots)]

    def texts(self, first: int = 0, blocks: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of each document that begins in some blocks; the last may go on in later ones, which are decoded as well."""
        stop = len(self.points) if blocks is None else min(len(self.points), first + blocks)
        if first >= stop:
            return
        begin, end = int(self.points[first]["first"]), int(self.points[stop]["first"]) if stop < len(self.points) else self.n
        i, j = np.searchsorted(self.firsts, [begin, end])
        have, k = np.zeros(0, "<u4"), first
        skip = int(self.firsts[i]) - begin if i < j else 0
        for d in range(i, j):
            parts, size, n = [have], len(have), int(self.lengths[d])
            while size < skip + n:
                parts.append(self.block(k))
                size += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield d, have[skip : skip + n]
            have, skip = have[skip + n :], 0


class Encoder:
    """The tokenizers library over words that no token crosses; up to ``MEMO`` words met before are remembered.

    Words end at white space; marks at the end of a word after a-z or a digit are words of their own; ASCII capitals count
    as small. Each of this is tried on the tokenizer first: one that tells capitals or joins marks gets plain words, and one whose
    tokens cross white space gets whole texts. Texts that spell a special token keep their capitals, and words that do are not cut.
    Words of small Latin letters, which normalisers leave as they are, go to the library's byte-level model at once, many in one text
    whose words are told apart by the model's word ends, if tries show no difference.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.of = Tokenizer.from_file(path)
        self._forget()
        one = lambda t: self.of.encode(t, add_special_tokens=False).ids
        self.cuts = one("Ab, c\n\nd 1") == [*one("Ab,"), *one("c"), *one("d"), *one("1")]
        self.folds = one("THe QUICK") == one("the quick") and all(one(f"the {w}{m}") == [*one("the"), *one(w), *one(m)] for w in ("quick", "quick1", "caf\u00e9", "gro\u00df") for m in (MARKS.decode(), ".", "***"))
        self.special = [t.content.encode().lower() for t in self.of.get_added_tokens_decoder().values()]
        suffix = getattr(self.of.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.of.get_vocab_size(), bool)
        self.ends[[i for w, i in self.of.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self.direct = Tokenizer(self.of.model)
        self.direct.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        tries = [w.encode() for w in ("a", "quick", "\u00e9t\u00e9", "stra\u00dfe", "\u00e0\u00ed\u00f1", "xqzvjk")]
        self.plain = self.folds and self.joined(tries) == [np.array(one(w.decode()), "<u4").tobytes() for w in tries]

    def words(self, text: bytes) -> list[bytes]:
        if not self.cuts:
            return [text]
        if self.folds:
            low = text.lower()
            if not any(t in low for t in self.special):
                return low.split()
        return text.split()

    def joined(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of plain words; None if the model's ids don't tell the words apart."""
        text = b" ".join(words).decode("latin-1")
        for byte in (0x9F, 0xA0, 0xAD):  # those of plain words that byte-level models don't show as they are
            text = text.replace(chr(byte), chr(_BYTE_LEVEL[byte]))
        ids = np.array(self.direct.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *at], at)] if len(at) == len(words) else None

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _remember(self, hashes: np.ndarray, words: list[bytes], small: np.ndarray) -> None:
        """Stores the ids of new words by their hashes; ``small``: all letters are a-z."""
        ids = self.ids_of(words, small)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        new = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        known = np.concatenate([self.known, hashes])
        by = np.argsort(known, kind="stable")
        self.known = known[by]
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])[by]
        self.size = np.concatenate([self.size, size])[by]
        self.used += len(new)

    def ids_of(self, words: list[bytes], small: np.ndarray | None = None) -> list[bytes]:
        """Ids of some words as little-endian 32-bit integers."""
        out: list = [None] * len(words)
        simple, other = [], list(range(len(words)))
        if self.plain:
            fits = small.tolist() if small is not None else [False] * len(words)
            simple, other = [], []
            for i, w in enumerate(words):
                (simple if fits[i] or _PLAIN.fullmatch(w) else other).append(i)
            for a in range(0, len(simple), JOINED):
                part = simple[a : a + JOINED]
                if ids := self.joined([words[i] for i in part]):
                    for i, x in zip(part, ids):
                        out[i] = x
                else:
                    other += part
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            for i, e in zip(part, self.of.encode_batch_fast([words[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Words are told apart by 64-bit hashes."""
        low = b"\n".join(texts).lower() + b"\n"
        if not (self.cuts and self.folds) or any(t in low for t in self.special):
            words = [self.words(t) for t in texts]
            every = list(set().union(*words))
            ids = dict(zip(every, self.ids_of(every)))
            return [b"".join(map(ids.__getitem__, x)) for x in words]
        w = Words(texts, SPACE_WORDS)
        if not len(w.hash):
            return [b""] * len(texts)
        if len(self.known) > MEMO:
            self._forget()
        buf = np.frombuffer(low, np.uint8)
        body = np.maximum.accumulate(np.where(_MARK[buf], 0, np.arange(len(buf))))[w.end - 1]  # the last byte that is no mark
        split = np.flatnonzero((body >= w.start) & (body < w.end - 1) & _ENDS[buf[np.maximum(body, 0)]])
        start = np.insert(w.start, split + 1, body[split] + 1)
        end = np.insert(w.end, split, body[split] + 1)
        before = np.insert(np.ones(len(w.start), np.int64), split + 1, 0)  # a mark's run is no word more
        words, first, of = np.unique(w.hashes(start, end), return_index=True, return_inverse=True)
        find = lambda: np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        new = np.flatnonzero(self.known[find()] != words) if len(self.known) else np.arange(len(words))
        if len(new):
            a, b = start[first[new]], end[first[new]]
            odd = np.concatenate([[0], np.cumsum(~_SMALL[buf])])
            self._remember(words[new], [low[i:j] for i, j in zip(a.tolist(), b.tolist())], odd[a] == odd[b])
        slot = find()[of]
        size = self.size[slot]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[slot] - ends + size, size) + np.arange(ends[-1])].tobytes()
        place = np.append(np.flatnonzero(before), len(before))  # where words begin
        cuts = np.append(0, ends)[place[np.append(0, w.first + w.counts)]].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; its tasks share the words met."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, most: int = MAX_RANGES, block: int = BLOCK) -> DataFrame:
    """Writes files in ascending order of ids; a row a file: uri, its range k, ids of the range before it, ids and blocks."""
    known = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(most, -(-size // file_bytes)))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of, k = encoder(tokenizer), TaskContext.get().partitionId()
        ids, docs_, held, before, files = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            raw = np.frombuffer(b"".join(ids), "<u4")
            put(uri := f"{folder}/part-{k:06d}-{files:06d}.qrns", pack(raw, docs_, lengths, block))
            return pa.RecordBatch.from_arrays([pa.array([uri]), *(pa.array([x]) for x in (k, before, len(raw), -(-len(raw) // block)))], names=["uri", "k", "before", "n", "blocks"])

        for batch in batches:
            texts, own = text_bytes(batch.column(1)), batch.column(0).to_pylist()
            for a, b in chunked(texts, min(CHUNK_BYTES, file_bytes)):
                ids += [x + end for x in of.encode(texts[a:b])]
                docs_ += own[a:b]
                held += sum(map(len, texts[a:b]))
                if held >= file_bytes * 5 // 4:
                    yield flush()
                    before += sum(map(len, ids)) // 4
                    ids, docs_, held, files = [], [], 0, files + 1
        if docs_:
            yield flush()

    key = F.xxhash64("text")  # rows of one id and text are dealt by their places
    dealt = known.repartitionByRange(ranges, "doc_id", key, F.monotonically_increasing_id()).sortWithinPartitions("doc_id", key)
    return cut(dealt.mapInArrow(run, "uri string, k long, before long, n long, blocks long"))


def read(spark, files: DataFrame, blocks: int = RUN) -> DataFrame:
    """doc_id, start, n_tokens, ids (32-bit little-endian) of each document, from the files; several tasks a file."""
    base, todo = 0, []
    for r in files.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect():  # MAX_RANGES rows at most
        todo.append((r.k, base))
        base += r.n
    bases = spark.createDataFrame(todo, "k long, base long")
    runs = files.join(F.broadcast(bases), "k").select("uri", (F.col("base") + F.col("before")).alias("base"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(blocks))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, block in zip(*(c.to_pylist() for c in batch.columns)):
                file, out, size = File(None, uri), [], 0
                for d, ids in file.texts(block, blocks):
                    out.append((file.docs[d], at + int(file.firsts[d]), len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > BLOCK:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    some = max(1, min(MAX_RANGES, 3 * len(todo)))
    return runs.repartition(some, "uri", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    files = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "tokens"))
    return read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
