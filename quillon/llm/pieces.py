"""SentencePiece encoding and decoding through suffix arrays.

The texts of a batch are cut where no piece can cross (before a run of word marks), and the distinct
cuts that the worker has not met are concatenated. A suffix array over them is searched for every
piece of the vocabulary; the ranges found give edges (start, length, piece), which are sorted by
position. Cuts are parted once more where no edge crosses. Relaxation then joins symbols along edges, in every part the edge of the best score first
and the leftmost among equals, until no edge joins two neighbours: for all short parts at once, for parts of over ``LONG`` characters with a heap each, in
n log n steps. This is the merge order
that a BPE model defines, so ids equal those of the sentencepiece library. Characters without a piece become byte pieces.

Null texts are empty; empty texts have no ids. Repeated rows give a row each, an empty table none. A text is handled whole by one task, which takes some
200 bytes a byte of a text of over a mebibyte. Decoding gives the text back, but for the word mark U+2581, which decodes to a space.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, lean, rows, text_bytes
from .decontaminate import _bound, _spread, stable_order, suffix_array

MARK = "▁"
#: Distinct cuts that a worker remembers; bytes of text in a batch; and characters of cuts that are encoded at a time.
MEMO, BATCH_BYTES, CUT_CHARS = 150_000, 1 << 20, 1 << 18
#: Characters of a part that has a heap of its own.
LONG = 256


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.pieces = [sp.id_to_piece(i) for i in plain]
        self.ids = np.array(plain, np.int32)
        score = np.array([sp.get_score(i) for i in plain])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("pieces cross words")
        chars = sorted({c for p in self.pieces for c in p})
        #: 0 parts cuts, 1 is a character of no piece.
        code = {c: i + 2 for i, c in enumerate(chars)}
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.length = np.array([len(p) for p in self.pieces])
        self.depth = int(self.length.max())
        self.grid = np.zeros((len(self.pieces), self.depth), np.uint64)
        for i, p in enumerate(self.pieces):
            self.grid[i, : len(p)] = [code[c] for c in p]
        self.text = {int(i): p.replace(MARK, " ").encode() for i, p in zip(plain, self.pieces)} | {int(i): bytes([b]) for b, i in enumerate(self.byte)}
        #: Ids of the cuts met last, and of those met before them.
        self.memo: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}

    def edges(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (start * (depth + 1) + length), and which piece, of every occurrence of every piece."""
        order = suffix_array(seq, self.depth)
        live = np.arange(len(self.pieces))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(seq))
        starts, which = [], []
        for j in range(self.depth):
            word = self.grid[live, j]
            lo, hi = _bound(seq, order, lo, hi, j, word, False), _bound(seq, order, lo, hi, j, word, True)
            done = (self.length[live] == j + 1) & (lo < hi)
            k, slot = _spread(lo[done], hi[done])
            starts.append(order[slot])
            which.append(live[done][k].astype(np.int32))
            more = (self.length[live] > j + 1) & (lo < hi)
            live, lo, hi = live[more], lo[more], hi[more]
        bits, step = len(self.pieces).bit_length(), self.depth + 1
        both = np.concatenate([(s * step + self.length[p]) << bits | p for s, p in zip(starts, which)])
        starts.clear()
        which.clear()
        both.sort()
        return both >> bits, (both & ((1 << bits) - 1)).astype(np.int32)

    def _cuts(self, cuts: list[str]) -> None:
        """Encodes cuts and remembers them."""
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)
        of = np.repeat(np.arange(len(cuts)), size)
        at = np.arange(len(points)) + of
        seq = np.zeros(len(points) + len(cuts), np.uint64)
        seq[at] = self.code[points]
        key, piece = self.edges(seq)
        step = self.depth + 1

        def find(start, end):
            want = start * step + (end - start)
            got = np.minimum(np.searchsorted(key, want), len(key) - 1)
            return np.where((end - start < step) & (key[got] == want), piece[got], -1) if len(key) else np.full(len(want), -1)

        ends = np.cumsum(size + 1) - 1  # the end of each cut in seq
        far = np.int64(1) << 60
        edge, long = np.divmod(key, step)
        wide = long > 1
        cover = np.cumsum(np.bincount(edge[wide] + 1, minlength=len(seq) + 1)[: len(seq) + 1] - np.bincount(edge[wide] + long[wide], minlength=len(seq) + 1)[: len(seq) + 1])
        lead = np.append(True, of[1:] != of[:-1]) | (cover[at] == 0) if len(at) else np.zeros(0, bool)
        part = np.cumsum(lead) - 1
        begin = at[lead]
        last = np.minimum(np.append(begin[1:], len(seq)), ends[of[lead]])  # the end of each part
        start, own, out_s, out_o = at, part, [], []
        big = np.flatnonzero(last - begin > LONG)
        if len(big):
            for b in big.tolist():
                s = self._heap(int(begin[b]), int(last[b]), edge, long, piece)
                out_s.append(s)
                out_o.append(np.full(len(s), b))
            few = ~np.isin(own, big)
            start, own = start[few], own[few]

        def pairs(s, o, i):
            """Priority of joining symbol i and the next: the piece's rank, then the place."""
            n, value = len(s), np.full(len(i), far)
            ok = (i + 1 < n) & (o[np.minimum(i + 1, n - 1)] == o[i]) if n else np.zeros(0, bool)
            i = i[ok]
            after = np.where((i + 2 < n) & (o[np.minimum(i + 2, n - 1)] == o[i]), s[np.minimum(i + 2, n - 1)], last[o[i]])
            p = find(s[i], after)
            value[ok] = np.where(p >= 0, (self.rank[p] << 32) + s[i], far)
            return value

        best = pairs(start, own, np.arange(len(start)))
        while len(start):
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.minimum.reduceat(best, head)
            group = np.cumsum(np.append(0, own[1:] != own[:-1]))
            stay = (low < far)[group]
            out_s.append(start[~stay])
            out_o.append(own[~stay])
            start, own, best, low = start[stay], own[stay], best[stay], low[group[stay]]
            if not len(start):
                break
            join = np.flatnonzero(best == low)  # one in each cut, as the place is in the priority
            keep = np.ones(len(start), bool)
            keep[join + 1] = False
            new = np.cumsum(keep) - 1
            start, own, best = start[keep], own[keep], best[keep]
            again = np.zeros(len(start), bool)
            again[new[join]] = again[np.maximum(new[join] - 1, 0)] = True
            redo = np.flatnonzero(again)
            best[redo] = pairs(start, own, redo)
        s, o = np.concatenate(out_s), np.concatenate(out_o)
        by = stable_order(s)
        s, o = s[by], o[by]
        end = np.append(s[1:], 0)
        tail = np.append(o[1:] != o[:-1], True) if len(o) else np.zeros(0, bool)
        end[tail] = last[o[tail]]
        o = of[lead][o] if len(o) else o
        p = find(s, end)
        ids = np.where(p >= 0, self.ids[p], -1)
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            spell = [self.byte[list(chr(points[x - y]).encode("utf-8", "replace"))] for x, y in zip(s[lone].tolist(), o[lone].tolist())]
            n = np.ones(len(ids), np.int64)
            n[lone] = [len(x) for x in spell]
            ids, o = np.repeat(ids, n), np.repeat(o, n)
            ids[ids < 0] = np.concatenate(spell)
        ids = ids.astype("<i4")
        ends = np.searchsorted(o, np.arange(len(cuts) + 1)).tolist()
        raw = ids.tobytes()
        for c, a, b in zip(cuts, ends, ends[1:]):
            self.memo[c] = raw[4 * a : 4 * b]

    def _heap(self, begin: int, end: int, edge: np.ndarray, long: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Starts of the symbols that relaxation leaves of [begin, end); edges are sorted by start."""
        i, j = np.searchsorted(edge, [begin, end])
        n = end - begin
        first = array("q", np.searchsorted(edge[i:j], np.arange(begin, end + 1)).astype(np.int64).tobytes())
        size, rank = long[i:j].astype(np.uint8).tobytes(), array("q", self.rank[piece[i:j]].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # neighbours; n ends
        bits = n.bit_length()
        step = self.depth + 1

        def offer(s: int) -> int:
            """Rank, place and length of joining the symbol at s and the next; -1: no edge."""
            m = after[s]
            if m >= n:
                return -1
            wide = after[m] - s
            k = size.find(wide, first[s], first[s + 1]) if wide < step else -1
            return (rank[k] << bits | s) * step + wide if k >= 0 else -1

        heap = [x for x in map(offer, range(n)) if x >= 0]
        heapq.heapify(heap)
        while heap:
            x, wide = divmod(heapq.heappop(heap), step)
            s = x & ((1 << bits) - 1)
            m = after[s]
            if m < 0 or m >= n or after[m] - s != wide:  # joined meanwhile
                continue
            e = after[m]
            after[s], after[m] = e, -1
            if e < n:
                before[e] = s
            if (y := offer(s)) >= 0:
                heapq.heappush(heap, y)
            if before[s] >= 0 and (y := offer(before[s])) >= 0:
                heapq.heappush(heap, y)
        left = np.frombuffer(after, np.int64)
        return begin + np.flatnonzero(left >= 0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [re.findall(f"{MARK}+[^{MARK}]*", MARK + t.decode("utf-8", "replace").replace(" ", MARK)) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.past, self.memo = self.memo, {}
        fresh = set().union(*cut) - self.memo.keys()
        again = fresh & self.past.keys()
        self.memo |= {c: self.past[c] for c in again}
        fresh = list(fresh - again)
        ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
        for part in np.split(np.array(fresh, object), np.searchsorted(ends, np.arange(CUT_CHARS, int(ends[-1]) if fresh else 0, CUT_CHARS))):
            if len(part):
                self._cuts(part.tolist())
        return [b"".join(map(self.memo.__getitem__, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The model at the path, with what this worker has encoded by it in earlier tasks."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All rows and columns, with ``__ids`` (32-bit little-endian ids) and, if asked for, ``__decoded`` (their text); these replace the table's own."""
    (text,) = free(docs, "__text")
    out = lean(docs).withColumns({text: F.col(text_col).cast("string"), "__ids": F.lit(b"").cast("binary")} | ({"__decoded": F.lit("").cast("string")} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch, texts in rows(batches, text, BATCH_BYTES):
            ids = v.encode(texts)
            new = {"__ids": pa.array(ids, pa.binary())}
            if decoded:
                new["__decoded"] = pa.array([v.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([new.get(f, batch.column(i)) for i, f in enumerate(batch.schema.names)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema).drop(text)


def decode(encoded: DataFrame, path: str, ids_col: str = "__ids") -> DataFrame:
    """All rows and columns, with ``__decoded``."""
    out = encoded.withColumn("__decoded", F.lit("").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            text = [v.decode(x) for x in text_bytes(batch.column(batch.schema.get_field_index(ids_col)))]
            yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in text], pa.string()) if f == "__decoded" else batch.column(i) for i, f in enumerate(batch.schema.names)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, exact (the ids decode to the text)."""
    e = encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), path, decoded=True)
    return e.select("doc_id", F.expr("octet_length(__ids) div 4").alias("n_tokens"), F.crc32("__ids").alias("ids_crc32"), F.sha2("__decoded", 256).alias("decoded_sha256"), (F.col("__decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("exact"))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, exact of every whole text."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())


def crc(ids: list[int]) -> int:
    """The checksum of a list of ids, for tests."""
    return zlib.crc32(np.array(ids, "<i4").tobytes())
