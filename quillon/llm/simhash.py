"""SimHash near-duplicates found through a sharded vantage-point tree.

A fingerprint's 64 bits are split into one block a tree level. A node of the tree has a vantage
fingerprint and a radius for its level's block: fingerprints within the radius go inside, the
others outside. Block distances add up to a lower bound of the Hamming distance, so a search with
radius r may cross a node's boundary only while the sum of the crossings' costs is at most r (the
triangle inequality over disjoint blocks). Every fingerprint has one home shard (leaf) and visits the
shards that its ball of radius r overlaps. A shard is large, so that few levels part the shards and visits stay few; it
builds a tree of its own over its members and compares them with its visitors exactly, leaf by leaf. Shards give links of a spanning forest of near
pairs, not all pairs, so that groups of copies stay linear.

``near_duplicates`` links fingerprints alone (three words, 3 bits). ``keep_one`` takes five words and a Jaccard similarity of 0.8 or more: it links by ``TABLES``
independent fingerprints of 48 bits within 3 bits each and verifies each link on the texts' shingle sets; of such texts two with the fewest shared shingles may stay apart in all tables. It finds near fingerprints by equal blocks:
first a spanning forest, whose links are verified, then all near pairs between the classes that these make, so that a text that fails against one of a group meets all others.

Nulls and empty texts have no words and fingerprint zero, and are linked like any other. Rows are
kept as they are: repeated rows are rows of one component, null ids have the component of their text. Columns of any other name are let be. A text is handled whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PASS_BYTES, SPACE_WORDS, Words, chunked, cut, free, give_back, lean, maybe_in, mix, rows, text_bytes
from .components import connected

#: Fingerprints that a shard should hold, that a task takes as its own at most, and that a leaf of its own tree should hold.
SHARD_ROWS, TASK_ROWS, LEAF_ROWS = 1 << 17, 1 << 19, 256
#: Fingerprints looked at for a leaf's radius; with MAX_LEVELS this bounds the sample on the driver (a million). Both set the cost, not the result.
SAMPLE_PER_SHARD, MAX_LEVELS = 32, 15
#: Fingerprints a text in ``keep_one``, words of a shingle and the least similarity there.
TABLES, SHINGLE, SIMILARITY = 32, 5, 0.8
#: Rounds of one pair a text before the others are looked at; this sets the cost, not the result. Each takes its own search of components.
ROUNDS = 1
#: Bits of each of these: fewer bits find more of the near pairs that a radius of 3 can, and 48 keep chance pairs rare up to 10**11 texts.
TABLE_BITS = 48
#: Rows that agree in a choice of blocks and are compared all with all.
CROWD = 512
#: A byte's bits as eight counters of a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits; each is 1 if set in over half of the hashes of the word shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    f = xxhash.xxh64_intdigest
    h = [f(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    n, total = len(h), np.zeros(64, np.int64)
    bits = np.array(h, dtype="<u8").view(np.uint8).reshape(n, 8)
    for a in range(0, n, 1 << 14):
        total += np.unpackbits(bits[a : a + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in text_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc", "fp"])

    ids = lean(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc long, fp long")


class Tree:
    """Vantage-point tree whose nodes split one block of bits each; leaves are shards."""

    def __init__(self, sample: np.ndarray, levels: int, bits: int = 64):
        cuts = [i * bits // levels for i in range(levels + 1)] if levels else [0]
        self.masks = [np.uint64(((1 << b) - (1 << a)) & (2**64 - 1)) for a, b in zip(cuts, cuts[1:])]
        self.leaves = 0
        self.root = self._grow(sample, 0)

    def _grow(self, x: np.ndarray, level: int):
        while level < len(self.masks) and len(x) > 1:
            vantage = x[len(x) // 2]
            d = np.bitwise_count((x ^ vantage) & self.masks[level])
            mu = int(np.median(d))
            mu -= mu == int(d.max())
            if mu >= int(d.min()):
                return level, vantage, mu, self._grow(x[d <= mu], level + 1), self._grow(x[d > mu], level + 1)
            level += 1
        self.leaves += 1
        return self.leaves - 1

    def visits(self, x: np.ndarray, radius: int, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indices, at home) of each shard with a visit, one after another, so that only the path to it is in memory. Of two shards that a pair spans, one sees it.

        A home row crosses only from inside to outside: its partner there need not come back. Rows that aren't at ``home`` here cross both ways.
        """
        own = np.ones(len(x), bool) if home is None else home
        todo = [(self.root, np.arange(len(x), dtype=np.int32), np.full(len(x), radius, np.int8), own)]
        while todo:
            node, i, left, own = todo.pop()
            if not len(i):
                continue
            if isinstance(node, int):
                yield node, i, own
                continue
            level, vantage, mu, near, far = node
            d = np.bitwise_count((x[i] ^ vantage) & self.masks[level]).astype(np.int8)
            inside = d <= mu
            cost = np.where(inside, mu + 1 - d, d - mu).astype(np.int8)
            cross = (cost <= left) & (inside | ~own)
            for child, here in ((near, inside), (far, ~inside)):
                go = here | cross
                todo.append((child, i[go], np.where(here, left, left - cost)[go], (own & here)[go]))

    def route(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, index, at home) for each visit."""
        found = list(self.visits(x, radius))
        leaf = [np.full(len(i), n, np.int64) for n, i, _ in found]
        return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((leaf, np.int64), ([i for _, i, _ in found], np.int64), ([h for _, _, h in found], bool)))


def _forest(own: np.ndarray, rest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs that connect what all near pairs connect: own with own, and own with rest."""
    x = np.concatenate([own, rest])
    label = np.arange(len(x))
    left, right = [], []
    for a in range(0, len(own), 64):
        near = np.bitwise_count(x[a : min(a + 64, len(own)), None] ^ x[None, :]) <= radius
        for r in np.flatnonzero(near.sum(axis=1) > 1):
            to = np.flatnonzero(near[r])
            found, one = np.unique(label[to], return_index=True)
            if len(found) > 1:
                one = one[found != label[a + r]]
                left.append(np.full(len(one), x[a + r]))
                right.append(x[to[one]])
                label[np.isin(label, found)] = found[0]
    return (np.concatenate(left), np.concatenate(right)) if left else (x[:0], x[:0])


def _near(own: np.ndarray, rest: np.ndarray, radius: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The same through a vantage-point tree over the own fingerprints."""
    if len(own) <= 2 * LEAF_ROWS:
        return _forest(own, rest, radius)
    tree = Tree(own, min(16, int(np.ceil(np.log2(len(own) / LEAF_ROWS)))), bits)
    x, out = np.concatenate([own, rest]), []
    for _, i, home in tree.visits(x, radius, np.arange(len(x)) < len(own)):
        if home.any():
            out.append(_forest(x[i[home]], x[i[~home]], radius))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (x[:0], x[:0])


def links(distinct: DataFrame, radius: int = 3, kind: str | None = None, bits: int = 64) -> DataFrame:
    """(kind, a, b): near pairs of distinct fingerprints fp that connect what all pairs within the radius connect; a tree for each ``kind`` (an int column), if there are several."""
    spark = distinct.sparkSession
    of = F.col(kind).cast("int") if kind else F.lit(0)
    distinct = distinct.select(of.alias("kind"), "fp")
    sizes = {r.kind: r["count"] for r in distinct.groupBy("kind").count().collect()}  # a row a table of fingerprints
    n = max(sizes.values(), default=0)
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS)))))
    rate = int(min(1.0, (SAMPLE_PER_SHARD << levels) / max(1, n)) * (1 << 30))
    few = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= rate).collect() if levels else []
    sample = {k: np.sort(np.array([r.fp for r in few if r.kind == k], np.int64).view(np.uint64)) for k in sizes}
    trees = {k: Tree(v[np.argsort(mix(v), kind="stable")], levels, bits) for k, v in sample.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, all_ = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(kinds).tolist():
                fp = all_[kinds == k]
                for a in range(0, len(fp), 2048):
                    part = fp[a : a + 2048]
                    leaf, index, home = trees[k].route(part.view(np.uint64), radius)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), k, np.int32)), pa.array(leaf), pa.array(part[index]), pa.array(home)], names=["kind", "shard", "fp", "home"])

    visits = distinct.mapInArrow(route, "kind int, shard long, fp long, home boolean")
    split = {}
    if n > TASK_ROWS:  # at most 2**MAX_LEVELS shards a kind
        homes = visits.where("home").groupBy("kind", "shard").count().where(F.col("count") > TASK_ROWS)
        split = {(r["kind"], r["shard"]): -(-r["count"] // TASK_ROWS) for r in homes.collect()}
    if split:  # an overfull shard is dealt to tasks that own a part each and see all of it
        parts = spark.createDataFrame([(*k, n) for k, n in split.items()], "kind int, shard long, parts int")
        visits = visits.join(F.broadcast(parts), ["kind", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part")))
    else:
        visits = visits.withColumn("part", F.lit(0))

    def pairs(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        a, b = _near(np.sort(fp[home]), np.sort(fp[~home]), radius, bits)  # the forest depends on the order, which a task run again may change
        give_back()
        return pa.table({"kind": pa.array(np.full(len(a), table.column("kind")[0].as_py(), np.int32)), "a": a.view(np.int64), "b": b.view(np.int64)})

    return visits.groupBy("kind", "shard", "part").applyInArrow(pairs, "kind int, a long, b long")


def candidates(x: np.ndarray, label: np.ndarray, radius: int, bits: int, at: np.ndarray | None = None, left: tuple[int, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows within the radius whose labels differ when they are looked at; a pair may come more than once.

    The bits are cut into radius + 2 or 3 blocks, of which two near rows agree in 2 or 3 at least: rows with equal values of these blocks are compared, for
    each choice of blocks. Rows of a choice that agree in many are cut by their other bits in the same way.
    """
    at = np.arange(len(x)) if at is None else at
    left = tuple(range(bits)) if left is None else left
    whole = 2 if len(at) < 1 << 17 else 3
    cuts = [i * len(left) // (radius + whole) for i in range(radius + whole + 1)]
    blocks = [sum(1 << b for b in left[a:b]) for a, b in zip(cuts, cuts[1:])]
    for chosen in combinations(range(radius + whole), whole):
        mask = sum(blocks[k] for k in chosen)
        key = x[at] & np.uint64(mask)
        by = np.argsort(key, kind="stable")
        key, row = key[by], at[by]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(key)))
        rest = tuple(b for b in left if not mask >> b & 1)
        crowd = size > (CROWD if len(rest) >= 2 * (radius + 2) else len(key))
        for h in np.flatnonzero(crowd).tolist():
            mine = row[head[h] : head[h] + size[h]]
            if (label[mine] != label[mine[0]]).any():
                yield from candidates(x, label, radius, bits, mine, rest)
        group = np.cumsum(new) - 1
        ahead = np.where(crowd[group], 0, (head + size)[group] - np.arange(len(key)) - 1)  # rows of its group after each
        i, k = np.flatnonzero(ahead > 0), 1
        while len(i):
            a, b = row[i], row[i + k]
            ok = label[a] != label[b]
            a, b = a[ok], b[ok]
            near = np.bitwise_count(x[a] ^ x[b]) <= radius
            if near.any():
                yield a[near], b[near]
            k += 1
            i = i[ahead[i] >= k]


def forest(x: np.ndarray, radius: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of distinct fingerprints that connect what all near pairs connect."""
    label, out = np.arange(len(x)), []
    for a, b in candidates(x, label, radius, bits):
        while len(a):
            la, lb = label[a], label[b]
            go = la != lb
            a, b, la, lb = a[go], b[go], la[go], lb[go]
            if not len(a):
                break
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((low, high))
            once = order[np.append(True, high[order][1:] != high[order][:-1])]  # one link down from each label
            out.append((x[a[once]], x[b[once]]))
            to = np.arange(len(x))
            to[high[once]] = low[once]
            while (to[to] != to).any():
                to = to[to]
            label[:] = to[label]
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (x[:0], x[:0])


def dealt(rows_: DataFrame, n: int, radius: int, bits: int) -> DataFrame:
    """Rows (kind, fp, ...) with their shard: one a kind, or for kinds of over ``TASK_ROWS`` rows one for each value of each of radius + 1 blocks, or several values of one, so that near rows share one."""
    if n <= TASK_ROWS:
        return rows_.withColumn("shard", F.lit(0).cast("long"))
    shards, cuts = -(-n // SHARD_ROWS), [i * bits // (radius + 1) for i in range(radius + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(b.schema.get_field_index("fp")).to_numpy().view(np.uint64)
            for j, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                value = fp >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((mix(value + np.uint64(1)) % np.uint64(shards)).astype(np.int64) + j * shards)], names=[*b.schema.names, "shard"])

    return rows_.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows_.schema) + ", shard long")


def block_links(distinct: DataFrame, radius: int, bits: int) -> DataFrame:
    """(kind, a, b): as ``links``, by equal blocks: what a fingerprint costs hardly grows with their number."""
    n = distinct.groupBy("kind").count().agg(F.max("count")).first()[0] or 0

    def pairs(table: pa.Table) -> pa.Table:
        a, b = forest(np.sort(table.column("fp").to_numpy().view(np.uint64)), radius, bits)
        give_back()
        return pa.table({"kind": pa.array(np.full(len(a), table.column("kind")[0].as_py(), np.int32)), "a": a.view(np.int64), "b": b.view(np.int64)})

    rows_ = distinct.select(F.col("kind").cast("int").alias("kind"), "fp")
    return dealt(rows_, n, radius, bits).groupBy("kind", "shard").applyInArrow(pairs, "kind int, a long, b long")


def apart(rows_: DataFrame, n: int, radius: int, bits: int) -> DataFrame:
    """(a, b): all pairs of texts t of different roots with fingerprints within the radius, of rows (kind, fp, t, root), n a kind at most."""

    def pairs(table: pa.Table) -> pa.Table:
        x, t = table.column("fp").to_numpy().view(np.uint64), table.column("t").to_numpy()
        label, found, size = np.unique(table.column("root").to_numpy(), return_inverse=True)[1], [np.zeros((0, 2), np.int64)], 0
        for i, j in candidates(x, label, radius, bits):
            found.append(np.stack([np.maximum(t[i], t[j]), np.minimum(t[i], t[j])], axis=1))
            size += len(i)
            if size > 1 << 21:
                found = [np.unique(np.concatenate(found), axis=0)]
                size = len(found[0]) >> 1
        out = np.unique(np.concatenate(found), axis=0)
        give_back()
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return dealt(rows_.select(F.col("kind").cast("int").alias("kind"), "fp", "t", "root"), n, radius, bits).groupBy("kind", "shard").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp, component): every row with the smallest id that its links reach, itself included."""
    each = cut(fingerprints(docs, words, seed, id_col, text_col))
    distinct = cut(each.groupBy("fp").agg(F.min("doc").alias("low")))
    roots = connected(links(distinct, radius).select("a", "b"), "a", "b").withColumnRenamed("node", "fp")
    nodes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component"))
    return each.join(nodes.select("fp", "root").join(lows, "root").select("fp", "component"), "fp").select("doc", "fp", "component")


def shingle_fingerprints(texts: list[bytes], words: int = SHINGLE, tables: int = TABLES) -> np.ndarray:
    """A row of independent fingerprints a text; texts of fewer words have one shingle, those of none zeros."""
    w = Words(texts, SPACE_WORDS)
    h, ok = w.shingles(words)
    h, of = h[ok], w.doc[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(short):
        total = np.array([int(mix(w.hash[a : a + n] + np.arange(1, n + 1, dtype=np.uint64)).sum()) for a, n in zip(w.first[short], w.counts[short])], np.uint64)
        h, of = np.concatenate([h, mix(total)]), np.concatenate([of, short])
        by = np.argsort(of, kind="stable")
        h, of = h[by], of[by]
    out = np.zeros((len(texts), tables), np.int64)
    if not len(h):
        return out
    n = np.bincount(of, minlength=len(texts))
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    size = np.diff(np.append(head, len(of)))
    runs = -(-size // 255)  # a counter holds 255
    first = np.cumsum(runs) - runs
    starts = np.repeat(head, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    mask = np.uint64((1 << TABLE_BITS) - 1)
    for k in range(tables):
        bits = mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        lanes = np.add.reduceat(_LANES[bits.view(np.uint8).reshape(-1, 8)], starts, axis=0)
        total = np.add.reduceat(lanes.view(np.uint8).reshape(len(starts), 64), first, axis=0, dtype=np.int64)
        full = np.packbits(2 * total > n[of[head], None], axis=1, bitorder="little").view("<u8")[:, 0]
        out[of[head], k] = (full & mask).view(np.int64)
    return out


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each text's shingle set, sorted; a text of fewer words, none included, has the one shingle of all its words."""
    w = Words(texts, SPACE_WORDS)
    h, ok = w.shingles(words)
    h, of = h[ok], w.doc[ok]
    short = np.flatnonzero(w.counts < words)
    whole = [int(mix(w.hash[a : a + n] + np.arange(1, n + 1, dtype=np.uint64)).sum()) & (2**64 - 1) for a, n in zip(w.first[short], w.counts[short])]
    h, of = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([of, short])
    by = np.lexsort((h, of))
    h, of = h[by], of[by]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
    return of[new], h[new]


def similarities(xs: list[bytes], ys: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each two texts; texts without words are equal to one another."""
    (i, g), (j, h) = _sets(xs, words), _sets(ys, words)
    of, every = np.concatenate([i, j]), np.concatenate([g, h])
    by = np.lexsort((every, of))
    of, every = of[by], every[by]
    both = np.bincount(of[1:][(of[1:] == of[:-1]) & (every[1:] == every[:-1])], minlength=len(xs))
    return both / (np.bincount(of, minlength=len(xs)) - both)


def verified(texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of keys t whose texts are similar."""
    both = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("t").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, y in rows(batches, "y"):
            x = text_bytes(batch.column(2))
            for p, q in chunked(x, PASS_BYTES):
                ok = np.flatnonzero(similarities(x[p:q], y[p:q], words) >= least) + p
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each text of the pairs (a, b) once."""
    ends = pairs.select(F.col("a").alias("t")).distinct().unionByName(pairs.select(F.col("b").alias("t")).distinct())
    return cut(maybe_in(texts, "t", ends, "t", "some").where("some").groupBy("t").agg(F.any_value("text").alias("text")))


def _joined(texts: DataFrame, pairs: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(t, root) of the classes that similar pairs (a, b, n) connect, and the similar pairs.

    Each text's pair of the most tables is looked at, then, ``ROUNDS`` times in all, its next one that is still between classes, then all others between classes.
    """
    texts = _texts(texts, pairs)
    left, good = pairs, None
    for _ in range(ROUNDS):
        first = cut(left.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
        found = verified(texts, first, words, least)
        good = cut(found if good is None else good.unionByName(found))
        roots = connected(good, "a", "b")
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        left = left.join(first.withColumnRenamed("b", "f"), "a").where("b <> f").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = cut(left.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "n"))
        if left.isEmpty():
            return roots, good
    good = cut(good.unionByName(verified(texts, left.select("a", "b"), words, least)))
    return connected(good, "a", "b"), good


def classes(docs: DataFrame, words: int = SHINGLE, least: float = SIMILARITY, tables: int = TABLES, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, t, root) of every row with an id: t is the 64-bit hash of its text, root that of one text a class. Texts of a class are linked by verified near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches, limit=PASS_BYTES):
            fps = shingle_fingerprints(texts, words, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, tables, dtype=np.int32)), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc", "t", "fps"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = lean(docs).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("t"), text.alias("text")).where("doc is not null")
    each = cut(known.mapInArrow(run, "doc long, t long, fps array<long>"))
    fps = each.groupBy("t").agg(F.any_value("fps").alias("fps")).select("t", F.posexplode("fps").alias("kind", "fp"))
    first = cut(fps.groupBy("kind", "fp").agg(F.min("t").alias("low"), F.max("t").alias("most")))
    equal = fps.join(first.where("low < most"), ["kind", "fp"]).where("t <> low").select(F.col("t").alias("a"), F.col("low").alias("b"))
    low = lambda c: first.select("kind", F.col("fp").alias(c), F.col("low").alias(f"t{c}"))
    near = block_links(first, radius, TABLE_BITS).join(low("a"), ["kind", "a"]).join(low("b"), ["kind", "b"]).select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    pairs = cut(equal.unionByName(near).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")))
    roots, good = _joined(known.select("t", "text"), pairs, words, least)
    rooted = fps.join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    n = each.select("t").distinct().count()
    more = cut(apart(rooted, n, radius, TABLE_BITS).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))  # pairs that a forest leaves out, between classes
    if not more.isEmpty():
        roots = connected(good.unionByName(verified(_texts(known.select("t", "text"), more), more, words, least)), "a", "b")
    return each.select("doc", "t").join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """Of each class of near-duplicates, the row with the smallest id, of equal ids that with the least hash of its text; all columns.

    Rows without an id stay. Of rows that agree in id and text one stays.
    """
    found = cut(classes(docs, **kw))
    best = found.groupBy("root").agg(F.min(F.struct("doc", "t")).alias("w"))
    doc, t, some, extra = free(docs, "__doc", "__t", "__some", "__extra")
    each = found.groupBy("doc", "t", "root").agg(F.count("*").alias("n"))
    lost = each.join(best, "root").select(F.col("doc").alias(doc), F.col("t").alias(t), (F.struct("doc", "t") != F.col("w")).alias("lost"), "n")
    lost = cut(lost.where("lost or n > 1").select(doc, t, F.col("lost").alias(extra)))
    ours = maybe_in(docs, "doc_id", lost, doc, some)
    ours = ours.withColumn(some, F.col(some) & F.col("doc_id").isNotNull())
    held = ours.where(F.col(some)).withColumns({doc: F.col("doc_id").cast("long"), t: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}).join(lost, [doc, t], "left")
    once = held.where(~F.col(extra)).dropDuplicates([doc, t])
    return ours.where(~F.col(some)).select(*docs.columns).unionByName(held.where(F.col(extra).isNull()).select(*docs.columns)).unionByName(once.select(*docs.columns))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    d = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
