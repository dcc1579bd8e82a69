"""Readers, artefacts and evaluation operators against brute force and round trips."""

import heapq
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.operators import evaluation, quantize, sequence_lm
from quillon.sources import artefacts, loose, readers


def test_readers(spark, tmp_path):
    (tmp_path / "items.csv").write_text('item_idx,description\n1,"a ""b"", c"\n0,x\n')
    assert sorted(tuple(r) for r in readers.item_text(spark, str(tmp_path / "items.csv")).collect()) == [(0, "x"), (1, 'a "b", c')]
    (tmp_path / "gap.csv").write_text("item_idx,description\n0,x\n2,y\n")
    with pytest.raises(ValueError):
        readers.item_text(spark, str(tmp_path / "gap.csv"))
    (tmp_path / "seq.jsonl").write_text('{"user_idx": 1, "items": [1, 2, 3]}\n{"user_idx": 2, "items": [1]}\n')
    assert [r.user_idx for r in readers.sequences(spark, str(tmp_path / "seq.jsonl")).collect()] == [1]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"history": [i], "target": i}) + "\n" for i in range(9)))
    assert [r.target for r in readers.samples(spark, str(tmp_path / "s.jsonl"), 4).collect()] == [0, 1, 2, 3] and readers.samples(spark, str(tmp_path / "s.jsonl")).count() == 9
    assert readers.config(str(tmp_path / "none.json")) == {}
    (tmp_path / "c.json").write_text('{"sizes": [4, 5]}')
    codes = spark.createDataFrame([(0, [1, 4]), (1, [3, 0])], "item int, codes array<int>")
    assert readers.layout(codes, readers.config(str(tmp_path / "c.json"))) == [(0, "code_0", 4), (1, "code_1", 5)] == readers.layout(codes)
    with pytest.raises(ValueError):
        readers.layout(codes, {"sizes": [4]})
    tokens, part, begin, vocabulary = readers.tokens(codes, "item", 2)
    assert (part, begin, vocabulary) == (5, 6, 7) and {tuple(r.tokens) for r in tokens.collect()} == {(1, 4), (3, 0)}
    with pytest.raises(ValueError):
        readers.tokens(codes, "item", 3)


def test_loose_gzip_and_literals(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("{\"a\": 1}\n\n{'a': 2}\nnonsense\n")
    got = loose.read_loose(spark, str(tmp_path / "x.json.gz"), "a int", 3).orderBy("row_ord").collect()
    assert [r.a for r in got] == [1, 2, None]


def test_catalogue(tmp_path):
    np.savez_compressed(tmp_path / "a.npz", x=np.zeros((3, 4), np.float32), y=np.asfortranarray(np.ones((2, 5))))
    got = {r["name"]: (r["shape"], r["dtype"], r["order"], r["compressed"]) for r in readers.catalogue(str(tmp_path / "a.npz"))}
    assert got == {"x": ([3, 4], "<f4", "C", True), "y": ([2, 5], "<f8", "F", True)}


def test_artefacts(spark, tmp_path):
    m = {"book": np.arange(6.0).reshape(2, 3), "rotation": np.eye(3)}
    artefacts.write_matrices(spark, m, str(tmp_path / "m"))
    back = artefacts.read_matrices(spark, str(tmp_path / "m"))
    assert back.keys() == m.keys() and all(np.array_equal(back[k], m[k]) for k in m)
    artefacts.write_rows(spark, [{"a": 1, "b": "x"}], str(tmp_path / "r"))
    artefacts.write_rows(spark, [], str(tmp_path / "e"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("1", "x")] and spark.read.text(str(tmp_path / "e")).count() == 0
    artefacts.write_codes(spark.range(3), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    assert artefacts.human_bytes(1536) == "1.50 KiB" and artefacts.human_bytes(3) == "3 B" and artefacts.axis([float("nan")]) == (-0.05, 1.05)
    svg = artefacts.chart(spark.createDataFrame([("a<b", 2.0), ("c", float("inf"))], "k string, v double"), "x & y", "k", "v")
    assert "x &amp; y" in svg and svg.count("<rect") == 1


def test_text_of_maps(spark):
    df = spark.createDataFrame([({"b": 2, 'a"': 1}, [["x\n", None], []])], "m map<string,long>, l array<array<string>>")
    r = df.select(text.rank_json(F.col("m")).alias("j"), text.tidy_lists(F.col("l")).alias("l"), text.rank_json(F.lit(None).cast("map<string,long>")).alias("n")).first()
    assert json.loads(r.j) == {'a"': 1, "b": 2} and r.j == json.dumps({'a"': 1, "b": 2}, sort_keys=True) and r.n == "" and r.l.split() == ["x"]


def test_zipped(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, l string"), spark.createDataFrame([(2, 5), (1, 6)], "id int, r int")
    assert {tuple(r) for r in evaluation.zipped(a, b, "id").collect()} == {(1, "x", 6), (2, "y", 5)}
    with pytest.raises(ValueError):
        evaluation.zipped(a, b.limit(1), "id")


def test_sequences_and_vectors(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>")
    got = [tuple(map(tuple, r)) for r in df.select(vectors.tail(F.col("x"), 2), vectors.tail(F.col("x"), 0), vectors.padded(F.col("x"), 4, 9)).collect()]
    assert got == [((2, 3), (1, 2, 3), (9, 1, 2, 3)), ((), (), (9, 9, 9, 9))]
    with pytest.raises(Exception, match="positions"):
        df.select(vectors.offset_codes(F.col("x"), [4, 4])).collect()
    n = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in n.select(evaluation.finite(F.col("v"))).collect()] == [True, False, False, False]
    assert evaluation.weighted_mean(n.limit(0), F.col("v"), F.col("v")).first()[0] is None
    t = evaluation.random_table(5, 16, 3)
    assert t.shape == (5, 16) and np.array_equal(t, evaluation.random_table(5, 16, 3)) and abs(t[1:].std() - 0.25) < 0.1


def test_nearest_and_reconstruction(spark):
    rng = np.random.default_rng(4)
    x, books = rng.normal(size=(300, 6)), [rng.normal(size=(9, 6)), rng.normal(size=(5, 6))]
    x[:5] = books[0][:5]
    books[0][7] = books[0][2]  # equal centres: the lower one
    k, d = quantize.nearest(x, books[0])
    every = ((x[:, None] - books[0][None]) ** 2).sum(axis=2)
    assert np.array_equal(k, every.argmin(axis=1)) and np.allclose(d, every.min(axis=1))
    rotation, products = np.linalg.qr(rng.normal(size=(6, 6)))[0], [rng.normal(size=(4, 3)), rng.normal(size=(4, 3))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    codes = quantize.residual_codes(df, "id", "x", books, rotation, products)
    y = {r.key: np.array(r.vector) for r in quantize.reconstructed(codes, "key", books, rotation, products).collect()}
    for r in codes.collect():
        assert abs(((x[r.key] - y[r.key]) ** 2).sum() - r.error) < 1e-9
    z = {r.key: r.vector for r in evaluation.project(df, "id", "x", x.mean(axis=0), books[1]).collect()}
    assert np.allclose([z[i] for i in range(300)], (x - x.mean(axis=0)) @ books[1].T)


def test_residual_training_equals_lloyd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    rest, books = x, quantize.train_residual(df, "id", "x", 2, 6, 3)
    for level in range(2):
        centers = quantize._rest(quantize._seeds(df, "id", "x", 6, level), books[:level])
        for _ in range(3):
            near = ((rest[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            centers = np.array([rest[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(6)])
        assert np.allclose(books[level], centers, atol=1e-6)
        rest = rest - books[level][((rest[:, None] - books[level][None]) ** 2).sum(axis=2).argmin(axis=1)]


@pytest.mark.parametrize("beam,recent,seen", [(100, 0, True), (3, 2, True), (2, 0, False)])
def test_decoding_of_code_paths(spark, beam, recent, seen):
    """Beam search against every path scored in full; with a beam of all paths these are the best items."""
    rng = random.Random(beam)
    paths = {i: (rng.randrange(4), 4 + rng.randrange(3)) for i in range(20)}
    users = [[rng.randrange(20) for _ in range(rng.randrange(3, 8))] for _ in range(12)]
    part, begin, vocabulary, order, alpha = 7, 8, 9, 3, 0.01
    streams = [[begin, *(t for i in u for t in (*paths[i], part))] for u in users]
    table: dict = {}
    for s in streams:
        for p in range(1, len(s)):
            for n in range(min(order, p + 1)):
                key = (tuple(s[p - n : p]), s[p])
                table[key] = table.get(key, 0) + 1
    totals: dict = {}
    for (c, _), n in table.items():
        totals[c] = totals.get(c, 0) + n
    popular = sorted(range(20), key=lambda i: (-sum(u.count(i) for u in users), i))
    df = spark.createDataFrame(list(enumerate(users)), "u long, history array<int>")
    got = {r.u: r.preds for r in sequence_lm.beam_decode(df, "u", table, totals, paths, popular, order, alpha, vocabulary, begin, part, beam, 6, seen, recent).collect()}

    def logp(context, token):
        for n in range(order - 1, -1, -1):
            c = tuple(context[len(context) - n :]) if n else ()
            if len(c) == n and table.get((c, token)):
                return math.log((table[c, token] + alpha) / (totals[c] + alpha * vocabulary))
        return math.log(alpha / (totals.get((), 0) + alpha * vocabulary))

    children = {(): list(dict.fromkeys(paths[i][0] for i in range(20)))} | {(t,): list(dict.fromkeys(paths[i][1] for i in range(20) if paths[i][0] == t)) for t in range(4)}
    for u, history in enumerate(users):
        context = [begin, *(t for i in (history[-recent:] if recent else history) for t in (*paths[i], part))]
        live = [(0.0, ())]
        for _ in range(2):
            live = heapq.nlargest(beam, [(s + logp([*context, *p], t), (*p, t)) for s, p in live for t in children[p]], key=lambda x: x[0])
        ends = sorted(((s + logp([*context, *p], part), p) for s, p in live), key=lambda x: -x[0])
        out: list[int] = []
        for _, p in ends:
            out += [i for i in popular if paths[i] == p and not (seen and i in history)]
        out += [i for i in popular if i not in out and not (seen and i in history)]
        assert got[u] == out[:6]


def test_stream_of_codes(spark, tmp_path):
    from quillon.streaming import assign

    rng = np.random.default_rng(1)
    books = [rng.normal(size=(4, 3))]
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(20)], "id long, x array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = assign.assign_stream(stream, "id", "x", books, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    want = {r.key: r.codes for r in quantize.residual_codes(rows, "id", "x", books).collect()}
    assert {r.key: r.codes for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_decoding_looks_at_few_of_many_items(spark):
    """30,000 items of one token each: a user's search doesn't go through all of them, and finds what scoring all of them does."""
    n, users, part, begin, vocabulary, alpha = 30_000, 4_000, 30_000, 30_001, 30_002, 0.01
    rng = random.Random(5)
    skewed = lambda: min(n - 1, int(rng.paretovariate(0.5)) - 1)
    lists = [[skewed() for _ in range(4)] for _ in range(users)]
    table: dict = {}
    for s in ([begin, *(t for i in u for t in (i, part))] for u in lists):
        for p in range(1, len(s)):
            for size in range(min(3, p + 1)):
                key = (tuple(s[p - size : p]), s[p])
                table[key] = table.get(key, 0) + 1
    totals: dict = {}
    for (c, _), k in table.items():
        totals[c] = totals.get(c, 0) + k
    popular, df = list(range(n)), spark.createDataFrame(list(enumerate(lists)), "u long, history array<int>")
    began = time.time()
    got = {r.u: r.preds for r in sequence_lm.beam_decode(df, "u", table, totals, {i: (i,) for i in popular}, popular, 3, alpha, vocabulary, begin, part, 64, 10).collect()}
    assert time.time() - began < 60

    def logp(context, token):
        for c in (context, context[1:], ()):
            if table.get((c, token)):
                return math.log((table[c, token] + alpha) / (totals[c] + alpha * vocabulary))
        return math.log(alpha / (totals[()] + alpha * vocabulary))

    for u in range(0, users, 800):
        live = sorted(((logp((lists[u][-1], part), i), i) for i in range(n)), key=lambda x: -x[0])[:64]
        best = [i for _, i in sorted(((s + logp((part, i), part), i) for s, i in live), key=lambda x: -x[0])]
        assert got[u] == ([i for i in best if i not in lists[u]] + [i for i in popular if i not in lists[u] and i not in best])[:10]


def test_beam_decode_uses_the_history(spark):
    """The query's predictions are the best of all items after a user's last item, which the search depends on."""
    from quillon.plans import registry

    sf = "/root/testdata/sf0.001"
    got = {r.user_idx: r.preds for r in registry.QUERIES["beam_decode"](spark, sf).collect()}
    seqs = {r.user_idx: list(r["items"]) for r in registry._seq(spark, sf).collect()}
    part = max(max(s) for s in seqs.values()) + 1
    table, totals = {}, {}
    for s in seqs.values():
        tokens = [part + 1, *(t for i in s[:-2] for t in (i, part))]
        for p in range(1, len(tokens) if len(s) >= 3 else 0):
            for n in range(min(3, p + 1)):
                c = tuple(tokens[p - n : p])
                table[c, tokens[p]] = table.get((c, tokens[p]), 0) + 1
                totals[c] = totals.get(c, 0) + 1

    def logp(context, token):
        for c in (context, context[1:], ()):
            if table.get((c, token)):
                return math.log((table[c, token] + 0.001) / (totals[c] + 0.001 * (part + 2)))
        return math.log(0.001 / (totals[()] + 0.001 * (part + 2)))

    popular = sorted(range(part), key=lambda i: (-sum(i in s[:-2] for s in seqs.values() if len(s) >= 3), i))
    for u, text in got.items():
        history = seqs[u][:-1]
        score = {i: logp((history[-1], part), i) + logp((part, i), part) for i in range(part) if i not in history}
        best = sorted(score.values(), reverse=True)[:10]
        assert np.allclose([score[int(i)] for i in text.split()], best) and len(set(text.split())) == len(best)


@pytest.mark.parametrize("depth", [1, 2])
def test_decoding_of_all_paths(spark, depth):
    """Without a beam (0) the items are the best of all paths, also where the first paths of a search end badly or have been seen."""
    rng = random.Random(depth)
    n, part, begin, vocabulary, alpha = 600, 700, 701, 702, 0.01
    paths = {i: (i,) if depth == 1 else (i // 25, 30 + i % 25) for i in range(n)}
    users = [[rng.randrange(n) if rng.random() < 0.7 else rng.randrange(9) for _ in range(rng.choice([3, 5, 150]))] for _ in range(30)]
    table: dict = {}
    for u in users:
        s = [begin, *(t for i in u for t in (*paths[i], *([part] * (i % 7 > 2))))]  # many have no parting token
        for p in range(1, len(s)):
            for k in range(min(3, p + 1)):
                table[tuple(s[p - k : p]), s[p]] = table.get((tuple(s[p - k : p]), s[p]), 0) + 1
    totals: dict = {}
    for (c, _), k in table.items():
        totals[c] = totals.get(c, 0) + k

    def logp(context, token):
        for c in (context[-2:], context[-1:], ()):
            if table.get((c, token)):
                return math.log((table[c, token] + alpha) / (totals[c] + alpha * vocabulary))
        return math.log(alpha / (totals[()] + alpha * vocabulary))

    df = spark.createDataFrame(list(enumerate(users)), "u long, history array<int>")
    got = {r.u: r.preds for r in sequence_lm.beam_decode(df, "u", table, totals, paths, list(range(n)), 3, alpha, vocabulary, begin, part, 0, 10).collect()}
    for u, history in enumerate(users):
        context, score = (*paths[history[-1]], part), {}
        for i in set(range(n)) - set(history):
            full = (*context, *paths[i], part)
            score[i] = sum(logp(full[:k], full[k]) for k in range(len(context), len(full)))
        assert len(set(got[u])) == 10 and np.allclose([score[i] for i in got[u]], sorted(score.values(), reverse=True)[:10])
