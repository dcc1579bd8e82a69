import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.functions import text, vectors
from quillon.operators import codes, dataset, quantize, sequence_lm, text_vectors
from quillon.plans import registry
from quillon.sources import loose, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], (int, float)) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_prefixes_and_suffixes(spark):
    rows = [(0, 1, 2), (0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 1, 2), (0, 1, 2)]
    df = spark.createDataFrame([(i, list(c)) for i, c in enumerate(rows)], "id long, codes array<int>")
    p = {r.depth: (r.unique_prefixes, r.extra_collisions, r.collision_groups, r.max_group_size) for r in codes.prefixes(df).collect()}
    assert p == {1: (2, 4, 1, 5), 2: (3, 3, 1, 4), 3: (4, 2, 1, 3)}
    s = {r.id: r.suffix for r in codes.suffixes(df, "id").collect()}
    assert [s[i] for i in range(6)] == [0, 1, 0, 0, 0, 2]


def test_usage(spark):
    df = spark.createDataFrame([(i, [0 if i < 5 else 1]) for i in range(6)], "id long, codes array<int>")
    u = codes.usage(df, "id", spark.createDataFrame([(0, 4)], "pos int, clusters int")).first()
    assert (round(u.gini, 10), round(u.entropy, 10), u.utilization) == (0.6666666667, 0.6500224216, 0.5)


def test_ngram(spark):
    df = spark.createDataFrame([([9, 1, 8, 2, 8],)], "tokens array<long>")
    n = sequence_lm.ngram_counts(df, 2)
    assert {(tuple(r.context), r.token): r.n for r in n.collect()} == {((), 1): 1, ((), 2): 1, ((), 8): 2, ((1,), 8): 1, ((2,), 8): 1, ((8,), 2): 1, ((9,), 1): 1}
    q = spark.createDataFrame([(0, [1], 8), (1, [8], 1), (2, [8], 5)], "id int, context array<long>, token long")
    got = {r.id: round(r.logp, 9) for r in sequence_lm.backoff(q, n, 2, 0.001, 10).collect()}
    assert got == {0: -0.008950831, 1: -1.387791741, 2: -8.296546520}


def test_ranking(spark):
    m = sequence_lm.ranking(spark.createDataFrame([([1, 2, 3], 3)], "preds array<long>, target long"), [3]).first()
    assert (m.recall_3, m.ndcg_3, round(m.mrr_3, 6)) == (1.0, 0.5, 0.333333)


def test_leave_one_out(spark):
    train, valid, test = dataset.leave_one_out(spark.createDataFrame([(0, list("abcde")), (1, list("ab"))], "u int, items array<string>"), "u")
    assert sorted((r.history, r.target) for r in train.collect()) == [(["a"], "b"), (["a", "b"], "c")]
    assert [(r.history, r.target) for r in valid.collect()] == [(list("abc"), "d")]
    assert [(r.history, r.target) for r in test.collect()] == [(list("abcd"), "e")]


def test_vectors(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 4], [0.0, 0.0])], "a array<int>, b array<int>, z array<double>")
    r = df.select(vectors.common_prefix(F.col("a"), F.col("b")).alias("p"), vectors.l2(F.col("z")).alias("z"), vectors.resize(F.col("z"), 3).alias("w"), vectors.offset_codes(F.array(*map(F.lit, (1, 2, 0, 2))), [4, 4, 3, 3]).alias("o")).first()
    assert (r.p, r.z, r.w, r.o) == (2, [0.0, 0.0], [0.0, 0.0, 0.0], [1, 6, 8, 13])


def test_text(spark):
    df = spark.createDataFrame([(" a\nb ", [["Beauty", " Hair "]]), (None, None)], "t string, c array<array<string>>")
    got = df.select(text.tidy(F.col("t")).alias("t"), text.category_path(F.col("c"), "beauty").alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [("a b", ["Hair"]), ("", [])]


def test_loose_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{\'a\': 2, \'b\': True}\n')
    assert [r.a for r in loose.read_loose(spark, str(tmp_path / "x.json"), "a int").orderBy("row_ord").collect()] == [1, 2]


def test_array_file(spark, tmp_path):
    x = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "x.npy", x)
    spark.dataSource.register(loose.ArrayFile)
    got = spark.read.format("array_file").option("rows", 4).load(str(tmp_path / "x.npy")).orderBy("row_id").collect()
    assert [r["values"] for r in got] == x.tolist()


def test_learned_codes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    books = quantize.train_residual(df, "id", "x", 2, 8, 4)
    again = quantize.train_residual(df.repartition(7), "id", "x", 2, 8, 4)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(books, again))
    rotation, products = quantize.train_product(df, "id", "x", books, 2, 4)
    assert np.abs(rotation.T @ rotation - np.eye(8)).max() < 1e-5
    mean, top, share = quantize.principal(df, "x", 3)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    assert np.allclose(np.abs((top * want).sum(axis=1)), 1, atol=1e-6) and np.allclose(mean, x.mean(axis=0))


def test_text_vectors(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "\u00c9t\u00e9", "the", "delta", "x", "omega", "kappa"]) for _ in range(9))) for i in range(60)] + [(60, None), (61, "the of"), (5, "beta beta")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    got = {(r.id, tuple(r.terms)) for r in text_vectors.terms(df.where("id in (60, 61) or t = 'beta beta'"), "id", "t").collect()}
    assert got == {(60, ()), (61, ()), (5, ("beta", "beta", "beta beta"))}
    rows = text_vectors.hashed(text_vectors.terms(df, "id", "t"), "id", 64)
    dense = np.zeros((len(texts), 64))
    for i, r in enumerate(rows.collect()):
        dense[i, r.buckets] = r.weights
    size = (dense * dense).sum(axis=1)
    assert np.allclose(size[size > 0], 1) and (size == 0).sum() == 2
    values, right = text_vectors.truncated_svd(rows, "id", 64, 4, rounds=12)
    u, want, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, want[:4], atol=1e-3) and np.allclose(right @ right.T, vt[:4].T @ vt[:4], atol=0.05)
    out = text_vectors.hashing_svd(df, "id", "t", 6, 64).collect()
    assert len(out) == len(texts) and all(len(r.embedding) == 6 for r in out) and not any(np.any(r.embedding) for r in out if r.id in (60, 61))
    for few in (df.limit(0), df.where("id = 3"), df.where("id >= 60")):
        assert not any(np.any(r.embedding) for r in text_vectors.hashing_svd(few, "id", "t", 6, 64).collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 0]), (2, None)], "id long, codes array<int>")
    sinks.write_csv(sinks.sid_table(df, "id", [4, 4]), f"{tmp_path}/c", ("id", 2))
    got = sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect())
    assert got == [("0", "1", "2", "1", "6", "1-2", "1-6"), ("1", "3", "0", "3", "4", "3-0", "3-4")]
    sinks.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/j").collect()) == [0, 1, 2]
    assert json.loads(sinks.measures(df.groupBy().count())) == {"count": 3}
    with pytest.raises(ValueError):
        sinks.measures(df)
    assert "| 1 |" in sinks.report("R", {"t": df.select("id").orderBy("id")}) and "first 2 rows" in sinks.report("R", {"t": df}, 2)


def test_dense_ids_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 10007).alias("k"), F.col("id").cast("string").alias("s")).repartition(7)
    for column in ("k", "s"):
        got = sorted((r[column], r["i"]) for r in dataset.dense_ids(rows, "i", column).collect())
        assert [i for _, i in got] == list(range(5000))
    got = dataset.dense_ids(spark.createDataFrame([(None,), (3,), (1,)], "k int"), "i", "k").collect()
    assert sorted((r["i"], r["k"]) for r in got) == [(0, None), (1, 1), (2, 3)]
    assert dataset.dense_ids(rows.where("k < 0"), "i", "k").count() == 0


def test_bounded_tables(spark):
    assert len(sequence_lm.bounded(spark.range(5), "five", 5)) == 5
    with pytest.raises(ValueError):
        sequence_lm.bounded(spark.range(6), "six", 5)
