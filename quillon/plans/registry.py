"""Queries of the engine's operators over the driver's tables, with SQL for DuckDB.

Reviews are lineitem with orders (user o_custkey, item l_partkey, rating l_quantity, time o_orderdate), metadata is part,
item vectors are embeddings. Learned codebooks have no SQL; codes of fixed codebooks (the first rows of embeddings) do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.operators import codes, dataset, neighbors, quantize, sequence_lm, text_vectors
from quillon.operators.storage import cut
from quillon.sources import loose, sinks

MIN_RATING, MIN_ITEMS, ORDER, ALPHA, K1, K2 = 10, 5, 3, 0.001, 16, 8
#: The parting token and the vocabulary of item tokens, in SQL: one and three over the greatest item; two over it is the first token.
PART, VOCABULARY = (f"(SELECT max(item_idx) + {i} FROM items)" for i in (1, 3))
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- interactions, items, users, sequences


def _events(spark, d) -> DataFrame:
    line = _t(spark, d, "lineitem").where(F.col("l_quantity") >= MIN_RATING)
    e = line.join(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return e.select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("rating"), F.unix_timestamp("o_orderdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_partkey").alias("ord"))


def _kept(spark, d) -> DataFrame:
    return dataset.active_users(dataset.earliest(_events(spark, d), "u", "i", "ts", F.col("ord")), "u", MIN_ITEMS)


def _item_ids(spark, d, kept: DataFrame | None = None) -> DataFrame:
    kept = _kept(spark, d) if kept is None else kept
    first = _events(spark, d).groupBy("i").agg(F.min("ord").alias("first"))
    return dataset.dense_ids(first.join(kept.select("i").distinct(), "i", "left_semi"), "item_idx", "first").select("i", "item_idx")


def _user_ids(spark, d, kept: DataFrame | None = None) -> DataFrame:
    kept = _kept(spark, d) if kept is None else kept
    return dataset.dense_ids(kept.groupBy("u").agg(F.count("*").alias("sequence_length")), "user_idx", "u")


def _coded(spark, d) -> DataFrame:
    kept = cut(_kept(spark, d))  # read three times
    return kept.join(_item_ids(spark, d, kept), "i").join(_user_ids(spark, d, kept), "u")


def _seq(spark, d) -> DataFrame:
    return dataset.sequences(_coded(spark, d), "user_idx", "ts", "item_idx", "rating", "i")


_E = f"""ev AS (SELECT o_custkey u, l_partkey i, l_quantity rating, CAST(epoch(o_orderdate) AS BIGINT) ts, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_partkey) o
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= {MIN_RATING}),
one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY u, i ORDER BY ts, o) = 1),
kept AS (SELECT * FROM one QUALIFY count(*) OVER (PARTITION BY u) >= {MIN_ITEMS}),
items AS (SELECT i, CAST(row_number() OVER (ORDER BY min(o)) - 1 AS INT) item_idx FROM ev WHERE i IN (SELECT i FROM kept) GROUP BY i),
users AS (SELECT u, count(*) sequence_length, CAST(row_number() OVER (ORDER BY u) - 1 AS INT) user_idx FROM kept GROUP BY u),
coded AS (SELECT * FROM kept JOIN items USING (i) JOIN users USING (u)),
seq AS (SELECT user_idx, list(item_idx ORDER BY ts, i) items, list(rating ORDER BY ts, i) ratings, list(ts ORDER BY ts, i) times FROM coded GROUP BY user_idx)"""
_J = lambda x: F.array_join(F.col(x).cast("array<string>"), " ")


@query(f"WITH {_E} SELECT user_idx, item_idx, rating, ts FROM coded")
def interactions(spark, d):
    return _coded(spark, d).select("user_idx", "item_idx", "rating", "ts")


@query(f"WITH {_E} SELECT u, count(*) n, min(ts) first_ts, max(ts) last_ts FROM (SELECT * FROM ev QUALIFY count(*) OVER (PARTITION BY u) >= {MIN_ITEMS}) GROUP BY u")
def interactions_with_repeats(spark, d):
    return dataset.active_users(_events(spark, d), "u", MIN_ITEMS).groupBy("u").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {_E}, n AS (SELECT i, count(*) c FROM kept GROUP BY i)
SELECT item_idx, i AS asin, coalesce(p_name, CAST(i AS VARCHAR)) title, coalesce(p_brand, '<UNK>') brand, CAST(c AS BIGINT) interaction_count, CAST(p_partkey IS NOT NULL AS INT) has_metadata,
 'Title: ' || coalesce(p_name, CAST(i AS VARCHAR)) || '; Brand: ' || coalesce(p_brand, '<UNK>') || '; Categories: ' || coalesce(array_to_string(string_split(p_type, ' '), ' > '), '<UNK>') AS description
FROM items JOIN n USING (i) LEFT JOIN part ON p_partkey = i""")
def items(spark, d):
    n = _kept(spark, d).groupBy("i").agg(F.count("*").alias("interaction_count"))
    x = _item_ids(spark, d).join(n, "i").join(_t(spark, d, "part"), F.col("i") == F.col("p_partkey"), "left")
    title = F.coalesce(text.tidy(F.col("p_name")), F.col("i").cast("string"))
    title, brand = F.when(title == "", F.col("i").cast("string")).otherwise(title), F.coalesce("p_brand", F.lit("<UNK>"))
    path = text.category_path(F.array(F.coalesce(F.split("p_type", " "), F.array(F.lit("<UNK>")))), "beauty")
    return x.select("item_idx", F.col("i").alias("asin"), title.alias("title"), brand.alias("brand"), "interaction_count", F.col("p_partkey").isNotNull().cast("int").alias("has_metadata"), text.description(title, brand, path, F.lit(None)).alias("description"))


@query(f"WITH {_E} SELECT user_idx, u, CAST(sequence_length AS BIGINT) sequence_length FROM users")
def users(spark, d):
    return _user_ids(spark, d).select("user_idx", "u", "sequence_length")


@query(f"WITH {_E} SELECT user_idx, array_to_string(items, ' ') items, array_to_string(times, ' ') times FROM seq")
def sequences(spark, d):
    return _seq(spark, d).select("user_idx", _J("items").alias("items"), _J("times").alias("times"))


_SPLIT = "SELECT user_idx, array_to_string(items[1:{0}], ' ') history, CAST(items[{1}] AS INT) target FROM seq {2} WHERE len(items) >= {3}"


@query(f"WITH {_E} " + _SPLIT.format("p", "p + 1", ", unnest(range(1, len(items) - 2)) t(p)", 4))
def split_train(spark, d):
    return dataset.leave_one_out(_seq(spark, d), "user_idx")[0].select("user_idx", _J("history").alias("history"), "target")


@query(f"WITH {_E} " + _SPLIT.format("len(items) - 2", "len(items) - 1", "", 3))
def split_valid(spark, d):
    return dataset.leave_one_out(_seq(spark, d), "user_idx")[1].select("user_idx", _J("history").alias("history"), "target")


@query(f"WITH {_E} " + _SPLIT.format("len(items) - 1", "len(items)", "", 3))
def split_test(spark, d):
    return dataset.leave_one_out(_seq(spark, d), "user_idx")[2].select("user_idx", _J("history").alias("history"), "target")


@query(f"WITH {_E} SELECT (SELECT count(*) FROM kept) interactions, (SELECT count(*) FROM items) items, count(*) users, CAST(min(sequence_length) AS BIGINT) min_length, CAST(max(sequence_length) AS BIGINT) max_length, round(avg(sequence_length), 6) mean_length FROM users")
def dataset_stats(spark, d):
    n = _kept(spark, d).groupBy("u").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("interactions"), F.count("*").alias("users"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.round(F.avg("n"), 6).alias("mean_length")).join(F.broadcast(_kept(spark, d).agg(F.count_distinct("i").alias("items"))))


_POP = "pop AS (SELECT item_idx, CAST(coalesce(n, 0) AS BIGINT) n FROM items LEFT JOIN (SELECT x item_idx, count(*) n FROM (SELECT unnest(items[1:len(items) - 2]) x FROM seq WHERE len(items) >= 3) GROUP BY x) USING (item_idx))"


@query(f"WITH {_E}, {_POP} SELECT item_idx, n FROM pop")
def popularity(spark, d):
    return dataset.popularity(_seq(spark, d), _item_ids(spark, d), "item_idx")


@query(f"WITH {_E}, {_POP} SELECT item_idx, n, row_number() OVER (ORDER BY n DESC, item_idx) AS rank FROM pop ORDER BY n DESC, item_idx LIMIT 100")
def popularity_top(spark, d):
    top = dataset.popularity(_seq(spark, d), _item_ids(spark, d), "item_idx").orderBy(F.desc("n"), "item_idx").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item_idx")).cast("long"))


_RANK = f"""top AS (SELECT list(item_idx ORDER BY n DESC, item_idx) preds FROM (SELECT * FROM pop ORDER BY n DESC, item_idx LIMIT 100)),
hit AS (SELECT list_position(preds, items[len(items)]) r FROM seq, top WHERE len(items) >= 3)"""


@query(f"WITH {_E}, {_POP}, {_RANK} SELECT " + ", ".join(f"round(avg(CASE WHEN r BETWEEN 1 AND {k} THEN 1.0 ELSE 0 END), 6) recall_{k}, round(avg(CASE WHEN r BETWEEN 1 AND {k} THEN 1 / log2(r + 1) ELSE 0 END), 6) ndcg_{k}, round(avg(CASE WHEN r BETWEEN 1 AND {k} THEN 1.0 / r ELSE 0 END), 6) mrr_{k}" for k in (10, 100)) + " FROM hit")
def ranking_of_popular(spark, d):
    top = popularity_top(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_idx"))), lambda x: x["item_idx"]).alias("preds"))
    test = dataset.leave_one_out(_seq(spark, d), "user_idx")[2].select("target")
    m = sequence_lm.ranking(test.join(F.broadcast(top)), [10, 100])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


# ---- tokens and the n-gram model

_TOK = "tok AS (SELECT user_idx, [sep + 1] || flatten(list_transform(items[1:len(items) - 2], lambda x: [CAST(x AS BIGINT), sep])) t FROM seq, (SELECT CAST(max(item_idx) + 1 AS BIGINT) sep FROM items) z WHERE len(items) >= 3)"
_GRAM = f"""gram AS (SELECT array_to_string(t[p - n:p - 1], ' ') ctx, t[p] token, CAST(n AS INT) len, count(*) n FROM tok, unnest(range(2, len(t) + 1)) a(p), unnest(range(0, {ORDER})) b(n) WHERE n <= p - 1 GROUP BY ALL)"""


def _sizes(seq: DataFrame) -> tuple[int, int, int]:
    """The parting token, the first token and the vocabulary."""
    most = seq.agg(F.max(F.array_max("items"))).first()[0]
    n = 0 if most is None else most + 1
    return n, n + 1, n + 2


def _tokens(spark, d, seq: DataFrame | None = None) -> DataFrame:
    seq = cut(_seq(spark, d)) if seq is None else seq
    part, begin, _ = _sizes(seq)
    return sequence_lm.streams(seq.where(F.size("items") >= 3), "user_idx", begin, part)


@query(f"WITH {_E}, {_TOK} SELECT user_idx, array_to_string(t, ' ') tokens FROM tok")
def token_streams(spark, d):
    return _tokens(spark, d).select("user_idx", _J("tokens").alias("tokens"))


@query(f"WITH {_E}, {_TOK}, {_GRAM} SELECT ctx, token, n FROM gram")
def ngram_counts(spark, d):
    return sequence_lm.ngram_counts(_tokens(spark, d), ORDER).select(_J("context").alias("ctx"), "token", "n")


@query(f"""WITH {_E}, {_TOK}, {_GRAM}, tot AS (SELECT ctx, sum(n) s FROM gram GROUP BY ctx), q AS (SELECT user_idx, [CAST(items[len(items) - 2] AS BIGINT), {PART}] c, CAST(items[len(items)] AS BIGINT) token FROM seq WHERE len(items) >= 3),
lp AS (SELECT ctx, token, ln((n + {ALPHA}) / (s + {ALPHA} * {VOCABULARY})) lp FROM gram JOIN tot USING (ctx))
SELECT user_idx, round(coalesce(a.lp, b.lp, z.lp, ln({ALPHA} / ((SELECT s FROM tot WHERE ctx = '') + {ALPHA} * {VOCABULARY}))), 6) logp FROM q
LEFT JOIN lp a ON a.ctx = array_to_string(c, ' ') AND a.token = q.token LEFT JOIN lp b ON b.ctx = CAST(c[2] AS VARCHAR) AND b.token = q.token LEFT JOIN lp z ON z.ctx = '' AND z.token = q.token""")
def ngram_backoff(spark, d):
    seq = cut(_seq(spark, d))  # read for its tokens, its counts and its queries
    part, _, vocabulary = _sizes(seq)
    counts = cut(sequence_lm.ngram_counts(_tokens(spark, d, seq), ORDER))  # joined once a length
    q = seq.where(F.size("items") >= 3).select("user_idx", F.array(F.element_at("items", -3).cast("long"), F.lit(part).cast("long")).alias("context"), F.element_at("items", -1).cast("long").alias("token"))
    return sequence_lm.backoff(q, counts, ORDER, ALPHA, vocabulary).select("user_idx", F.round("logp", 6).alias("logp"))


@query()
def beam_decode(spark, d):
    """The ten best items of every user after the last one of the history, of all items."""
    seq = cut(_seq(spark, d))
    part, begin, vocabulary = _sizes(seq)
    counts = cut(sequence_lm.ngram_counts(_tokens(spark, d, seq), ORDER))
    test, shared = sequence_lm.last_contexts(dataset.leave_one_out(seq, "user_idx")[2], counts, part, "after")
    model = sequence_lm.Model.of(shared)
    popular = sequence_lm.most_popular(dataset.popularity(seq, _item_ids(spark, d), "item_idx"), "item_idx")
    return sequence_lm.beam_decode(test, "user_idx", model, None, (popular, popular[:, None]), popular, ORDER, ALPHA, vocabulary, begin, part, 0, 10, own="after").select("user_idx", _J("preds").alias("preds"))


# ---- vectors and codes


def _vec(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _books(spark, d) -> list[np.ndarray]:
    few = {r.vec_id: r.x for r in _vec(spark, d).where(F.col("vec_id") < K1 + K2).collect()}
    return [np.array([few[i] for i in range(K1)]), np.array([few[K1 + i] for i in range(K2)]) * 0.5]


def _codes(spark, d) -> DataFrame:
    return quantize.residual_codes(_vec(spark, d), "vec_id", "x", _books(spark, d)).select(F.col("key").alias("vec_id"), "codes")


_V = f"""dims AS (SELECT vec_id, j, CAST(embedding[j] AS DOUBLE) x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(j)),
c1 AS (SELECT vec_id, arg_min(k, (e, k)) k1, min(e) e1 FROM (SELECT a.vec_id, b.vec_id k, sum((a.x - b.x) ** 2) e FROM dims a JOIN dims b USING (j) WHERE b.vec_id < {K1} GROUP BY ALL) GROUP BY vec_id),
rest AS (SELECT a.vec_id, a.j, a.x - b.x x FROM dims a JOIN c1 USING (vec_id) JOIN dims b ON b.vec_id = k1 AND b.j = a.j),
c2 AS (SELECT vec_id, arg_min(k, (e, k)) k2, min(e) e2 FROM (SELECT a.vec_id, b.vec_id - {K1} k, sum((a.x - 0.5 * b.x) ** 2) e FROM rest a JOIN dims b USING (j) WHERE b.vec_id >= {K1} AND b.vec_id < {K1 + K2} GROUP BY ALL) GROUP BY vec_id),
sid AS (SELECT vec_id, CAST(k1 AS INT) k1, CAST(k2 AS INT) k2, CAST(k1 AS VARCHAR) || '-' || CAST(k2 AS VARCHAR) sid, e1, e2 FROM c1 JOIN c2 USING (vec_id))"""


@query(f"WITH {_V} SELECT vec_id, sid, k1 || '-' || (k2 + {K1}) sid_offset FROM sid")
def item_to_sid(spark, d):
    return _codes(spark, d).select("vec_id", vectors.code_text(F.col("codes")).alias("sid"), vectors.code_text(vectors.offset_codes(F.col("codes"), [K1, K2])).alias("sid_offset"))


@query(f"WITH {_V} SELECT vec_id, k1 sid_0, k2 sid_1, k1 sid_offset_0, CAST(k2 + {K1} AS INT) sid_offset_1, sid, k1 || '-' || (k2 + {K1}) sid_offset FROM sid")
def sid_table(spark, d):
    return sinks.sid_table(_codes(spark, d), "vec_id", [K1, K2])


@query(f"WITH {_V}, g AS (SELECT 1 AS depth, count(*) n FROM sid GROUP BY k1 UNION ALL SELECT 2, count(*) FROM sid GROUP BY sid) SELECT CAST(depth AS INT) AS depth, count(*) unique_prefixes, round(count(*) / sum(n), 6) unique_ratio, CAST(sum(n) - count(*) AS BIGINT) extra_collisions, round((sum(n) - count(*)) / sum(n), 6) collision_rate_extra, count(*) FILTER (n > 1) collision_groups, max(n) max_group_size FROM g GROUP BY depth")
def prefix_stats(spark, d):
    p = codes.prefixes(_codes(spark, d))
    return p.withColumns({c: F.round(c, 6) for c in ("unique_ratio", "collision_rate_extra")})


_USE = f"""allc AS (SELECT 0 pos, {K1} clusters, unnest(range(0, {K1})) code UNION ALL SELECT 1, {K2}, unnest(range(0, {K2}))), cnt AS (SELECT pos, clusters, code, coalesce(n, 0) n FROM allc LEFT JOIN (SELECT 0 pos, k1 code, count(*) n FROM sid GROUP BY k1 UNION ALL SELECT 1, k2, count(*) FROM sid GROUP BY k2) USING (pos, code)),
rk AS (SELECT *, sum(n) OVER (PARTITION BY pos) total, row_number() OVER (PARTITION BY pos ORDER BY n, code) r FROM cnt)"""


@query(f"WITH {_V}, {_USE} SELECT CAST(pos AS INT) pos, CAST(clusters AS INT) clusters, count(*) FILTER (n > 0) used_codes, round(sum(CASE WHEN n > 0 THEN -n / total * log2(n / total) END), 6) entropy, round(2 * sum(r * n) / (max(clusters) * sum(n)) - (max(clusters) + 1) / max(clusters), 6) gini, min(n) FILTER (n > 0) min_count, CAST(floor(quantile_cont(n, 0.5) FILTER (n > 0)) AS BIGINT) p50_count, CAST(floor(quantile_cont(n, 0.9) FILTER (n > 0)) AS BIGINT) p90_count, max(n) max_count, round(max(n) / max(total), 6) max_share FROM rk GROUP BY pos, clusters")
def code_usage(spark, d):
    sizes = spark.createDataFrame([(0, K1), (1, K2)], "pos int, clusters int")
    u = codes.usage(_codes(spark, d), "vec_id", sizes)
    return u.select("pos", "clusters", "used_codes", F.round("entropy", 6).alias("entropy"), F.round("gini", 6).alias("gini"), "min_count", "p50_count", "p90_count", "max_count", F.round("max_share", 6).alias("max_share"))


@query(f"WITH {_V} SELECT sid, count(*) group_size, min(vec_id) first_key, array_to_string(list(vec_id ORDER BY vec_id)[1:30], ' ') keys_head FROM sid GROUP BY sid HAVING count(*) >= 2")
def collision_groups(spark, d):
    return codes.groups(_codes(spark, d), "vec_id", 2).select(vectors.code_text(F.col("codes")).alias("sid"), "group_size", "first_key", _J("keys_head").alias("keys_head"))


@query(f"WITH {_V} SELECT vec_id, sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY vec_id) - 1 AS INT) suffix, count(*) OVER (PARTITION BY sid) group_size FROM sid")
def item_sid_index(spark, d):
    return codes.suffixes(_codes(spark, d), "vec_id").select("vec_id", vectors.code_text(F.col("codes")).alias("sid"), "suffix", "group_size")


@query(f"WITH {_V} SELECT vec_id FROM sid WHERE k1 = 3 AND k2 = 2")
def query_sid(spark, d):
    return _codes(spark, d).where(F.col("codes") == F.array(F.lit(3), F.lit(2))).select("vec_id")


@query(f"WITH {_V} SELECT DISTINCT 1 AS depth, '' AS prefix, k1 AS token FROM sid UNION SELECT DISTINCT 2, CAST(k1 AS VARCHAR), k2 FROM sid")
def trie_edges(spark, d):
    return codes.trie_edges(_codes(spark, d)).select("depth", _J("prefix").alias("prefix"), "token")


@query(f"WITH {_V} SELECT round(avg(e1), 6) mse_1, round(avg(e2), 6) mse_2 FROM sid")
def quantization_error(spark, d):
    b, v = _books(spark, d), _vec(spark, d)
    one, two = (quantize.residual_codes(v, "vec_id", "x", b[:n], np.eye(64), [np.zeros((1, 64))]).select(F.avg("error").alias(f"mse_{n}")) for n in (1, 2))
    return one.crossJoin(F.broadcast(two)).select(F.round("mse_1", 6).alias("mse_1"), F.round("mse_2", 6).alias("mse_2"))  # one row each


_RECON = f"rec AS (SELECT a.vec_id, sum(a.x * y) / (sqrt(sum(a.x * a.x)) * sqrt(sum(y * y))) cosine FROM (SELECT d.vec_id, d.j, d.x, b.x + 0.5 * c.x y FROM dims d JOIN sid USING (vec_id) JOIN dims b ON b.vec_id = k1 AND b.j = d.j JOIN dims c ON c.vec_id = k2 + {K1} AND c.j = d.j) a GROUP BY a.vec_id)"


def _reconstructed(spark, d):
    y = quantize.reconstructed(_codes(spark, d), "vec_id", _books(spark, d)).select(F.col("key").alias("vec_id"), F.col("vector").alias("y"))
    return _vec(spark, d).join(y, "vec_id")


@query(f"WITH {_V}, {_RECON} SELECT round(avg(cosine), 6) mean, round(quantile_cont(cosine, 0.1), 6) p10, round(quantile_cont(cosine, 0.5), 6) p50, round(quantile_cont(cosine, 0.9), 6) p90 FROM rec")
def reconstruction_cosine(spark, d):
    c = _reconstructed(spark, d).select(vectors.cosine(F.col("x"), F.col("y")).alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("mean"), *[F.round(F.percentile("c", F.lit(q)), 6).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) ** 2))), 6) norm, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) ** 2))), 1e-12), 6) first FROM embeddings")
def unit_vectors(spark, d):
    x = F.col("x")
    return _vec(spark, d).select("vec_id", F.round(vectors.norm(x), 6).alias("norm"), F.round(F.get(vectors.l2(x), F.lit(0)), 6).alias("first"))


@query("SELECT label, round(avg(CAST(embedding[j] AS DOUBLE)), 6) mean, CAST(j - 1 AS INT) j, count(*) n FROM embeddings, unnest(range(1, 65)) t(j) GROUP BY label, j")
def category_means(spark, d):
    return _vec(spark, d).select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) x FROM embeddings), u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) s FROM n)
SELECT vec_id, round(x[1] / s, 6) t0, round(0.5 * x[64] / s, 6) i0, round((x[1] + x[64]) / s / 2, 6) m0 FROM u""")
def fused_vectors(spark, d):
    x, y = F.col("x"), F.reverse("x")
    fused = F.concat(vectors.weighted(x, 1.0), vectors.weighted(y, 0.5))
    f = _vec(spark, d).select("vec_id", fused.alias("f"), vectors.middle(x, y).alias("m"))
    return f.select("vec_id", F.round(F.get("f", F.lit(0)), 6).alias("t0"), F.round(F.get("f", F.lit(64)), 6).alias("i0"), F.round(F.get("m", F.lit(0)), 6).alias("m0"))


_KNN = """u AS (SELECT vec_id, j, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) x FROM (SELECT vec_id, j, CAST(embedding[j] AS DOUBLE) x FROM embeddings, unnest(range(1, 65)) t(j))),
knn AS (SELECT anchor, neighbour, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, neighbour) r FROM (SELECT a.vec_id anchor, b.vec_id neighbour, round(sum(a.x * b.x), 9) sim FROM u a JOIN u b USING (j) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL) QUALIFY r <= 10)"""


def _knn(spark, d):
    v = _vec(spark, d)
    return neighbors.knn(v, "vec_id", "x", v.where("vec_id % 50 = 0"), 10)


@query(f"WITH {_KNN} SELECT anchor, neighbour, CAST(r AS INT) AS rank FROM knn")
def nearest_neighbours(spark, d):
    return _knn(spark, d).select("anchor", "neighbour", "rank")


@query(f"WITH {_V}, {_KNN} SELECT CAST(CASE WHEN a.k1 <> b.k1 THEN 0 WHEN a.k2 <> b.k2 THEN 1 ELSE 2 END AS INT) lcp, count(*) n FROM knn JOIN sid a ON a.vec_id = anchor JOIN sid b ON b.vec_id = neighbour GROUP BY 1")
def neighbour_prefixes(spark, d):
    c = _codes(spark, d)
    k = _knn(spark, d).join(c.select(F.col("vec_id").alias("anchor"), F.col("codes").alias("a")), "anchor").join(c.select(F.col("vec_id").alias("neighbour"), F.col("codes").alias("b")), "neighbour")
    return k.groupBy(vectors.common_prefix(F.col("a"), F.col("b")).alias("lcp")).agg(F.count("*").alias("n"))


_KNN_Y = """ry AS (SELECT d.vec_id, d.j, b.x + 0.5 * c.x x FROM dims d JOIN sid USING (vec_id) JOIN dims b ON b.vec_id = k1 AND b.j = d.j JOIN dims c ON c.vec_id = k2 + %d AND c.j = d.j),
uy AS (SELECT vec_id, j, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) x FROM ry),
knn_y AS (SELECT anchor, neighbour, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, neighbour) r FROM (SELECT a.vec_id anchor, b.vec_id neighbour, round(sum(a.x * b.x), 9) sim FROM uy a JOIN uy b USING (j) WHERE a.vec_id %% 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL) QUALIFY r <= 10)""" % K1


@query(f"WITH {_V}, {_KNN}, {_KNN_Y}, hit AS (SELECT x.anchor, count(y.neighbour) / 10.0 recall FROM knn x LEFT JOIN knn_y y ON y.anchor = x.anchor AND y.neighbour = x.neighbour GROUP BY x.anchor) SELECT count(*) anchors, round(avg(recall), 6) mean, round(quantile_cont(recall, 0.5), 6) p50, round(quantile_cont(recall, 0.9), 6) p90 FROM hit")
def neighbour_recall(spark, d):
    """Share of each anchor's ten neighbours that are also neighbours among the reconstructions."""
    rec = _reconstructed(spark, d).select("vec_id", "y")
    lists = lambda k, name: k.groupBy("anchor").agg(F.collect_list("neighbour").alias(name))
    found = neighbors.knn(rec, "vec_id", "y", rec.where("vec_id % 50 = 0"), 10)
    hit = lists(_knn(spark, d), "a").join(lists(found, "b"), "anchor").select(neighbors.agreement(F.col("a"), F.col("b"), 10).alias("r"))
    return hit.agg(F.count("*").alias("anchors"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("r", F.lit(0.9)), 6).alias("p90"))


@query("SELECT count(*) n, min(value) least, max(value) most, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, count(DISTINCT value) distinct_values FROM events")
def array_profile(spark, d):
    return loose.profile(_t(spark, d, "events"), "value").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT CAST(b AS INT) AS bin, count(value) n FROM unnest(range(1, 21)) t(b) LEFT JOIN events ON least(1 + CAST(floor(value / 5.0) AS INT), 20) = b AND value BETWEEN 0 AND 100 GROUP BY b")
def value_histogram(spark, d):
    return neighbors.histogram(_t(spark, d, "events"), F.col("value"), 0.0, 100.0, 20)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- learned codebooks


@query()
def learned_codes(spark, d):
    v = _vec(spark, d)
    books = quantize.train_residual(v, "vec_id", "x", 2, 16, 3)
    rotation, products = quantize.train_product(v, "vec_id", "x", books, 2, 8, 2, 2)
    c = quantize.residual_codes(v, "vec_id", "x", books, rotation, products)
    return c.select("key", vectors.code_text(F.col("codes")).alias("sid"), F.round("error", 6).alias("error"))


@query()
def principal_components(spark, d):
    mean, top, share = quantize.principal(_vec(spark, d), "x", 8)
    return spark.createDataFrame([(i, float(s), [float(x) for x in v]) for i, (s, v) in enumerate(zip(share, top))], "component int, variance_share double, loadings array<double>")


@query()
def text_vectors_of_items(spark, d):
    x = text_vectors.hashing_svd(items(spark, d).select("item_idx", "description"), "item_idx", "description", 16, 1 << 12)
    return x.select("item_idx", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))
