"""Queries of the evaluation operators, with SQL for DuckDB; importing this adds them to the registry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.operators import codes, dataset, evaluation, sequence_lm
from quillon.operators.storage import cut
from quillon.plans.registry import _E, _KNN, _POP, _TOK, _USE, _V, K1, K2, MIN_ITEMS, _coded, _codes, _item_ids, _J, _kept, _knn, _seq, _sizes, _t, _vec, query
from quillon.sources import readers

DIM, UNSEEN, WEIGHTS = 32, 3, (1.0, 0.5, 0.2)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def metadata_last(spark, d):
    wanted = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").join(wanted, "o_custkey", "left_semi")
    return evaluation.last_wins(rows, "o_custkey", F.col("o_orderkey"))


@query(f"WITH {_E} SELECT (SELECT count(*) FROM kept) interactions, (SELECT count(*) FROM items) items, (SELECT count(*) FROM items JOIN part ON p_partkey = i) items_with_metadata, count(*) users, CAST(min(sequence_length) AS BIGINT) min_length, CAST(max(sequence_length) AS BIGINT) max_length, round(avg(sequence_length), 6) mean_length FROM users")
def dataset_coverage(spark, d):
    kept = cut(_kept(spark, d))
    items = kept.select("i").distinct().join(_t(spark, d, "part").select(F.col("p_partkey").alias("i"), F.lit(1).alias("known")), "i", "left").agg(F.count("*").alias("items"), F.count("known").alias("items_with_metadata"))
    n = kept.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum("n").alias("interactions"), F.count("*").alias("users"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.round(F.avg("n"), 6).alias("mean_length"))
    return n.crossJoin(F.broadcast(items))  # one row each


@query(f"WITH {_E} SELECT user_idx, array_to_string(items, ' ') items, array_to_string(ratings, ' ') ratings, array_to_string(times, ' ') times FROM (SELECT user_idx, items, list_transform(ratings, lambda r: CAST(r AS INT)) ratings, times FROM seq)")
def sequences_with_ratings(spark, d):
    return _seq(spark, d).select("user_idx", _J("items").alias("items"), F.array_join(F.transform("ratings", lambda r: r.cast("int").cast("string")), " ").alias("ratings"), _J("times").alias("times"))


@query("""SELECT p_partkey, '{' || array_to_string(list_sort(['"' || p_brand || '": ' || p_size, '"size of ' || p_type || '": ' || p_partkey]), ', ') || '}' rank, p_brand || ' ' || p_size || ' size of ' || p_type || ' ' || p_partkey AS flat, p_name || ' ' || p_brand || ' ' || p_type AS nested FROM part""")
def text_shapes(spark, d):
    """A map as JSON and as text, and lists of lists as text."""
    p = _t(spark, d, "part")
    m = F.create_map(F.col("p_brand"), F.col("p_size").cast("long"), F.concat(F.lit("size of "), F.col("p_type")), F.col("p_partkey"))
    nested = F.array(F.array("p_name", "p_brand"), F.array("p_type"))
    return p.select("p_partkey", text.rank_json(m).alias("rank"), text.tidy_map(m).alias("flat"), text.tidy_lists(nested).alias("nested"))


@query("SELECT p_partkey, 'Title: ' || p_name || '; Brand: ' || p_brand || '; Categories: ' || p_type || CASE WHEN p_size % 2 = 0 THEN '; Price: ' || p_size ELSE '' END || '; SalesRank: {\"' || p_brand || '\": ' || p_size || '}' description FROM part")
def priced_descriptions(spark, d):
    p = _t(spark, d, "part")
    price = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    return p.select("p_partkey", text.description(F.col("p_name"), F.col("p_brand"), F.array("p_type"), price, text.rank_json(F.create_map("p_brand", "p_size"))).alias("description"))


# ---- codes


_SIZED = f"WITH {_V}, g AS (SELECT k1, k2, sid, count(*) n, list(vec_id ORDER BY vec_id) ids FROM sid GROUP BY ALL)"


@query(f"{_SIZED} SELECT CAST(row_number() OVER (ORDER BY n DESC, k1, k2) AS INT) place, sid, n group_size, array_to_string(ids[1:30], ' ') keys_head FROM g WHERE n >= 2 ORDER BY n DESC, k1, k2 LIMIT 100")
def collisions_top(spark, d):
    return evaluation.ordered_groups(_codes(spark, d), "vec_id", 100).select("place", vectors.code_text(F.col("codes")).alias("sid"), "group_size", _J("keys_head").alias("keys_head"))


@query(f"{_SIZED} SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) unique_codes, CAST(sum(n) - count(*) AS BIGINT) extra_collisions, count(*) FILTER (n > 1) collision_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) colliding_rows, max(n) max_group_size, array_to_string(list(n ORDER BY n DESC) FILTER (n > 1)[1:20], ' ') top_sizes FROM g")
def collision_summary(spark, d):
    s = evaluation.collision_summary(_codes(spark, d))
    return s.withColumn("top_sizes", _J("top_sizes"))


@query(f"{_SIZED} SELECT vec_id, sid.sid, g.n group_size, CAST(row_number() OVER (PARTITION BY sid.sid ORDER BY vec_id) - 1 AS INT) suffix FROM sid JOIN g ON g.sid = sid.sid WHERE g.n >= 2")
def collision_items(spark, d):
    return codes.suffixes(_codes(spark, d), "vec_id").where("group_size >= 2").select("vec_id", vectors.code_text(F.col("codes")).alias("sid"), "group_size", "suffix")


def _places(spark):
    return spark.createDataFrame([(0, K1), (1, K2)], "pos int, clusters int")


_Q = lambda q: f"CAST(floor(quantile_cont(n, {q}) FILTER (n > 0)) AS BIGINT)"


@query(f"""WITH {_V}, {_USE}, h AS (SELECT pos, clusters, sum(CASE WHEN n > 0 THEN -n / total * log2(n / total) END) e FROM rk GROUP BY ALL)
SELECT CAST(rk.pos AS INT) pos, CAST(rk.clusters AS INT) clusters, count(*) FILTER (n > 0) used_codes, round(count(*) FILTER (n > 0) / max(rk.clusters), 6) cur, round(max(e), 6) entropy, round(max(e) / log2(max(rk.clusters)), 6) entropy_ratio, round(pow(2, max(e)), 5) effective_codes,
 round(pow(2, max(e)) / max(rk.clusters), 6) effective_code_ratio, round(2 * sum(r * n) / (max(rk.clusters) * sum(n)) - (max(rk.clusters) + 1) / max(rk.clusters), 6) gini, min(n) FILTER (n > 0) min_count, {_Q(0.5)} p50_count, {_Q(0.9)} p90_count, {_Q(0.95)} p95_count, {_Q(0.99)} p99_count, max(n) max_count, round(max(n) / max(total), 6) max_share
FROM rk JOIN h ON h.pos = rk.pos GROUP BY rk.pos, rk.clusters""")
def code_usage_fields(spark, d):
    u = evaluation.usage_fields(_codes(spark, d), "vec_id", _places(spark))
    r = {c: F.round(c, 6) for c in ("cur", "entropy", "entropy_ratio", "effective_code_ratio", "gini", "max_share")}
    return u.withColumns(r | {"effective_codes": F.round("effective_codes", 5)})


@query(f"WITH {_V}, {_USE} SELECT CAST(pos AS INT) pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY n DESC, code) - 1 AS INT) AS rank, CAST(n AS BIGINT) n FROM cnt")
def usage_curve(spark, d):
    return evaluation.usage_curve(_codes(spark, d), "vec_id", _places(spark))


_N = "(SELECT count(*) FROM embeddings)"
_PAIR = f"pair AS (SELECT vec_id, CASE WHEN (vec_id * 7919 + 13) % {_N} = vec_id THEN (vec_id + 1) % {_N} ELSE (vec_id * 7919 + 13) % {_N} END other FROM embeddings)"


@query(f"WITH {_PAIR} SELECT vec_id, other FROM pair")
def random_pairs(spark, d):
    v = _vec(spark, d)
    return evaluation.random_pairs(v, "vec_id", v.count())


_LCP = "CAST(CASE WHEN a.k1 <> b.k1 THEN 0 WHEN a.k2 <> b.k2 THEN 1 ELSE 2 END AS INT)"


@query(f"""WITH {_V}, {_KNN}, {_PAIR}, l AS (SELECT 'neighbour' kind, {_LCP} lcp FROM knn JOIN sid a ON a.vec_id = anchor JOIN sid b ON b.vec_id = neighbour UNION ALL SELECT 'random', {_LCP} FROM pair p JOIN sid a ON a.vec_id = p.vec_id JOIN sid b ON b.vec_id = p.other),
z AS (SELECT k.kind, CAST(x.lcp AS INT) lcp, count(l.lcp) n FROM (SELECT unnest(['neighbour', 'random']) kind) k CROSS JOIN (SELECT unnest(range(0, 3)) lcp) x LEFT JOIN l ON l.kind = k.kind AND l.lcp = x.lcp GROUP BY ALL)
SELECT kind, lcp, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM z""")
def prefix_agreement(spark, d):
    """Common prefixes of neighbours and of random pairs, lengths that don't occur included."""
    c, v = _codes(spark, d), _vec(spark, d)
    pairs = evaluation.random_pairs(v, "vec_id", v.count())
    parts = [("neighbour", _knn(spark, d), "anchor", "neighbour"), ("random", pairs, "vec_id", "other")]
    out = None
    for kind, p, a, b in parts:
        h = cut(evaluation.prefix_histogram(p, c, "vec_id", a, b, 2))
        total = h.agg(F.sum("n").alias("total"))
        h = h.crossJoin(F.broadcast(total)).select(F.lit(kind).alias("kind"), "lcp", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row
        out = h if out is None else out.unionByName(h)
    return out


@query("SELECT vec_id, label FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 50")
def sampled_items(spark, d):
    return evaluation.sampled(_vec(spark, d).select("vec_id", "label"), "vec_id", 50, 7)


# ---- vectors


_U = """e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) x FROM embeddings), n0 AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) s FROM e),
d0 AS (SELECT vec_id, label, j, x[j] / s t, x[65 - j] / s i FROM n0, unnest(range(1, 65)) u(j))"""


@query(f"WITH {_U} SELECT vec_id, CAST(j - 1 AS INT) j, round(t, 6) v FROM d0")
def unit_vectors_whole(spark, d):
    return _vec(spark, d).select("vec_id", F.posexplode(vectors.l2(F.col("x"))).alias("j", "v")).select("vec_id", "j", F.round("v", 6).alias("v"))


_CAT = f"""{_U}, cs AS (SELECT label, j, sum((t + i) / 2) / count(*) m FROM d0 GROUP BY ALL), al AS (SELECT j, sum((t + i) / 2) / count(*) m FROM d0 GROUP BY j),
cn AS (SELECT label, count(*) n FROM embeddings GROUP BY label), voc AS (SELECT CAST(unnest(range(0, (SELECT max(label) + 1 + {UNSEEN} FROM embeddings))) AS INT) category),
raw AS (SELECT category, coalesce(n, 0) n, al.j, coalesce(cs.m, al.m) m FROM voc CROSS JOIN al LEFT JOIN cn ON cn.label = category LEFT JOIN cs ON cs.label = category AND cs.j = al.j),
tab AS (SELECT category, n, j, m / sqrt(sum(m * m) OVER (PARTITION BY category)) v FROM raw)"""


def _table(spark, d):
    v = _vec(spark, d).withColumn("base", vectors.middle(F.col("x"), F.reverse("x")))
    most = v.agg(F.max("label")).first()[0]
    return cut(evaluation.category_table(v, "label", "base", most + 1 + UNSEEN, DIM))


@query(f"WITH {_CAT} SELECT category, CAST(n AS BIGINT) n, CAST(j - 1 AS INT) j, round(v, 6) v FROM tab WHERE j <= {DIM}")
def category_table(spark, d):
    return _table(spark, d).select("category", "n", F.posexplode("vector").alias("j", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {_CAT}, s AS (SELECT DISTINCT category, n FROM tab) SELECT count(*) vocab_size, count(*) FILTER (n > 0) seen, count(*) FILTER (n = 0) unseen, CAST(min(n) FILTER (n > 0) AS BIGINT) min_count_seen, CAST(max(n) AS BIGINT) max_count FROM s")
def category_stats(spark, d):
    return evaluation.category_stats(_table(spark, d))


@query(f"WITH {_CAT} SELECT vec_id, CAST(j - 1 AS INT) j, round(t * {WEIGHTS[0]}, 6) v FROM d0 UNION ALL SELECT vec_id, CAST(j + 63 AS INT), round(i * {WEIGHTS[1]}, 6) FROM d0 UNION ALL SELECT vec_id, CAST(tab.j + 127 AS INT), round(v * {WEIGHTS[2]}, 6) FROM embeddings JOIN tab ON category = label WHERE tab.j <= {DIM}")
def fused_with_category(spark, d):
    """Title, image and category parts, each with its weight, whole."""
    rows = evaluation.gather(_vec(spark, d), _table(spark, d), "label", "cat")
    fused = F.concat(vectors.weighted(F.col("x"), WEIGHTS[0]), vectors.weighted(F.reverse("x"), WEIGHTS[1]), F.transform("cat", lambda v: v * WEIGHTS[2]))
    return rows.select("vec_id", F.posexplode(fused).alias("j", "v")).withColumn("v", F.round("v", 6))


@query("""WITH dd AS (SELECT vec_id, j, CAST(embedding[j] AS DOUBLE) x FROM embeddings, unnest(range(1, 65)) u(j)), mean AS (SELECT j, avg(x) m FROM dd GROUP BY j)
SELECT a.vec_id AS key, CAST(b.vec_id AS INT) j, round(sum((a.x - m) * b.x), 6) v FROM dd a JOIN mean USING (j) JOIN dd b USING (j) WHERE b.vec_id < 4 GROUP BY ALL""")
def projected_vectors(spark, d):
    """Centred vectors on four fixed components."""
    v = _vec(spark, d)
    mean = np.array([r.m for r in v.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).orderBy("j").collect()])
    components = np.array([r.x for r in v.where("vec_id < 4").orderBy("vec_id").collect()])
    return evaluation.project(v, "vec_id", "x", mean, components).select("key", F.posexplode("vector").alias("j", "v")).withColumn("v", F.round("v", 6))


# ---- sequences


@query(f"WITH {_E} SELECT user_idx, array_to_string(items[greatest(len(items) - 5, 1):len(items) - 1], ' ') history, array_to_string(list_concat(list_transform(range(0, greatest(9 - len(items), 0)), lambda z: 0), list_transform(items[greatest(len(items) - 8, 1):len(items) - 1], lambda x: x + 1)), ' ') padded FROM seq WHERE len(items) >= 3")
def history_tails(spark, d):
    """The last five items before the target, and the last eight as ids from 1 with fillers before them."""
    t = dataset.leave_one_out(_seq(spark, d), "user_idx")[2]
    return t.select("user_idx", F.array_join(vectors.tail(F.col("history"), 5).cast("array<string>"), " ").alias("history"), F.array_join(vectors.padded(F.transform("history", lambda x: x.cast("long") + 1), 8, 0).cast("array<string>"), " ").alias("padded"))


@query(f"WITH {_E}, {_POP}, top AS (SELECT list(item_idx ORDER BY n DESC, item_idx)[1:10] preds FROM (SELECT * FROM pop ORDER BY n DESC, item_idx LIMIT 10)) SELECT CAST(user_idx AS INT) eval_idx, items[len(items)] target, CAST(coalesce(list_position(preds, items[len(items)]), 0) AS BIGINT) AS rank, array_to_string(preds, ' ') preds FROM seq, top WHERE len(items) >= 3 AND user_idx < 20")
def prediction_head(spark, d):
    """Target, its rank among the predictions (0: not there) and the predictions of the first twenty users."""
    seq = cut(_seq(spark, d))
    top = dataset.popularity(seq, _item_ids(spark, d), "item_idx").orderBy(F.desc("n"), "item_idx").limit(10)
    preds = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "item_idx"))), lambda x: x["item_idx"]).alias("preds"))
    t = readers.head(dataset.leave_one_out(seq, "user_idx")[2], "user_idx", 20).crossJoin(F.broadcast(preds))  # one row
    return t.select(F.col("user_idx").alias("eval_idx"), "target", F.array_position("preds", F.col("target")).cast("long").alias("rank"), _J("preds").alias("preds"))


_PATH = f"path AS (SELECT item_idx, k1, k2 + {K1} k2 FROM items JOIN sid ON vec_id = item_idx % {_N}), big AS (SELECT max(greatest(k1, k2)) + 1 sep FROM path)"


def _paths(spark, d, items):
    """(item, tokens): items with the offset codes of vectors, dealt in turn."""
    c = _codes(spark, d)
    n = c.count()
    return items.select(F.col("item_idx").alias("item"), (F.col("item_idx") % n).alias("vec_id")).join(c, "vec_id").select("item", vectors.offset_codes(F.col("codes"), [K1, K2]).alias("codes"))


@query(f"WITH {_E}, {_V}, {_PATH} SELECT CAST(item_idx AS INT) item, k1 || ' ' || k2 tokens, CAST(sep AS INT) part, CAST(sep + 1 AS INT) AS begin, CAST(sep + 2 AS INT) vocabulary FROM path, big")
def sid_tokens(spark, d):
    tokens, part, begin, vocabulary = readers.tokens(cut(_paths(spark, d, _item_ids(spark, d))), "item")
    return tokens.select(F.col("item").cast("int").alias("item"), _J("tokens").alias("tokens"), F.lit(part).alias("part"), F.lit(begin).alias("begin"), F.lit(vocabulary).alias("vocabulary"))


@query(f"""WITH {_E}, {_V}, {_PATH}, o AS (SELECT user_idx, p, k1, k2 FROM (SELECT user_idx, unnest(items[1:len(items) - 2]) item_idx, unnest(range(1, len(items) - 1)) p FROM seq WHERE len(items) >= 3) JOIN path USING (item_idx))
SELECT CAST(user_idx AS INT) user_idx, CAST(max(sep) + 1 AS VARCHAR) || ' ' || string_agg(k1 || ' ' || k2 || ' ' || sep, ' ' ORDER BY p) tokens FROM o, big GROUP BY user_idx""")
def sid_token_streams(spark, d):
    seq = cut(_seq(spark, d)).where(F.size("items") >= 3)
    tokens, part, begin, _ = readers.tokens(cut(_paths(spark, d, _item_ids(spark, d))), "item")
    return sequence_lm.code_streams(seq, "user_idx", tokens, begin, part).select("user_idx", _J("tokens").alias("tokens"))


@query()
def sid_decode(spark, d):
    """The ten best items of every user by beam search along code paths; held against brute force in the tests."""
    seq = cut(_seq(spark, d))
    items = cut(dataset.popularity(seq, _item_ids(spark, d), "item_idx"))
    paths, part, begin, vocabulary = readers.tokens(cut(_paths(spark, d, items)), "item")
    model = sequence_lm.Model.of(sequence_lm.ngram_counts(sequence_lm.code_streams(seq.where(F.size("items") >= 3), "user_idx", paths, begin, part), 3))
    popular, where = sequence_lm.most_popular(items, "item_idx"), sequence_lm.path_arrays(paths, "item", "tokens")
    test = dataset.leave_one_out(seq, "user_idx")[2]
    return sequence_lm.beam_decode(test, "user_idx", model, None, where, popular, 3, 0.001, vocabulary, begin, part, 32, 10, max_history=20).select("user_idx", _J("preds").alias("preds"))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 9) mean FROM lineitem WHERE isfinite(CAST(l_discount AS DOUBLE))")
def weighted_loss(spark, d):
    """The mean of batches' losses by their tokens."""
    rows = _t(spark, d, "lineitem").where(evaluation.finite(F.col("l_discount").cast("double")))
    return evaluation.weighted_mean(rows, F.col("l_discount"), F.col("l_quantity")).select(F.round("mean", 9).alias("mean"))
