"""How well codes use their codebooks, how prefixes part items, and collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_codes(codes: DataFrame, key: str, column: str = "codes") -> DataFrame:
    return codes.select(key, F.posexplode(column).alias("pos", "code"))


def usage(codes: DataFrame, key: str, sizes: DataFrame, column: str = "codes") -> DataFrame:
    """For each position (sizes: pos, clusters): used codes, entropy, effective codes, Gini over all codes, and count quantiles."""
    all_ = sizes.select("pos", "clusters", F.explode(F.sequence(F.lit(0), F.col("clusters") - 1)).alias("code"))
    n = long_codes(codes, key, column).groupBy("pos", "code").agg(F.count("*").alias("n"))
    n = all_.join(n, ["pos", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("pos")
    n = n.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy("n", "code")))
    p, some = F.col("n") / F.col("total"), F.when(F.col("n") > 0, F.col("n"))
    out = n.groupBy("pos", "clusters").agg(
        F.count(some).alias("used_codes"),
        F.sum(F.when(F.col("n") > 0, -p * F.log2(p))).alias("entropy"),
        (2 * F.sum(F.col("rank") * F.col("n")) / (F.max("clusters") * F.sum("n")) - (F.max("clusters") + 1) / F.max("clusters")).alias("gini"),
        F.min(some).alias("min_count"),
        F.percentile(some, F.lit(0.5)).cast("long").alias("p50_count"),
        F.percentile(some, F.lit(0.9)).cast("long").alias("p90_count"),
        F.percentile(some, F.lit(0.95)).cast("long").alias("p95_count"),
        F.percentile(some, F.lit(0.99)).cast("long").alias("p99_count"),
        F.max("n").alias("max_count"),
        (F.max("n") / F.max("total")).alias("max_share"),
    )
    return out.withColumn("utilization", F.col("used_codes") / F.col("clusters")).withColumn("entropy_ratio", F.col("entropy") / F.log2("clusters")).withColumn("effective_codes", F.pow(F.lit(2.0), "entropy"))


def prefixes(codes: DataFrame, column: str = "codes") -> DataFrame:
    """For each depth: distinct prefixes, rows over one a prefix, prefixes with several rows, and the largest."""
    each = codes.select(F.explode(F.sequence(F.lit(1), F.size(column))).alias("depth"), F.col(column).alias("c"))
    groups = each.groupBy("depth", F.slice("c", 1, F.col("depth")).alias("prefix")).agg(F.count("*").alias("n"))
    out = groups.groupBy("depth").agg(F.count("*").alias("unique_prefixes"), F.sum("n").alias("rows"), F.count(F.when(F.col("n") > 1, 1)).alias("collision_groups"), F.max("n").alias("max_group_size"))
    return out.select("depth", "unique_prefixes", (F.col("unique_prefixes") / F.col("rows")).alias("unique_ratio"), (F.col("rows") - F.col("unique_prefixes")).alias("extra_collisions"), ((F.col("rows") - F.col("unique_prefixes")) / F.col("rows")).alias("collision_rate_extra"), "collision_groups", "max_group_size")


def groups(codes: DataFrame, key: str, least: int = 1, column: str = "codes", head: int = 30) -> DataFrame:
    """Rows that share all codes: how many, and the first ``head`` keys (an aggregate of bounded size)."""
    ranked = codes.withColumn("r", F.row_number().over(Window.partitionBy(column).orderBy(key)))
    out = ranked.groupBy(column).agg(F.count("*").alias("group_size"), F.min(key).alias("first_key"), F.array_sort(F.collect_list(F.when(F.col("r") <= head, F.col(key)))).alias("keys_head"))
    return out.where(F.col("group_size") >= least)


def suffixes(codes: DataFrame, key: str, column: str = "codes") -> DataFrame:
    """Each row's place among those with its codes, and how many these are."""
    w = Window.partitionBy(column)
    return codes.withColumn("suffix", F.row_number().over(w.orderBy(key)) - 1).withColumn("group_size", F.count("*").over(w))


def trie_edges(codes: DataFrame, column: str = "codes") -> DataFrame:
    """Distinct (depth, prefix, token) of a prefix tree."""
    each = codes.select(F.explode(F.sequence(F.lit(1), F.size(column))).alias("depth"), F.col(column).alias("c"))
    return each.select("depth", F.slice("c", 1, F.col("depth") - 1).alias("prefix"), F.element_at("c", F.col("depth")).alias("token")).distinct()
