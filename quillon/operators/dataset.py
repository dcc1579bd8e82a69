"""Interactions to items, users, chronological sequences and leave-one-out samples."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut


def earliest(events: DataFrame, user: str, item: str, time: str, row_ord: Column) -> DataFrame:
    """One row for each user and item: the earliest, of equal times the one read first."""
    best = F.min_by(F.struct(*events.columns), F.struct(F.col(time), row_ord))
    return events.groupBy(user, item).agg(best.alias("r")).select("r.*")


def active_users(events: DataFrame, user: str, least: int) -> DataFrame:
    """Rows of users with ``least`` rows or more; counts are added up before they are dealt, so a user of many rows is no single task's."""
    kept = events.groupBy(user).count().where(F.col("count") >= least).select(user)
    return events.join(kept, user, "left_semi")


def dense_ids(keys: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Ids from 0 in the given order, whose values should differ (equal ones get ids in no stated order).

    Rows are dealt by ranges, sorted and checkpointed, so that places are fixed; an id is the place in the range and the rows of the ranges before.
    """
    placed = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    before = [0, *accumulate(r["n"] for r in sizes)]
    starts = keys.sparkSession.createDataFrame([(r["__part"], n) for r, n in zip(sizes, before)], "__part long, __start long")
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(name, (F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).cast("int" if before[-1] < 1 << 31 else "long")).select(*keys.columns, name)


def sequences(events: DataFrame, user: str, time: str, item: str, rating: str, tie: str) -> DataFrame:
    """A user's items, ratings and times in order of time, then of ``tie``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(tie).alias("k"), F.col(item).alias("i"), F.col(rating).alias("r"))))
    out = events.groupBy(user).agg(rows.alias("s"))
    return out.select(user, F.transform("s", lambda x: x["i"]).alias("items"), F.transform("s", lambda x: x["r"]).alias("ratings"), F.transform("s", lambda x: x["t"]).alias("times"))


def leave_one_out(seq: DataFrame, user: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train (every prefix before the last two), valid and test samples of users with three items or more."""
    n, seq = F.size("items"), seq.where(F.size("items") >= 3)
    train = seq.where(n >= 4).select(user, "items", F.explode(F.sequence(F.lit(2), n - 2)).alias("p")).select(user, F.slice("items", 1, F.col("p") - 1).alias("history"), F.element_at("items", F.col("p")).alias("target"))
    valid = seq.select(user, F.slice("items", 1, n - 2).alias("history"), F.element_at("items", -2).alias("target"))
    test = seq.select(user, F.slice("items", 1, n - 1).alias("history"), F.element_at("items", -1).alias("target"))
    return train, valid, test


def popularity(seq: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Items by how often sequences have them before their last two places; items never seen follow."""
    seen = seq.select(F.explode(F.slice("items", 1, F.greatest(F.size("items") - 2, F.lit(0)))).alias(item)).groupBy(item).agg(F.count("*").alias("n"))
    return items.select(item).join(seen, item, "left").withColumn("n", F.coalesce("n", F.lit(0)))
