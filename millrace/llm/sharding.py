"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes, in DataFrame operations only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_PARTITIONS = 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One draw of how many of `draws` balls are good, taken without replacement; inversion from the mode outwards, so it takes about a standard deviation of steps."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    comb = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(comb(good, mode) + comb(bad, draws - mode) - comb(total, draws))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """matrix[p][k]: rows that partition p sends to shard k, distributed as under a uniform permutation of all rows; row sums are `rows`, column sums `sizes`."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in rows:
        rest, later, line = n, sum(left), []
        for k, capacity in enumerate(left):
            later -= capacity
            x = hypergeometric(rng, capacity, later, rest) if k < len(left) - 1 else rest
            line.append(x)
            rest -= x
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def shuffle_to_shards(df: DataFrame, identity: list[Column], shards: int = 16, seed: int = 20_240_601, rows_per_partition: int = 65_536) -> DataFrame:
    """Adds `shard` (0 to shards - 1; counts at most one apart) and `slot` (gapless from 0 in the shard): a seeded uniform shuffle of all rows.

    Rows are hashed by `identity` to P logical partitions, so a rerun after a lost executor deals the same rows the same way whatever the files' splits. Only the P counts reach the driver (P is at most 65,536), which draws the exact P x shards matrix; a rank inside the partition under a seeded order (the local permutation) then falls into one shard's interval (the exchange), and a second seeded order in the shard gives the slot. Rows that are alike in every column are dealt in parts of at most common.ALIKE, so many of them fill no partition. A local permutation keeps such a part together; the second order spreads it over the shard again. An empty table gives no rows. df is read several times: pass a written table.
    """
    spark = df.sparkSession
    n = df.count()
    parts = min(MAX_PARTITIONS, max(64, math.ceil(n / rows_per_partition)))
    placed = common.packed(df).withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), *identity, "__k"), F.lit(parts)).cast("int"))
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.sum("__n").alias("n")).collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shard_sizes(n, shards), seed)
    ends = [{"__q": p, "__ends": [sum(line[: k + 1]) for k in range(shards - 1)]} for p, line in enumerate(matrix)]
    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), *identity, "__k"), *identity, "__k").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__r", F.coalesce(F.sum("__n").over(local), F.lit(0))).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    ranked = ranked.withColumn("__r", F.col("__r") + F.col("__i")).select(*df.columns, "__p", "__r")
    plan = F.broadcast(common.inline_table(spark, ends, "__q: int, __ends: array<bigint>"))
    sent = ranked.join(plan, F.col("__p") == F.col("__q"))
    shard = sum(((F.col("__r") >= F.col("__ends")[k]).cast("int") for k in range(shards - 1)), F.lit(0))
    exchanged = common.written(sent.withColumn("shard", shard.cast("int")).drop("__p", "__q", "__r", "__ends"), "exchange")
    return common.running(exchanged, ["shard"], identity, seed + 2, n).withColumnRenamed("rank", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Writes the shuffled rows as path/shard=K/, in slot order in each file; a shard is written by several tasks, split by slot."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to shards 0 to 15 by law `rows`. A null text has size 1 and the CRC of no bytes; null or repeated ids are rows as any other."""
    docs = common.table(spark, sf_dir, "documents")
    payload = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(payload) + 1).cast("long").alias("size"), F.crc32(payload).alias("text_crc32")), "sharding")
    out = shuffle_to_shards(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
