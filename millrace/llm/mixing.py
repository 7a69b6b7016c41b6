"""Mixing sources to target weights by Pfair scheduling: blocks get release times and deadlines from their source's weight, and earliest-deadline-first interleaves them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Up to so many sources the schedule is a plan of periods; with more, every source is scheduled block by block.
MAX_SOURCES = 256
POOL = "\x00other"


def pfair_period(weights: list[int]) -> list[int]:
    """slots[t]: the source that runs in slot t of one period of sum(weights) slots.

    Block j (from 1) of a source of weight w/W is released at floor((j-1) W / w) and due at ceil(j W / w). Earliest-deadline-first (ties: the lower source number) is optimal for these windows on one track, so every block meets its window, and in every prefix of t slots a source has run t w / W blocks give or take less than one.
    """
    total = sum(weights)
    released = [(0, i, 1) for i in range(len(weights))]
    heapq.heapify(released)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(total):
        while released and released[0][0] <= t:
            _, i, j = heapq.heappop(released)
            heapq.heappush(ready, (-(-j * total // weights[i]), i, j))
        due, i, j = heapq.heappop(ready)
        if due < t + 1:
            raise AssertionError("a block missed its deadline")
        out.append(i)
        if j < weights[i]:
            heapq.heappush(released, (j * total // weights[i], i, j + 1))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Segments of the whole schedule. A segment ends when its first source has run all of its blocks; the sources left go on by their own weights, so every block runs once.

    The plan's size doesn't depend on the number of blocks: within a segment the slots repeat every sum(weights), so a source's block is at `base + (k div w) * total + slots[k mod w]`, k counted from the segment's first block.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    out, base = [], 0
    while left:
        names = list(left)
        w = [weights[s] for s in names]
        total = sum(w)
        slots: list[list[int]] = [[] for _ in names]
        for t, i in enumerate(pfair_period(w)):
            slots[i].append(t)
        length = min((left[s] - 1) // w[i] * total + slots[i][(left[s] - 1) % w[i]] + 1 for i, s in enumerate(names))
        for i, s in enumerate(names):
            ran = length // total * w[i] + sum(t < length % total for t in slots[i])
            if ran:
                out.append({"__s": s, "first": done[s], "last": done[s] + ran - 1, "base": base, "w": w[i], "total": total, "slots": slots[i]})
            done[s] += ran
            left[s] -= ran
        left = {s: n for s, n in left.items() if n}
        base += length
    return out


def block_schedule(blocks: np.ndarray, weights: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source number, block) of each slot, `step` slots at a time, for any number of sources.

    In the ideal share-out, source i has min(blocks[i], weights[i] * v) blocks when the shared clock is at v, and slot t is where these sum to t, so a source that runs out leaves its share to the others by their weights. A block is released in the slot where its ideal share begins and due at the end of the slot where it ends. The ideal fits all of these windows, so earliest-deadline-first meets each of them, and after every slot a source has run its ideal number of blocks give or take less than one.
    """
    n, w = blocks.astype(np.float64), weights.astype(np.float64)
    order = np.argsort(n / w, kind="stable")
    clock = np.concatenate([[0.0], (n / w)[order]])
    slots = np.concatenate([[0.0], np.cumsum(np.diff(clock) * np.cumsum(w[order][::-1])[::-1])])
    total, made, ready = int(blocks.sum()), np.zeros(len(n), np.int64), []
    for a in range(0, total, step):
        b = min(a + step, total)
        upto = np.minimum(blocks, np.floor(w * np.interp(b, slots, clock)).astype(np.int64) + 1) if b < total else blocks
        new = np.maximum(upto - made, 0)
        i = np.repeat(np.arange(len(n)), new)
        j = np.arange(len(i)) - np.repeat(np.cumsum(new) - new, new) + made[i]
        made += new
        release = np.floor(np.interp(j / w[i], clock, slots) + 1e-6).astype(np.int64)
        due = np.ceil(np.interp((j + 1) / w[i], clock, slots) - 1e-6).astype(np.int64)
        by = np.argsort(release, kind="stable")
        waiting, at = list(zip(release[by].tolist(), due[by].tolist(), i[by].tolist(), j[by].tolist())), 0
        out = np.empty((2, b - a), np.int64)
        for t in range(a, b):
            while at < len(waiting) and (waiting[at][0] <= t or not ready):
                heapq.heappush(ready, waiting[at][1:])
                at += 1
            _, out[0, t - a], out[1, t - a] = heapq.heappop(ready)
        for x in waiting[at:]:
            heapq.heappush(ready, x[1:])
        yield out[0], out[1]


def tempered_weights(sizes: dict[str, int], alpha: float) -> dict[str, int]:
    """Whole-number target weights (about 1,000 in all, or 1,000 a source beyond MAX_SOURCES) in proportion to size ** alpha."""
    powers = {s: max(1, n) ** alpha for s, n in sizes.items()}
    total = sum(powers.values()) or 1
    scale = 1000 if len(sizes) <= MAX_SOURCES else 1000 * len(sizes)
    return {s: max(1, round(scale * p / total)) for s, p in powers.items()}


def by_period(blocks: DataFrame, ends: dict[str, int], goal: dict[str, int]) -> DataFrame:
    """blocks with target_weight and slot, by schedule()."""
    shares = common.inline_table(blocks.sparkSession, schedule(ends, goal), "__s: string, first: bigint, last: bigint, base: bigint, w: bigint, total: bigint, slots: array<bigint>").withColumnRenamed("__s", "__ps")
    k = F.col("block") - F.col("first")
    timed = blocks.join(F.broadcast(shares), (F.col("__s") == F.col("__ps")) & F.col("block").between(F.col("first"), F.col("last")))
    return timed.select("__s", "block", "__rows", "__first", F.col("w").alias("target_weight"), (F.col("base") + F.expr("(block - first) div w") * F.col("total") + F.get("slots", (k % F.col("w")).cast("int"))).alias("slot"))


def by_block(blocks: DataFrame, ends: dict[str, int], goal: dict[str, int]) -> DataFrame:
    """blocks with target_weight and slot, by block_schedule()."""
    spark, names = blocks.sparkSession, sorted(ends)
    path, at = common.new_path(spark, "slots"), 0
    weights = np.array([goal[s] for s in names], np.int64)
    for i, j in block_schedule(np.array([ends[s] for s in names], np.int64), weights):
        spark.createDataFrame(pa.table({"__i": i, "__pb": j, "slot": np.arange(at, at + len(i))})).write.mode("append").parquet(path)
        at += len(i)
    sources = spark.createDataFrame(pa.table({"__k": np.arange(len(names)), "__ps": names, "target_weight": weights}))
    slots = spark.read.parquet(path).join(sources, F.col("__i") == F.col("__k"))
    timed = blocks.join(slots, (F.col("__s") == F.col("__ps")) & (F.col("block") == F.col("__pb")))
    return timed.select("__s", "block", "__rows", "__first", "target_weight", "slot")


def mix(rows: DataFrame, identity: list[str], weights: dict[str, int] | None = None, alpha: float = 0.5, block_bytes: int = 65_536, seed: int = 7) -> DataFrame:
    """Adds block, slot, target_weight and position (gapless from 0): the order in which the sources' rows follow each other.

    rows has `source`, `bytes` (positive) and the identity columns, and is a written table. A source's rows stand in a seeded random order, cut into blocks of block_bytes; a row longer than a block leaves the block numbers that it covers empty, so shares hold in bytes. weights are whole numbers; None takes size ** alpha, each source by its own. The pool "\\x00other" takes the null source and, if weights are given, the sources that they don't name. Up to MAX_SOURCES sources the plan on the driver doesn't depend on the number of blocks. With more, the driver keeps names and counts of the sources and goes through the blocks once in order, a million at a time. Each row is placed once: none is dropped or repeated. An empty table gives no rows.
    """
    spark = rows.sparkSession
    if weights is None:
        pooled = rows.withColumn("__s", F.coalesce("source", F.lit(POOL)))
    else:
        named = pa.table({"__n": pa.array(sorted(set(weights) - {POOL}), pa.string())})
        pooled = rows.join(spark.createDataFrame(named), rows["source"] == F.col("__n"), "left").withColumn("__s", F.coalesce("__n", F.lit(POOL))).drop("__n")
    totals = pooled.groupBy("__s").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    if weights is None:
        weights = tempered_weights({r["__s"]: r["b"] for r in totals}, alpha)
    goal = {r["__s"]: max(1, int(weights.get(r["__s"], 1))) for r in totals}
    n = sum(r["n"] for r in totals)
    ties = [F.col(c) for c in identity]
    placed = common.running(pooled, ["__s"], ties, seed, n, "bytes", few=len(goal) <= MAX_SOURCES)
    placed = common.written(placed.withColumn("block", F.expr(f"before div {int(block_bytes)}")).drop("before"), "blocks")
    blocks = placed.groupBy("__s", "block").agg(F.count(F.lit(1)).alias("__rows"), F.min("rank").alias("__first"))
    ends = {r["__s"]: r["e"] + 1 for r in blocks.groupBy("__s").agg(F.max("block").alias("e")).collect()}
    timed = by_period(blocks, ends, goal) if len(ends) <= MAX_SOURCES else by_block(blocks, ends, goal)
    timed = timed.withColumn("__c", F.expr("slot div 4096"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    coarse = timed.groupBy("__c").agg(F.sum("__rows").alias("__cn"))
    coarse = coarse.select(F.col("__c").alias("__cc"), F.coalesce(F.sum("__cn").over(before(Window.orderBy("__c"))), F.lit(0)).alias("__cs"))  # a row for each 4,096 blocks
    timed = timed.withColumn("__in", F.coalesce(F.sum("__rows").over(before(Window.partitionBy("__c").orderBy("slot"))), F.lit(0)))
    timed = timed.join(coarse, F.col("__c") == F.col("__cc")).select(F.col("__s").alias("__bs"), F.col("block").alias("__bb"), "slot", "target_weight", (F.col("__cs") + F.col("__in") - F.col("__first")).alias("__at"))
    out = placed.join(timed, (F.col("__s") == F.col("__bs")) & (F.col("block") == F.col("__bb")))
    return out.withColumn("position", F.col("__at") + F.col("rank")).drop("__s", "__bs", "__bb", "__at", "rank")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source and bytes (UTF-8 bytes of the text, null as none, plus 1) of each document, with a CRC that tells rows of one id apart."""
    payload = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(payload) + 1).cast("long").alias("bytes"), F.crc32(payload).alias("crc")), "mixing")


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixing order of all documents: doc_id, source, bytes, target_weight, block, slot, position."""
    out = mix(narrow(common.table(spark, sf_dir, "documents")), ["doc_id", "crc", "bytes"])
    return out.select("doc_id", "source", "bytes", "target_weight", "block", "slot", "position")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, int] | None = None) -> DataFrame:
    """Pipeline stage: the documents in mixing order, written so (file by file, row by row); common.in_file_order reads that order again.

    Every row stays, with all its columns whatever their names. A null source is a source of its own, a null text counts one byte, rows with one id and one text follow each other from the first one's place, an empty table gives no rows.
    """
    order = mix(narrow(docs), ["doc_id", "crc", "bytes"], weights).groupBy(F.col("doc_id").alias("__id"), F.col("crc").alias("__crc")).agg(F.min("position").alias("__position"))
    keyed = docs.withColumn("__k", F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")))
    joined = keyed.join(order, keyed["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__crc")))
    return joined.orderBy("__position").select(*docs.columns)
