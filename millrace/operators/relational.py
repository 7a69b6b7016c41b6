"""DataFrame forms of operators that are clumsy as SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def semi_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """EXISTS, and IN with a subquery."""
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, value: str) -> DataFrame:
    """NOT IN with a subquery: a null among the values leaves no rows, an empty list leaves all."""
    state = F.broadcast(right.agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(value).isNull(), 1)).alias("__nulls")))  # one row
    kept = left.join(right.select(F.col(value).alias("__v")), F.col(column) == F.col("__v"), "left_anti").crossJoin(state)
    return kept.where((F.col("__n") == 0) | (F.col("__nulls") == 0) & F.col(column).isNotNull()).drop("__n", "__nulls")


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by place, with the first frame's names."""
    return reduce(DataFrame.union, frames)


def union(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def top_k(df: DataFrame, k: int, *order: Column, offset: int = 0) -> DataFrame:
    """ORDER BY .. LIMIT k OFFSET m: k + m rows from each partition at most reach the last task."""
    out = df.orderBy(*order)
    return out.offset(offset).limit(k) if offset else out.limit(k)


def top_k_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The k first rows of each group; Spark cuts each partition to k a group before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def point_get(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; Parquet's row-group statistics prune the scan."""
    return df.where(F.col(key) == value)


def range_scan(df: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    c = F.col(key)
    if low is not None:
        df = df.where(c > low if low_open else c >= low)
    if high is not None:
        df = df.where(c < high if high_open else c <= high)
    return df


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi join whose left side has keys that hold a large share of its rows: each key is dealt to `salts` parts, and the right side's rows are copied to them.

    The salt is a hash of the left row, so a recomputed task deals alike. Unmatched right rows can't be told within a part: "right" and "full" add them by an anti join on the key.
    """
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    inner = {"right": "inner", "right_outer": "inner", "full": "left", "full_outer": "left", "outer": "left"}.get(how, how)
    out = l.join(r, [key, "__salt"], inner).drop("__salt")
    if inner == how:
        return out
    alone = right.join(left.select(key).distinct(), key, "left_anti")
    return out.unionByName(alone, allowMissingColumns=True)
