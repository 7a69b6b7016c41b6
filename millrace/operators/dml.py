"""INSERT, UPDATE, DELETE, REPLACE, upserts and ALTER TABLE.

The functions take DataFrames and return the changed one. VersionedTable keeps each state in a folder of its own and moves a pointer, so a statement is seen whole or not at all; the driver is the only writer and there is no isolation between statements.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class ConstraintError(ValueError):
    """A key or NOT NULL violation."""


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def insert(table: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Appends rows; columns that aren't named get null."""
    if columns:
        rows = rows.toDF(*columns)
        rows = rows.select(*[(F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    else:
        rows = rows.toDF(*table.columns).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])
    return table.unionByName(rows)


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out


def first_of_key(rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """One row of each key, the first (or last) in the frame's order."""
    at = rows.withColumn("__at", F.monotonically_increasing_id())
    w = Window.partitionBy(*keys).orderBy(F.desc("__at") if last else F.asc("__at"))
    return at.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__at")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends the rows whose key is new; of several new rows with one key the first."""
    new = first_of_key(rows, keys).alias("n").join(table.alias("t"), _same(keys, "n", "t"), "left_anti")
    return table.unionByName(new)


def replace(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """REPLACE INTO: rows of the same key go, the last row of each new key stays."""
    new = first_of_key(rows, keys, last=True)
    return table.alias("t").join(new.alias("n"), _same(keys, "t", "n"), "left_anti").unionByName(new)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """INSERT .. ON DUPLICATE KEY UPDATE: in changes, t.x is the existing row's value and n.x the new row's. One full join on the key; new rows have one a key."""
    both = table.withColumn("__t", F.lit(1)).alias("t").join(rows.withColumn("__n", F.lit(1)).alias("n"), _same(keys, "t", "n"), "full")
    hit, new = F.col("__t").isNotNull() & F.col("__n").isNotNull(), F.col("__t").isNull()
    return both.select(*[F.when(new, F.col(f"n.{c}")).when(hit, changes.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def update(table: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Every right side sees the old row; rows where the condition is null stay."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[(F.when(hit, _col(changes[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c)) for c in table.columns])


def _chosen(table: DataFrame, where: Column | None, order: list[Column], limit: int) -> DataFrame:
    """table with __hit on the first `limit` rows that meet the condition."""
    at = table.withColumn("__id", F.monotonically_increasing_id())
    picked = (at.where(where) if where is not None else at).orderBy(*order, "__id").limit(limit).select(F.col("__id").alias("__p"))
    return at.join(picked, F.col("__id") == F.col("__p"), "left").withColumn("__hit", F.col("__p").isNotNull()).drop("__id", "__p")


def update_limited(table: DataFrame, changes: dict[str, Column], where: Column | None, order: list[Column], limit: int) -> DataFrame:
    """UPDATE .. ORDER BY .. LIMIT; give an order that is total for a repeatable result."""
    hit = _chosen(table, where, order, limit)
    return hit.select(*[(F.when(F.col("__hit"), _col(changes[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c)) for c in table.columns])


def update_join(table: DataFrame, other: DataFrame, on: list[str], changes: dict[str, Column]) -> DataFrame:
    """UPDATE t JOIN o: rows with a partner change; o has one row a key."""
    both = table.alias("t").join(other.withColumn("__o", F.lit(1)).alias("o"), _same(on, "t", "o"), "left")
    return both.select(*[F.when(F.col("__o").isNotNull(), changes[c]).otherwise(F.col(f"t.{c}")).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(f"t.{c}").alias(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows where the condition is null stay; no condition truncates."""
    return table.where(~F.coalesce(where, F.lit(False))) if where is not None else table.limit(0)


def delete_limited(table: DataFrame, where: Column | None, order: list[Column], limit: int) -> DataFrame:
    return _chosen(table, where, order, limit).where(~F.col("__hit")).drop("__hit")


def delete_join(table: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Multi-table DELETE: rows with a partner go."""
    return table.alias("t").join(other.alias("o"), _same(on, "t", "o"), "left_anti")


# ALTER TABLE
def add_column(table: DataFrame, name: str, kind: str, default=None, after: str | None = None) -> DataFrame:
    out = table.withColumn(name, F.lit(default).cast(kind))
    if after is None:
        return out
    names = [c for c in table.columns]
    names.insert(names.index(after) + 1, name)
    return out.select(*names)


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)


def change_column(table: DataFrame, name: str, new: str, kind: str) -> DataFrame:
    return table.select(*[F.col(c).cast(kind).alias(new) if c == name else F.col(c) for c in table.columns])


def rename_column(table: DataFrame, name: str, new: str) -> DataFrame:
    return table.withColumnRenamed(name, new)


class VersionedTable:
    """A table whose states are Parquet folders v0, v1, .. beside a pointer file; constraints are kept in the pointer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] | None = None, not_null: list[str] | None = None, auto_increment: str | None = None, if_not_exists: bool = False, more: dict | None = None) -> VersionedTable:
        """more: `unique` and `indexes` (columns by name) and `defaults` (SQL text by column)."""
        t = cls(spark, path)
        if t.exists():
            if if_not_exists:
                return t
            raise ConstraintError(f"table {path} exists")
        t._commit(spark.createDataFrame([], schema), {"keys": keys or [], "not_null": not_null or [], "auto_increment": auto_increment, "next": 1, **(more or {})})
        return t

    def exists(self) -> bool:
        return self.fs.exists(self.fs_path(f"{self.path}/_current"))

    def _state(self) -> dict:
        stream = self.fs.open(self.fs_path(f"{self.path}/_current"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _commit(self, df: DataFrame, state: dict) -> None:
        version = f"v{time.time_ns()}"
        df.write.parquet(f"{self.path}/{version}")
        self._point({**state, "version": version})

    def _point(self, state: dict) -> None:
        fresh = self.fs_path(f"{self.path}/_next")
        out = self.fs.create(fresh, True)
        out.writeUTF(json.dumps(state))
        out.close()
        # an overwriting rename: a reader sees the old pointer or the new one
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fresh, self.fs_path(f"{self.path}/_current"), options)

    def move(self, path: str) -> None:
        """Renames the table's folder."""
        if not self.fs.rename(self.fs_path(self.path), self.fs_path(path)):
            raise ConstraintError(f"can't rename {self.path} to {path}")
        self.path = path.rstrip("/")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._state()['version']}")

    def write(self, df: DataFrame, **changes) -> None:
        """Writes df as a new version, checks the constraints on what is written, and makes it the table's state."""
        state = {**self._state(), **changes}
        version = f"v{time.time_ns()}"
        df.write.parquet(f"{self.path}/{version}")
        df = self.spark.read.parquet(f"{self.path}/{version}")
        try:
            self._check(df, state)
        except ConstraintError:
            self.fs.delete(self.fs_path(f"{self.path}/{version}"), True)
            raise
        self._point({**state, "version": version})

    def _check(self, df: DataFrame, state: dict) -> None:
        for c in {*state["not_null"], *state["keys"]}:
            if c in df.columns and df.where(F.col(c).isNull()).limit(1).count():
                raise ConstraintError(f"column {c} can't be null")
        if state["keys"] and df.groupBy(*state["keys"]).count().where("count > 1").limit(1).count():
            raise ConstraintError(f"duplicate entry for key {state['keys']}")
        for name, keys in state.get("unique", {}).items():  # rows with a null in the key don't conflict
            if df.dropna(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ConstraintError(f"duplicate entry for key {name}")

    def _all_keys(self) -> list[list[str]]:
        state = self._state()
        return ([state["keys"]] if state["keys"] else []) + list(state.get("unique", {}).values())

    def insert(self, rows: DataFrame, columns: list[str] | None = None) -> None:
        """Null or 0 in the auto-increment column, or its absence, takes the next numbers."""
        state, table = self._state(), self.read()
        new = insert(table.limit(0), rows, columns)
        if a := state["auto_increment"]:
            # numbers go by partition and place, so no task sees all rows: the id's upper bits are the partition
            new = new.withColumn("__at", F.monotonically_increasing_id()).withColumn("__auto", F.coalesce(F.col(a), F.lit(0)) == 0)
            path = f"{self.path}/_rows-{time.time_ns()}"
            new.write.parquet(path)
            new = self.spark.read.parquet(path)
            part = F.shiftright("__at", 33)
            before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
            sizes = new.where("__auto").groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c")).withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0)))
            within = F.row_number().over(Window.partitionBy(part).orderBy("__at"))
            made = new.where("__auto").withColumn("__k", within).join(F.broadcast(sizes), part == F.col("__p")).withColumn(a, (F.col("__o") + F.col("__k") + state["next"] - 1).cast(table.schema[a].dataType))
            new = new.where("NOT __auto").unionByName(made.select(*new.columns)).drop("__at", "__auto")
            top = new.agg(F.max(a)).first()[0]
            state["next"] = max(state["next"], int(top or 0) + 1)
        self.write(table.unionByName(new), next=state["next"])

    def insert_ignore(self, rows: DataFrame) -> None:
        """Rows that conflict with a row or an earlier new row by any key are left out."""
        table = self.read()
        for keys in self._all_keys():
            null = ~F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
            fresh = first_of_key(rows.where(~null), keys)
            rows = fresh.alias("n").join(table.alias("t"), _same(keys, "n", "t"), "left_anti").unionByName(rows.where(null))
        self.write(table.unionByName(rows))

    def replace(self, rows: DataFrame) -> None:
        """Rows that conflict with a new row by any key go; of new rows that conflict the last stays."""
        table = self.read()
        for keys in self._all_keys():
            null = ~F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
            rows = first_of_key(rows.where(~null), keys, last=True).unionByName(rows.where(null))
        for keys in self._all_keys():
            table = table.alias("t").join(rows.alias("n"), _same(keys, "t", "n"), "left_anti")
        self.write(table.unionByName(rows))

    def upsert(self, rows: DataFrame, changes: dict[str, Column]) -> None:
        """A new row that conflicts by the primary key, or else by a unique key, changes that row; the others are added."""
        table = self.read()
        every = self._all_keys()
        for keys in every[:-1]:
            hit = rows.alias("n").join(self.read().alias("t"), _same(keys, "n", "t"), "left_semi")
            table = upsert(table, hit, keys, changes)
            rows = rows.alias("n").join(self.read().alias("t"), _same(keys, "n", "t"), "left_anti")
        self.write(upsert(table, rows, every[-1], changes) if every else table.unionByName(rows))

    def update(self, changes: dict[str, Column], where: Column | None = None) -> None:
        self.write(update(self.read(), changes, where))

    def delete(self, where: Column | None = None) -> None:
        self.write(delete(self.read(), where))

    def alter(self, change, **state) -> None:
        """change: DataFrame -> DataFrame."""
        self.write(change(self.read()), **state)

    def drop(self) -> None:
        self.fs.delete(self.fs_path(self.path), True)
