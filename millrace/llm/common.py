"""Shared pieces: the shared folder, written tables, driver-made tables and skew-proof running ranks."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder is made and set if all runs on one machine (master local); on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage so that a lost executor costs a reread and not a recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written() once no plan needs it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    paths = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of rows made on the driver, whose number the caller has bounded; it travels as one JSON literal."""
    text = json.dumps(rows, separators=(",", ":"))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        on = c if on is None else on & c
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def bucket_rows(spark: SparkSession, n: int) -> int:
    """Rows for one bucket of running(): several buckets for each shuffle partition, 1,000 to 50,000 rows each."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1_000, min(50_000, math.ceil(n / (4 * parts))))


#: Rows alike in every column are ranked as parts of at most so many.
ALIKE = 1_000


def packed(df: DataFrame) -> DataFrame:
    """df's distinct rows with their number as `__n`, cut into parts `__k` of at most ALIKE: however often a row is repeated (null ids with equal texts, say), it is spread like others."""
    alike = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__count"))
    parts = alike.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__count - 1) div {ALIKE}"))))
    return parts.withColumn("__n", F.least(F.lit(ALIKE), F.col("__count") - F.col("__k") * ALIKE)).drop("__count")


def running(df: DataFrame, keys: list[str], ties: list[Column], seed: int, n: int, value: str | None = None, by: str | None = None, span: int = 1, few: bool = True) -> DataFrame:
    """Adds `rank` (0-based, gapless within keys) and, if value is given, `before` (the sum of value over lower ranks), in the order of a seeded hash of ties, or of the column `by` (whole numbers from 0 to span - 1, cut into equal ranges as buckets) and ties.

    No group is gathered in one task: a key's rows are dealt to buckets of about bucket_rows() rows by their hash, ranked there, and shifted by the bucket's offset, so a key with a third of all rows is spread as any other, and so are rows that are alike in every column (see packed()). The counts of keys are broadcast, so the caller bounds their number (shards, piece lengths) or says few=False; the buckets' table is N / bucket_rows() rows and is joined on the same partitioning as the ranking window. df is read three times: pass a written table.
    """
    spark = df.sparkSession
    per = bucket_rows(spark, n)
    rows = packed(df)
    hashed = rows.withColumn("__h", F.col(by).cast("long") if by else F.xxhash64(F.lit(seed), *ties, "__k"))
    counts = rows.groupBy(*keys).agg(F.ceil(F.sum("__n") / per).cast("int").alias("__nb"))
    dealt = null_safe(hashed, F.broadcast(counts) if few else counts, keys).withColumn("__b", (F.expr(f"__h * __nb div {int(span)}") if by else F.pmod(F.col("__h"), F.col("__nb"))).cast("int")).drop("__nb")
    total = F.sum(F.col(value) * F.col("__n")) if value else None
    sums = [F.sum("__n").alias("__m")] + ([total.alias("__v")] if value else [])
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "__b").agg(*sums)
    offsets = offsets.select(*keys, "__b", F.coalesce(F.sum("__m").over(w), F.lit(0)).alias("__on"), *([F.coalesce(F.sum("__v").over(w), F.lit(0)).alias("__ov")] if value else []))
    inner = Window.partitionBy(*keys, "__b").orderBy("__h", *ties, "__k").rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe(dealt, offsets, [*keys, "__b"])
    out = joined.withColumn("__r", F.col("__on") + F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    if value:
        out = out.withColumn("__s0", F.col("__ov") + F.coalesce(total.over(inner), F.lit(0)))
    each = out.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    return each.select(*df.columns, (F.col("__r") + F.col("__i")).alias("rank"), *([(F.col("__s0") + F.col("__i") * F.col(value)).alias("before")] if value else []))


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds `position` (gapless from 0) by the order in which df's Parquet files were written, part by part and row by row; it doesn't depend on how a reader splits or orders the files. What isn't a file's rows is written first.

    Only a row for each file is gathered.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = written(df, "ordered")
    rows = df.select(*df.columns, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"))
    part = F.regexp_extract("__f", r"part-(\d+)[^/]*$", 1)
    before = Window.orderBy(F.when(part != "", part).cast("long"), "__f").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("__f").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__f").alias("__g"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return rows.join(F.broadcast(files), F.col("__f") == F.col("__g")).withColumn("position", F.col("__o") + F.col("__i")).drop("__f", "__g", "__i", "__o")


def first_ids(df: DataFrame, key: str, id_: str, k: int) -> DataFrame:
    """(key, members): the k smallest ids of each key, exactly; a hot key's rows are first cut to k in each of 64 salted parts, so no task holds them all."""
    salted = df.select(key, id_, F.pmod(F.xxhash64(id_), F.lit(64)).alias("__s"))
    w = Window.partitionBy(key, "__s").orderBy(id_)
    part = salted.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return part.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(id_)), 1, k).alias("members"))
