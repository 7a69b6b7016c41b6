"""Sources and sinks: Parquet tables as views, text files line by line, catalog tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The driver's tables.
TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def views(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Registers folder/NAME.parquet as view NAME. Scans are lazy: filters and columns reach the files."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def load_data(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """LOAD DATA INFILE: a row for each line in the files' order, in one column; a line that ends in a backslash goes on in the next.

    Lines are read in splits. A line's place is (file, row within the written lines); the lines that one goes on over share the number of ends before them, counted within a file's part and shifted by those of the parts before.
    """
    text = spark.read.text(path)
    if not text.where(F.col("value").endswith("\\")).limit(1).count():
        return text.select(F.col("value").alias(column))
    at = F.monotonically_increasing_id()
    lines = text.select("value", F.input_file_name().alias("f"), at.alias("i"))
    folder = scratch(spark)
    lines.write.parquet(folder)
    lines = spark.read.parquet(folder).withColumn("p", F.shiftright("i", 33)).withColumn("end", (~F.col("value").endswith("\\")).cast("bigint"))
    before = Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    ends = lines.groupBy("f", "p").agg(F.sum("end").alias("n")).withColumn("o", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.coalesce(F.sum("end").over(Window.partitionBy("f", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("k", own).join(F.broadcast(ends), ["f", "p"]).withColumn("g", F.col("o") + F.col("k"))
    whole = numbered.groupBy("f", "g").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda e: F.when(e["value"].endswith("\\"), F.substring(e["value"], F.lit(1), F.length(e["value"]) - 1)).otherwise(e["value"])), "\n")
    return whole.orderBy("f", "g").select(joined.alias(column))


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, in spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{found.rstrip('/')}/tables-{uuid.uuid4().hex}"


def columns(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """information_schema.columns of views: table_name, column_name, ordinal_position, is_nullable, data_type."""
    rows = [(t, f.name, i, "YES" if f.nullable else "NO", f.dataType.simpleString()) for t in names for i, f in enumerate(spark.table(t).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables: the session's tables and views."""
    rows = [(t.name, "VIEW" if t.isTemporary else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string")


def schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "schema_name string")


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("parquet", "DEFAULT", "NO")], "engine string, support string, transactions string")
