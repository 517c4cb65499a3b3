"""Cutting the lineage of iterative operators, and rows that stand for many."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own; on a
    cluster the setting is required.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="graphcall-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/graphcall/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` for joins that shuffle both sides.

    Spark estimates a table by its columns' kinds and its file's size. Rows that are exploded, or whose texts are made from
    numbers, hold far more than that, and the broadcast that the estimate leads to takes them whole into the driver.
    """
    return rows.hint("merge")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as a shuffle has, for work that costs far more than reading: a small file is one task, however much is made of its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def each_copy(rows: DataFrame, count: str, number: str, *, start: Column | None = None, chunk: int = 100_000) -> DataFrame:
    """Every row as often as ``count`` says (a table that can be read twice), with its ``number``: from ``start`` (1) on.

    Counts over ``chunk`` are cut into chunks first, which are dealt out by themselves, so neither
    an array nor a task holds all copies of a row. Rows with a count of zero or null are left out.
    """
    start, n, places = start if start is not None else F.lit(1), F.col(count).cast("long"), F.sequence
    few = rows.where((n > 0) & (n <= chunk)).withColumn(number, F.explode(places(start.cast("long"), start.cast("long") + n - 1)))
    many = rows.where(n > chunk).withColumn("_chunk", F.explode(places(F.lit(0).cast("long"), F.floor((n - 1) / chunk))))
    low, high = F.col("_chunk") * chunk, F.least(n, (F.col("_chunk") + 1) * chunk)
    many = many.repartition(*rows.columns, "_chunk").withColumn(number, F.explode(places(start.cast("long") + low, start.cast("long") + high - 1)))
    return few.unionByName(many.drop("_chunk"))
