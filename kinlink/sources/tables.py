"""Tab-separated and Parquet tables; results; decisions as JSON.

Tab-separated files are read and written without any quoting, all columns as strings, empty fields as null.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("inferSchema", False).csv(path)
    return df.select(*columns) if columns else df


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Fields are written as they are; null and empty are both an empty field."""
    df = df.coalesce(1) if one_file else df
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parts(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output was written to the end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resume(spark: SparkSession, path: str, make) -> DataFrame:
    """The stage's output, made by ``make()`` unless it is there."""
    if not is_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id) of the first column of a tab-separated file, or of all files of a folder, without headers
    and blank lines."""
    df = read_tsv(spark, path)
    ids = df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("entity_id"))
    return ids.filter("entity_id <> ''").distinct()


def write_ordered(df: DataFrame, path: str, order: str = "pos") -> None:
    """Tab-separated files whose rows, file by file, are in the order of the column ``order``, which isn't written."""
    write_tsv(df.repartitionByRange(order).sortWithinPartitions(order).drop(order), path)


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows in reading order without gathering them: counts per partition, then offsets."""
    marked = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))  # a row per partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("__before", before).select("__p", "__first", "__before")
    return marked.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__before") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__first", "__before")


def write_json(value: dict, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
