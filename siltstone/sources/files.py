"""Reading and removing the folders a store is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.StructType(
    [
        T.StructField("key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType()),
        T.StructField("value_inline", T.BinaryType()), T.StructField("vlog_run", T.LongType()), T.StructField("vlog_fid", T.LongType()), T.StructField("vlog_off", T.LongType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("vlog_fid", T.LongType()), T.StructField("vlog_off", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType()), T.StructField("value", T.BinaryType()),
    ]
)


def read_folders(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of all folders in one scan; an empty table if there are none."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_numbered(spark: SparkSession, folder: str, numbers: list[int], schema: T.StructType, name: str) -> DataFrame:
    """The rows of the numbered folders under ``folder`` in one scan, with the number of each row's folder as ``name``."""
    rows = read_folders(spark, [f"{folder}/{n}" for n in numbers], schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]+)/[^/]+$", 1) if numbers else F.lit(None)
    return rows.select("*", number.cast("long").alias(name))
