"""Stage tables: a step's result on the shared folder.

Later steps read the table, so they neither repeat the step nor depend on the
executors that ran it.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import new_path


def save(df: DataFrame, path: str, by: list[str] = (), append: bool = False) -> None:
    """Write a table, in folders ``by`` some columns if given.

    Rows of one folder then come from as many tasks as a shuffle has at most, so
    a folder with a third of all rows is still written by many.
    """
    if by:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.spark_partition_id(), F.lit(parts))
        df = df.repartition(*by, part)
    df.write.mode("append" if append else "errorifexists").partitionBy(*by).parquet(path)


def restore(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stage(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """The table, written once and read back."""
    path = new_path(df.sparkSession, name)
    save(df, path, by)
    return restore(df.sparkSession, path, df.schema)


def stage_by(df: DataFrame, name: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """The table, written in buckets by some columns and in their order.

    Tables staged by the same columns in the same number of buckets (a shuffle's
    partitions, if none is given) are joined, grouped and ranked by them without
    any shuffle of their rows, as often as that is done. The rows of a key
    lie in one bucket: meant for tables that hold a few rows to a key, as those
    that are scored, graded or entered do for a slot.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    # the shuffle deals rows out as the buckets do, so a bucket is one file
    rows = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by)
    rows.format("parquet").option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)

