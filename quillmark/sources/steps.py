"""Tables that grow step by step, one folder a step.

A step that runs again takes the place of what it had written. Only steps whose
write has ended are read, so nobody sees half a step.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from quillmark.schemas import empty


def whole_steps(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the steps that were written to their end, in order."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/step=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(re.search(r"step=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found)


def save_step(rows: DataFrame, folder: str, step: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/step={step}")


def restore_steps(spark: SparkSession, folder: str, schema, below: int | None = None) -> DataFrame:
    """Rows of all whole steps, or of those before one; none if there is no such step."""
    steps = [n for n in whole_steps(spark, folder) if below is None or n < below]
    if not steps:
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/step={n}" for n in steps])
