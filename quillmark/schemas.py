"""Schemas of the tables that pass between steps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

_TYPES: dict[str, DataType] = {
    "q_no": IntegerType(),
    "identification": LongType(),
    **dict.fromkeys(("points", "cosine_similarity", "x", "y"), DoubleType()),
}


def _schema(*names: str) -> StructType:
    """Text unless the name says otherwise."""
    return StructType([StructField(n, _TYPES.get(n, StringType())) for n in names])


# One answer slot: the reference point for joins, ranking and numbering.
SLOT = ["exam_id", "student_id", "q_no"]
ITEM_KEY = ["exam_id", "q_no"]

_PERSON = ["exam_id", "student_id", "first_name", "surname", "q_no"]

ITEM = _schema(*ITEM_KEY, "question", "sample_solution", "alternative_solution", "points")
ANSWER = _schema(*_PERSON, "student_solution")
EVAL = _schema(
    *_PERSON, "student_solution", "question", "points", "sample_solution", "alternative_solution"
)
SCORED = _schema(
    *_PERSON, "question", "student_solution", "points", "solution_type", "solution",
    "cosine_similarity", "identification",
)
GRADING = _schema(
    "identification", "question", "points", "solution", "student_solution", "grading"
)
TRAIN = _schema("x", "y")
DOC = _schema("path", "text")


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """Table of that schema with no rows, e.g. an exam before its first item."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order and type; fails on a missing one."""
    return df.selectExpr(*as_schema(schema))


def as_schema(schema: StructType) -> list[str]:
    return [f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in schema]
