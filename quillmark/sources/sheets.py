"""Score sheets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY_COLUMNS = [
    "surname", "first_name", "student_id", "question", "points", "solution", "student_solution",
    "points_for_student_answer",
]
GENERATIVE_COLUMNS = [*SIMILARITY_COLUMNS, "feedback"]


def sort_sheet(df: DataFrame) -> DataFrame:
    """By surname, first name and identification; missing names last."""
    names = ("surname", "first_name", "identification")
    return df.orderBy(*[F.col(n).asc_nulls_last() for n in names])


def similarity_sheet(graded: DataFrame) -> DataFrame:
    feedback = ["feedback"] if "feedback" in graded.columns else []
    return sort_sheet(graded).select(*SIMILARITY_COLUMNS, *feedback)


def generative_sheet(graded: DataFrame) -> DataFrame:
    return sort_sheet(graded).select(*GENERATIVE_COLUMNS)


def write_sheet(sheet: DataFrame, folder: str, kind: str, scheme: str, form: str = "csv") -> str:
    """Write as ``<kind>_grading_<scheme>``; returns the path."""
    path = f"{folder}/{kind}_grading_{scheme}"
    options = {"header": "true", "escape": '"', "quoteAll": "true"} if form == "csv" else {}
    sheet.write.options(**options).format(form).save(path)
    return path


def read_sheet(spark, path: str, schema) -> DataFrame:
    """A csv sheet, line breaks inside answers included."""
    return (
        spark.read.schema(schema)
        .options(header="true", escape='"', multiLine="true", nullValue="\u0000")
        .csv(path)
    )
