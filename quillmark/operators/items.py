"""The item table of an exam and what students handed in."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.fixed import DEFAULT_SCHEME, NOT_WHITE, SCHEMES
from quillmark.operators.joins import lookup
from quillmark.schemas import ITEM, conform


def append_items(items: DataFrame, more: DataFrame) -> DataFrame:
    """Item table with further rows; columns are matched by name."""
    return conform(items.unionByName(default_alternative(more), allowMissingColumns=True), ITEM)


def default_alternative(items: DataFrame) -> DataFrame:
    """An item without alternative solution has the empty one."""
    if "alternative_solution" not in items.columns:
        return items.withColumn("alternative_solution", F.lit(""))
    return items.withColumn("alternative_solution", F.coalesce("alternative_solution", F.lit("")))


def _filled(name: str) -> Column:
    return is_answered(F.col(name))


def validate_items(items: DataFrame) -> DataFrame:
    """Adds ``is_valid``: question, solution and points are given, and points are
    not negative and have at most two decimals."""
    points = F.col("points")
    hundredths = F.abs(points * 100 - F.round(points * 100)) < 1e-6
    return items.withColumn(
        "is_valid",
        _filled("question")
        & _filled("sample_solution")
        & F.coalesce((points >= 0) & hundredths, F.lit(False)),
    )


def number_items(items: DataFrame, order_by: str) -> DataFrame:
    """Questions of each exam numbered from 1 in the order of ``order_by``."""
    return items.withColumn(
        "q_no", F.row_number().over(Window.partitionBy("exam_id").orderBy(order_by))
    )


def cast_text(df: DataFrame, *names: str) -> DataFrame:
    """Those columns as text without null: a missing answer is an empty answer."""
    return df.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names})


def cast_points(df: DataFrame, *names: str) -> DataFrame:
    """Those columns as doubles; text that is no number becomes null."""
    return df.withColumns({n: F.col(n).cast("string").try_cast("double") for n in names})


def is_answered(answer: Column) -> Column:
    """Null, empty and white space alike are no answer."""
    return F.coalesce(answer.rlike(NOT_WHITE), F.lit(False))


def answered(df: DataFrame) -> DataFrame:
    return df.where(is_answered(F.col("student_solution")))


def unanswered(df: DataFrame) -> DataFrame:
    return df.where(~is_answered(F.col("student_solution")))


def distinct_questions(evaluation: DataFrame) -> DataFrame:
    return evaluation.select("question").distinct()


def solutions_by_question(evaluation: DataFrame) -> DataFrame:
    """Each different sample solution of each question, one per row, with the
    first place it was seen. Kept as rows: a question used in many exams never
    becomes one long array."""
    return evaluation.groupBy("question", "sample_solution").agg(
        F.min(F.struct("exam_id", "q_no")).alias("first_seen")
    ).select(
        "question",
        F.col("sample_solution").alias("solution"),
        F.col("first_seen.exam_id").alias("first_exam_id"),
        F.col("first_seen.q_no").alias("first_q_no"),
    )


def first_solutions(solutions: DataFrame) -> DataFrame:
    """First-seen solution of each question."""
    return solutions.groupBy("question").agg(
        F.min(F.struct("first_exam_id", "first_q_no", "solution")).alias("s")
    ).select("question", F.col("s.solution").alias("first_solution"))


def fill_blank_solution(scored: DataFrame, solutions: DataFrame) -> DataFrame:
    """A blank winning solution becomes the first sample solution of its question."""
    joined = lookup(scored, first_solutions(solutions), ["question"], "left")
    filled = F.coalesce(F.nullif("solution", F.lit("")), "first_solution", "solution")
    return joined.withColumn("solution", filled).select(*scored.columns)


def scheme_text(name: Column) -> Column:
    """Wording of a grading scheme; quarter points for an unknown name."""
    text = F.lit(SCHEMES[DEFAULT_SCHEME])
    for scheme, wording in SCHEMES.items():
        text = F.when(name == scheme, F.lit(wording)).otherwise(text)
    return text
