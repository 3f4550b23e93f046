"""Scored rows and teacher's gradings to points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.grades import round_up
from quillmark.operators.calibrate import (
    anchor_points, fit_quadratic, join_gradings, predict_relative, training_points, zero_unanswered,
)
from quillmark.sources.sheets import similarity_sheet


def fit_model(scored: DataFrame, grading: DataFrame, by: list[str] = ()) -> DataFrame:
    merged = join_gradings(grading, scored)
    return fit_quadratic(anchor_points(training_points(merged, by), by, scored), by)


def calibrate(
    scored: DataFrame, grading: DataFrame, by: list[str] = (), clip: bool = False
) -> DataFrame:
    """Scored rows with ``relative_points`` from the curve fitted to the gradings."""
    return predict_relative(scored, fit_model(scored, grading, by), by, clip)


def award(graded: DataFrame, method: str = "Full Points") -> DataFrame:
    """Adds the points of each answer, rounded up by ``method``."""
    points = round_up(F.col("points") * F.col("relative_points"), method)
    return zero_unanswered(
        graded.withColumn("points_for_student_answer", points), "points_for_student_answer"
    )


def similarity_scores(graded: DataFrame, method: str = "Full Points") -> DataFrame:
    return similarity_sheet(award(graded, method))
