"""From similarity to points: a quadratic fitted to teacher-graded rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.fixed import CURVE_POINTS
from quillmark.functions.grades import capped, relative, within
from quillmark.operators.items import is_answered
from quillmark.operators.joins import lookup
from quillmark.operators.moments import moments, solve
from quillmark.schemas import TRAIN, conform


def join_gradings(grading: DataFrame, scored: DataFrame) -> DataFrame:
    """Graded rows with their scored row; columns both have get ``_x`` and ``_y``."""
    both = set(grading.columns) & set(scored.columns) - {"identification"}
    left = grading.withColumnsRenamed({c: f"{c}_x" for c in both})
    right = scored.withColumnsRenamed({c: f"{c}_y" for c in both})
    return left.join(right, "identification", "left")


def training_rows(merged: DataFrame) -> DataFrame:
    """Rows that were graded and have points to award. Nulls are not usable."""
    return merged.where((F.col("grading") != "") & (F.col("points_x") != 0))


def training_points(merged: DataFrame, by: list[str] = ()) -> DataFrame:
    """x = similarity, y = share of the points awarded."""
    share = relative(capped(F.col("grading"), F.col("points_x")), F.col("points_x"))
    points = training_rows(merged).select(
        *by, F.col("cosine_similarity").alias("x"), share.alias("y")
    )
    return points.where("x is not null and y is not null")


def anchor_points(
    train: DataFrame, by: list[str] = (), groups: DataFrame | None = None
) -> DataFrame:
    """With (0, 0) and (1, 1), per group if there are groups: those of ``groups``,
    so that one without any grading has its ends too, or else those of the rows."""
    if by:
        ends = (train if groups is None else groups).select(*by).distinct().withColumn(
            "x", F.explode(F.array(F.lit(0.0), F.lit(1.0)))
        )
        return train.unionByName(ends.withColumn("y", F.col("x")))
    spark = train.sparkSession
    ends = spark.range(0, 2, 1, 1).select(F.col("id").cast("double").alias("x"))
    return train.unionByName(conform(ends.withColumn("y", F.col("x")), TRAIN))


def fit_quadratic(train: DataFrame, by: list[str] = ()) -> DataFrame:
    """Least squares for y = b0 + b1 x + b2 x^2 in one aggregation; see ``moments``."""
    return solve(moments(train, by), by)


def poly_features(df: DataFrame, x: str) -> DataFrame:
    return df.withColumns({"x1": F.col(x), "x2": F.col(x) * F.col(x)})


def _curve(x: Column, model: Column) -> Column:
    return model.b0 + model.b1 * x + model.b2 * x * x


def predict_relative(
    scored: DataFrame, model: DataFrame, by: list[str] = (), clip: bool = False
) -> DataFrame:
    """Adds ``relative_points``; 0 where nothing was answered.

    One model for all is a scalar subquery, so there is no join at all.
    """
    fitted = F.struct("b0", "b1", "b2")
    if by:
        models = model.select(*by, fitted.alias("_m"))
        rows = lookup(scored, models, list(by), "left")
    else:
        rows = scored.withColumn("_m", model.select(fitted).scalar())
    share = _curve(F.col("cosine_similarity"), F.col("_m"))
    if clip:
        share = within(share, F.lit(1.0))
    return zero_unanswered(rows.withColumn("relative_points", share), "relative_points").drop("_m")


def zero_unanswered(df: DataFrame, column: str) -> DataFrame:
    done = is_answered(F.col("student_solution"))
    return df.withColumn(column, F.when(done, F.col(column)).otherwise(F.lit(0.0)))


def fit_curve(model: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """The fitted curve at evenly spaced x from 0 to 1."""
    at = model.select(
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"),
        F.struct("b0", "b1", "b2").alias("m"),
    ).withColumn("x", F.col("i") / F.lit(float(points - 1)))
    return at.select("x", _curve(F.col("x"), F.col("m")).alias("y"))
