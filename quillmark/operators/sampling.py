"""The rows a teacher grades by hand."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.grades import capped
from quillmark.operators.items import answered
from quillmark.schemas import GRADING, conform
from quillmark.sources.stages import stage


def draw(seed: int, key: str = "identification") -> Column:
    """Place of a row in a random order that is the same on every run."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "identification") -> DataFrame:
    """Exactly ``n`` rows, all of them if there are fewer."""
    return df.orderBy(draw(seed, key), key).limit(n)


def shuffle_rows(df: DataFrame, seed: int, key: str = "identification") -> DataFrame:
    return df.orderBy(draw(seed, key), key)


def without(pool: DataFrame, picked: DataFrame, key: str = "identification") -> DataFrame:
    return pool.join(picked.select(key), key, "left_anti")


def grading_rows(scored: DataFrame) -> DataFrame:
    """Answered rows in the layout of the grading table, not graded yet."""
    return conform(answered(scored).withColumn("grading", F.lit("")), GRADING)


def initial_split(pool: DataFrame, seed: int, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """(grading, pool): ``n`` rows to grade, or all of them if there are fewer."""
    grading = sample_rows(pool, n, seed)
    return grading, without(pool, grading)


def grow_training_set(
    grading: DataFrame, pool: DataFrame, seed: int, n: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(grading, pool) with ``n`` more rows moved from the pool.

    The grown table is written down, and what it holds is left out of ``pool``,
    so the whole pool may be given every time: then neither plan grows with the
    number of steps.
    """
    more = sample_rows(without(pool, grading), n, seed)
    grown = stage(grading.unionByName(more), "grading")
    return grown, without(pool, grown)


def upsert_gradings(grading: DataFrame, entered: DataFrame) -> DataFrame:
    """Gradings as entered; rows the teacher left out are not graded."""
    new = entered.select("identification", F.col("grading").alias("_new"))
    return (
        grading.join(new, "identification", "left")
        .withColumn("grading", F.coalesce("_new", F.lit("")))
        .drop("_new")
    )


def validate_grading(grading: DataFrame) -> DataFrame:
    """Adds ``grading_value``, at most the points of the item, and ``is_valid``,
    false for text that is neither empty nor a number."""
    value = capped(F.col("grading"), F.col("points"))
    valid = (F.col("grading") == "") | value.isNotNull()
    return grading.withColumns(
        {"grading_value": value, "is_valid": F.coalesce(valid, F.lit(False))}
    )
