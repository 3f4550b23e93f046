"""Best solution per answer slot, and numbers for the slots."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.fixed import SAMPLE
from quillmark.schemas import SLOT
from quillmark.sources.stages import stage


def best_solution(scored: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    """Row of highest similarity per key; the sample solution wins a tie, then the
    greater texts, so the result does not hang on the order of rows.

    Spark takes the first row per key in every map task already, so a hot key
    sends one row per task through the shuffle.
    """
    order = [
        F.col("cosine_similarity").desc_nulls_last(),
        F.when(F.col("solution_type") == SAMPLE, 0).otherwise(1),
        F.col("student_solution").desc(),
        F.col("solution").desc(),
    ]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scored.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def number_rows(
    ids: DataFrame, keys: list[str] = SLOT, out: str = "identification"
) -> DataFrame:
    """Rows with distinct ``keys`` numbered 0, 1, 2 ... in the order of the keys.

    Spark deals the keys out in ranges, and the ranges are written down with
    their number. A row's number is the size of the ranges before its own plus
    its place there, so no task sorts more than one range, and one row per range
    is all that meets in one place.
    """
    dealt = ids.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged = stage(dealt, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.select("_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_below"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(below), "_range")
        .withColumn(out, F.col("_below") + F.col("_place") - 1)
        .drop("_range", "_below", "_place")
    )


def group_number(
    df: DataFrame,
    keys: list[str] = SLOT,
    out: str = "identification",
    ids: DataFrame | None = None,
) -> DataFrame:
    """Number of each row's group among the sorted groups, from 0.

    Only the keys are sorted; the rows themselves meet their number in a join.
    ``ids`` may name a cheaper table with exactly those groups.
    """
    groups = df.select(*keys).distinct() if ids is None else ids
    return df.join(number_rows(groups, keys, out), keys)
