"""Wide to long, and putting split tables together again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.fixed import ALTERNATIVE, SAMPLE


def melt_solutions(evaluation: DataFrame, keep_blank_alternative: bool = False) -> DataFrame:
    """One row per answer and solution it is compared with."""
    pair = ["sample_solution", "alternative_solution"]
    ids = [c for c in evaluation.columns if c not in pair]
    label = F.when(F.col("solution_type") == pair[0], SAMPLE).otherwise(ALTERNATIVE)
    long = evaluation.unpivot(ids, pair, "solution_type", "solution").withColumn(
        "solution_type", label
    )
    if keep_blank_alternative:
        return long
    return long.where((F.col("solution_type") == SAMPLE) | (F.col("solution") != ""))


def as_candidates(unanswered: DataFrame) -> DataFrame:
    """Unanswered rows in the long layout: sample solution, similarity 0."""
    return (
        unanswered.withColumn("solution_type", F.lit(SAMPLE))
        .withColumnRenamed("sample_solution", "solution")
        .withColumn("cosine_similarity", F.lit(0.0))
        .drop("alternative_solution")
    )


def reunite(scored: DataFrame, unanswered: DataFrame) -> DataFrame:
    """Both tables, columns matched by name, missing ones null."""
    return scored.unionByName(unanswered, allowMissingColumns=True)
