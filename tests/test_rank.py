import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators.rank import best_solution, group_number, number_rows
from quillmark.schemas import SLOT


def keys(spark, n=3000):
    rng = random.Random(3)
    rows = {(f"E{rng.randrange(3)}", f"{rng.randrange(400):03d}", rng.randrange(1, 30)) for _ in range(n)}
    return spark.createDataFrame(sorted(rows, key=hash), "exam_id string, student_id string, q_no int")


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_numbers_are_those_of_one_sorted_list(spark, rows, ranges):
    ids = keys(spark)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(number_rows(ids), *SLOT, "identification")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = [(*r, i) for i, r in enumerate(sorted(rows(ids)))]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_numbers_do_not_depend_on_partitions(spark, rows, partitions):
    ids = keys(spark)
    assert rows(number_rows(ids.repartition(partitions)), *SLOT, "identification") == rows(
        number_rows(ids), *SLOT, "identification"
    )


def test_no_row_is_sorted_in_one_task(spark, plan_of):
    """The only single partition is that of the list of range sizes, and no sample is drawn by hand."""
    text = plan_of(number_rows(keys(spark)))
    assert "TakeOrdered" not in text and text.count("Exchange SinglePartition") == 1
    assert "HashAggregate" in text.split("Exchange SinglePartition")[1].split("\n")[1]


def test_group_number_of_repeated_keys(spark, rows):
    ids = keys(spark, 200)
    twice = ids.unionByName(ids).unionByName(ids.limit(50))
    expected = twice.withColumn(
        "identification", (F.dense_rank().over(Window.orderBy(*SLOT)) - 1).cast("bigint")
    )
    assert rows(group_number(twice), *SLOT, "identification") == rows(expected, *SLOT, "identification")


def test_no_keys(spark):
    assert number_rows(keys(spark, 10).limit(0)).count() == 0


def scored(spark, *values):
    return spark.createDataFrame(
        [("E", "s", 1, "a", t, f"sol {t}", s) for t, s in values],
        "exam_id string, student_id string, q_no int, student_solution string, solution_type string,"
        " solution string, cosine_similarity double",
    )


def test_sample_wins_a_tie(spark):
    tie = scored(spark, ("Alternative Solution", 0.5), ("Sample Solution", 0.5))
    assert best_solution(tie).first().solution_type == "Sample Solution"


def test_missing_similarity_never_wins(spark):
    some = scored(spark, ("Sample Solution", None), ("Alternative Solution", -0.5))
    assert best_solution(some).first().solution_type == "Alternative Solution"


def test_hot_slot_is_cut_down_before_the_shuffle(spark, plan_of):
    text = plan_of(best_solution(scored(spark, ("Sample Solution", 0.1))))
    before = text.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_hot_slot_gives_one_row(spark):
    hot = spark.range(30000).select(
        F.lit("E").alias("exam_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("student_id"),
        F.lit(1).alias("q_no"),
        F.col("id").cast("string").alias("student_solution"),
        F.lit("Sample Solution").alias("solution_type"),
        F.lit("x").alias("solution"),
        (F.col("id") / 30000).alias("cosine_similarity"),
    )
    best = best_solution(hot)
    assert best.count() == 20001
    assert best.where("student_id = 'hot'").first().student_solution == "29997"
