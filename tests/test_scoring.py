import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.catalog import bindings as b
from quillmark.operators import align, joins, reshape, similarity
from quillmark.operators.items import answered, fill_blank_solution, solutions_by_question
from quillmark.operators.rank import best_solution
from quillmark.plans.scoring import score_answers
from quillmark.schemas import ANSWER, ITEM, SLOT

ITEMS = [
    ("E", 1, "Colour of the sky?", "the sky is blue", "blue", 2.0),
    ("E", 2, "Two and two?", "four", "", 1.0),
    ("E", 3, "Why?", "because it is so", "it is so", 0.0),
    ("F", 1, "Colour of the sky?", "azure", "", 3.0),
]


def items(spark):
    return spark.createDataFrame(ITEMS, ITEM)


def answers(spark, *rows):
    """(exam, student, question, text)"""
    return spark.createDataFrame([(e, s, "Ann", "Lee", q, t) for e, s, q, t in rows], ANSWER)


def scored(spark, *rows, **options):
    got = score_answers(answers(spark, *rows), items(spark), **options)
    return {(r.exam_id, r.student_id, r.q_no): r for r in got.collect()}


def by_hand(a: str, s: str) -> float:
    x, y = Counter(a.lower().split()), Counter(s.lower().split())
    length = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(x[w] * y[w] for w in x) / length if length else 0.0


def test_better_solution_wins(spark):
    got = scored(spark, ("E", "s1", 1, "Blue"), ("E", "s2", 1, "the sky is the limit"))
    assert got["E", "s1", 1].solution_type == "Alternative Solution"
    assert got["E", "s1", 1].cosine_similarity == 1.0
    assert got["E", "s2", 1].solution_type == "Sample Solution"
    assert got["E", "s2", 1].cosine_similarity == pytest.approx(by_hand("the sky is the limit", "the sky is blue"))


def test_shorter_papers_leave_empty_rows_and_shift_nothing(spark):
    got = scored(spark, ("E", "s1", 3, "it is so"), ("F", "s2", 1, "azure"))
    assert sorted(got) == [("E", "s1", 1), ("E", "s1", 2), ("E", "s1", 3), ("F", "s2", 1)]
    assert got["E", "s1", 1].student_solution == "" and got["E", "s1", 1].cosine_similarity == 0.0
    assert got["E", "s1", 1].solution == "the sky is blue" and got["E", "s1", 1].first_name == "Ann"
    assert [got[k].identification for k in sorted(got)] == [0, 1, 2, 3]


def test_null_and_white_space_are_unanswered(spark):
    got = scored(spark, ("E", "s", 1, None), ("E", "s", 2, " \n"), ("E", "s", 3, "None"))
    assert [got["E", "s", q].cosine_similarity for q in (1, 2, 3)] == [0.0, 0.0, 0.0]
    assert got["E", "s", 1].student_solution == ""
    assert got["E", "s", 3].student_solution == "None"


def test_blank_alternative_takes_no_part(spark):
    assert scored(spark, ("E", "s", 2, "nothing shared"))["E", "s", 2].solution_type == "Sample Solution"


def test_blank_alternative_that_wins_is_filled_from_the_question(spark):
    rows = spark.createDataFrame(
        [("E", "s", 2, "Two and two?", ""), ("E", "s", 1, "Colour of the sky?", "blue"), ("E", "t", 9, "unknown", "")],
        "exam_id string, student_id string, q_no int, question string, solution string",
    )
    filled = fill_blank_solution(rows, solutions_by_question(items(spark)))
    assert {r.q_no: r.solution for r in filled.collect()} == {2: "four", 1: "blue", 9: ""}


def test_same_question_in_two_exams_is_kept_apart(spark):
    got = scored(spark, ("E", "s", 1, "azure"), ("F", "s", 1, "azure"))
    assert (got["E", "s", 1].cosine_similarity, got["F", "s", 1].cosine_similarity) == (0.0, 1.0)


def test_second_paper_of_a_student_keeps_the_better_answer(spark):
    got = scored(spark, ("E", "s", 2, "five"), ("E", "s", 2, "four"), ("E", "s", 2, ""))
    assert got["E", "s", 2].student_solution == "four" and len(got) == 3


def test_rows_that_cannot_be_graded_are_set_aside(spark):
    given = answers(spark, ("E", None, 1, "blue"), ("E", "s", 9, "?"), ("E", "", 1, "blue"))
    rejected = align.rejected_answers(given, items(spark))
    assert {(r.student_id, r.q_no): r.reason for r in rejected.collect()} == {
        (None, 1): "no student id", ("s", 9): "no such question", ("", 1): "no student id",
    }
    got = score_answers(given, items(spark))
    assert {r.student_id for r in got.collect()} == {"s"}


def test_one_answer_of_a_crowded_slot_is_left_out(spark, plan_of):
    """Equal copies are rejected but one, and no task sorts the answers of a slot."""
    texts = ["b", "a", "b", "b", None, "", "c"] * 30
    rows = [("e", "s", 1, "n", t) for t in texts] + [("e", "t", 1, "n", t) for t in ("y", "x")] + [("e", "u", 1, "n", "z")]
    given = spark.createDataFrame(rows, "exam_id string, student_id string, q_no int, first_name string, student_solution string")
    one = spark.createDataFrame([("e", 1)], "exam_id string, q_no int")
    best = [("e", "s", 1, "b"), ("e", "t", 1, "not there"), ("e", "u", 1, "z")]
    scored = spark.createDataFrame(best, "exam_id string, student_id string, q_no int, student_solution string")
    rejected = align.rejected_answers(given, one, scored)
    assert "Window" not in plan_of(rejected)
    got = sorted((r.student_id, r.student_solution) for r in rejected.collect() if r.student_solution is not None)
    left = [("s", t) for t in texts if t is not None] + [("t", "y")]
    left.remove(("s", "b"))
    assert got == sorted(left) and rejected.where("student_solution is null").count() == 30


def test_every_answer_is_graded_or_rejected(spark):
    """Two students without an id stay two rejects; of two papers the better answers are graded."""
    given = answers(
        spark, ("E", "", 1, "blue"), ("E", " ", 1, "red"), ("E", "s", 1, "sky blue"), ("E", "s", 1, ""),
        ("E", "s", 1, "sky blue"), ("E", "s", 2, "five"), ("E", "s", 2, "four"), ("E", "t", 9, "?"), ("E", None, 2, None),
    )
    scored = score_answers(given, items(spark))
    rejected = align.rejected_answers(given, items(spark), scored).collect()
    reasons = sorted((r.student_id or "", r.q_no, r.student_solution or "", r.reason) for r in rejected)
    assert reasons == [
        ("", 1, "blue", "no student id"), ("", 2, "", "no student id"), (" ", 1, "red", "no student id"),
        ("s", 1, "", "another answer is graded"), ("s", 1, "sky blue", "another answer is graded"),
        ("s", 2, "five", "another answer is graded"), ("t", 9, "?", "no such question"),
    ]
    graded = align.align_answers(align.known_answers(given), items(spark)).select("student_id", "q_no").distinct().count()
    assert graded + len(rejected) == given.count()


def test_no_person_is_made_up(spark):
    given = answers(spark, ("E", "s", 1, "a"), ("E", "s", 2, "b"))
    names = F.when(F.col("q_no") == 1, F.struct(F.lit("Ann").alias("f"), F.lit("Zed").alias("s")))
    names = names.otherwise(F.struct(F.lit("Bob").alias("f"), F.lit("Abe").alias("s")))
    two = given.withColumn("_p", names).withColumns({"first_name": F.col("_p.f"), "surname": F.col("_p.s")}).drop("_p")
    one = align.roster(two).collect()
    assert [(r.first_name, r.surname) for r in one] == [("Ann", "Zed")]


def test_wide_and_long_form_agree(spark, sf, rows):
    data = b.Data(spark, sf)
    pairs = similarity.pair_similarity(b.vector_candidates(data), "answer_vector", "solution_vector")
    long = best_solution(pairs)
    wide = answered(b.vector_scored(data))
    names = [*SLOT, "solution_type", "solution", "cosine_similarity"]
    assert rows(long, *names) == rows(wide, *names)


def test_nan_and_zero_vectors(spark):
    vectors = [("E", 1, "q", "s", "a", 1.0, [1.0, float("nan")], [0.0, 0.0])]
    item = spark.createDataFrame(
        vectors,
        "exam_id string, q_no int, question string, sample_solution string, alternative_solution string,"
        " points double, sample_vector array<float>, alternative_vector array<float>",
    )
    given = answers(spark, ("E", "s", 1, "x")).withColumn("answer_vector", F.array(F.lit(1.0), F.lit(2.0)))
    got = score_answers(given, item, similarity.VECTORS, b.VECTOR_COLUMNS).first()
    assert (got.solution_type, got.cosine_similarity) == ("Alternative Solution", 0.0)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_result_does_not_depend_on_partitions(spark, sf, rows, partitions):
    data = b.Data(spark, sf)
    once = rows(b.vector_scored(data))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows(b.vector_scored(data)) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_large_item_table_gives_the_same_rows(spark, rows, plan_of):
    """Beyond the size for a broadcast both sides are shuffled; nothing is forced."""
    given = answers(
        spark, *[("E", f"s{i}", 1, f"sky {i}") for i in range(60)], ("F", "s1", 1, "azure"), ("E", "s1", 2, "four")
    )
    small = rows(score_answers(given, items(spark)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = score_answers(given, items(spark))
        assert rows(large) == small
        aligned = align.align_answers(given, items(spark))
        assert "SortMergeJoin" in plan_of(aligned)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_question_is_spread_over_tasks(spark):
    """A third of the rows in one question: no task gets more than its part."""
    facts = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id"
    )
    table = facts.select("k").distinct().withColumn("v", F.col("k") * 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.lookup(facts, table, ["k"], spread_by=["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 30000 and joined.where("v <> 2 * k").count() == 0
        assert max(sizes) < 30000 / 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_python_and_no_cross_join_in_scoring(spark, sf, plan_of):
    data = b.Data(spark, sf)
    for df in (b.vector_scored(data), score_answers(b.answers(data), b.items(data))):
        text = plan_of(df)
        for word in ("Python", "CartesianProduct", "NestedLoop"):
            assert word not in text


def test_key_passes_do_not_read_the_texts(spark, sf, plan_of):
    """Which slots there are is found without the answers' texts."""
    data = b.Data(spark, sf)
    text = plan_of(align.slots(b.answers(data), b.items(data)))
    reads = [line for line in text.split("\n") if "documents.parquet" in line]
    assert reads and all("ReadSchema: struct<doc_id:bigint>" in line for line in reads)


def test_whole_texts_are_compared(spark):
    """A word at the very end of a long answer counts."""
    long = " ".join(["word"] * 20000 + ["four"])
    got = scored(spark, ("E", "s", 2, long))["E", "s", 2]
    assert got.cosine_similarity == pytest.approx(1 / math.sqrt(20000**2 + 1))


def test_melting_keeps_blank_alternatives_on_request(spark):
    rows = items(spark)
    assert reshape.melt_solutions(rows).count() == 6
    assert reshape.melt_solutions(rows, keep_blank_alternative=True).count() == 8


def test_cosine_counts_repeated_words(spark):
    rng = random.Random(7)
    words = [" ".join(rng.choice("aab cd e ff ggg hh".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame(list(zip(words, words[1:] + [None])), "a string, s string")
    prepared = similarity.count_words(similarity.count_words(rows, "a", "_a"), "s", "_s")
    got = prepared.select("a", "s", similarity.word_cosine(F.col("_a"), F.col("_s")).alias("c")).collect()
    assert all(r.c == pytest.approx(by_hand(r.a, r.s or "")) for r in got)


def test_cosine_of_many_words_takes_no_square_of_time(spark):
    def seconds(n):
        rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, n + k)),) for k in range(4)], "a string").coalesce(1)
        prepared = similarity.count_words(rows, "a", "_a")
        value = similarity.word_cosine(F.col("_a"), F.col("_a"))
        start = time.perf_counter()
        assert [r[0] for r in prepared.select(value).collect()] == pytest.approx([1.0] * 4)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(64_000) < 16 * max(seconds(8_000), 0.5)
