"""Papers that arrive in steps, and numbers that last."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import numbers
from quillmark.operators.numbers import lasting_numbers, number_new, with_numbers
from quillmark.operators.rank import number_rows
from quillmark.operators.render import render_answered
from quillmark.plans.scoring import score_answers
from quillmark.schemas import ANSWER, EVAL, ITEM, SLOT
from quillmark.session import new_path
from quillmark.sources.documents import read_papers, write_papers
from quillmark.sources.stages import stage
from quillmark.sources.steps import restore_steps, save_step, whole_steps
from quillmark.streaming import arrivals

KEYS = "exam_id string, student_id string, q_no int"
QUESTIONS = [("why?", "because of the heat", ""), ("how?", "slowly", "step by step")]


def exam(spark):
    rows = [("E1", n + 1, q, s, a, 2.0) for n, (q, s, a) in enumerate(QUESTIONS)]
    return stage(spark.createDataFrame(rows, ITEM), "items")


def papers(spark, *given):
    """One paper per (student, first answer, second answer)."""
    rows = [
        ("E1", student, "Ann", "Lee", n + 1, answer, QUESTIONS[n][0], 2.0, QUESTIONS[n][1], "")
        for student, *answers in given for n, answer in enumerate(answers)
    ]
    return render_answered(spark.createDataFrame(rows, EVAL))


def answers(spark, *given):
    rows = [("E1", s, "Ann", "Lee", n + 1, a) for s, *own in given for n, a in enumerate(own)]
    return spark.createDataFrame(rows, ANSWER)


FIRST = [("s5", "of the heat", "slowly"), ("s2", "", "step"), ("s9", "no idea", "")]
SECOND = [("s1", "heat", "by step"), ("s7", "because", "slowly slowly")]
AGAIN = [("s2", "because of the heat", "")]
COLUMNS = [*SLOT, "student_solution", "solution_type", "cosine_similarity"]


def scored(df, rows):
    return rows(df.withColumn("cosine_similarity", F.round("cosine_similarity", 9)), *COLUMNS)


def inbox(spark, *deliveries):
    folder = new_path(spark, "inbox")
    for n, given in enumerate(deliveries):
        write_papers(papers(spark, *given), folder, append=n > 0)
    return folder


@pytest.mark.parametrize("most", [None, 2])
def test_steps_give_the_rows_of_one_run(spark, rows, most):
    items, folder = exam(spark), new_path(spark, "arrivals")
    box = new_path(spark, "inbox")
    for n, given in enumerate((FIRST, SECOND, AGAIN)):
        write_papers(papers(spark, *given), box, append=n > 0)
        arrivals.take_in(arrivals.arriving_papers(spark, box, most), items, folder)
        arrivals.take_in(arrivals.arriving_papers(spark, box, most), items, folder)  # nothing has come
    whole = score_answers(answers(spark, *FIRST, *SECOND, *AGAIN), items)
    got = arrivals.scored_so_far(spark, folder)
    assert scored(got, rows) == scored(whole, rows)
    assert sorted(r[0] for r in rows(got, "identification")) == list(range(10))


def test_a_step_broken_off_is_done_again_and_once(spark, rows, monkeypatch):
    items, folder = exam(spark), new_path(spark, "arrivals")
    box = inbox(spark, FIRST)
    arrivals.take_in(arrivals.arriving_papers(spark, box), items, folder)
    before = rows(arrivals.scored_so_far(spark, folder), *SLOT, "identification")
    write_papers(papers(spark, *SECOND), box, append=True)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(arrivals, "save_step", broken)  # behind the numbers, before the scores
        with pytest.raises(Exception, match="lost"):
            arrivals.take_in(arrivals.arriving_papers(spark, box), items, folder)
    assert rows(arrivals.scored_so_far(spark, folder), *SLOT, "identification") == before
    arrivals.take_in(arrivals.arriving_papers(spark, box), items, folder)
    got = arrivals.scored_so_far(spark, folder)
    assert scored(got, rows) == scored(score_answers(answers(spark, *FIRST, *SECOND), items), rows)
    assert set(before) <= set(rows(got, *SLOT, "identification"))
    assert whole_steps(spark, f"{folder}/scored") == [0, 1]


def test_half_a_step_is_not_read(spark, tmp_path, rows):
    folder = f"{tmp_path}/table"
    assert restore_steps(spark, folder, spark.range(1).schema).count() == 0
    for n in (0, 1, 10):
        save_step(spark.range(n, n + 2), folder, n)
    (tmp_path / "table" / "step=1" / "_SUCCESS").unlink()
    assert whole_steps(spark, folder) == [0, 10]
    assert rows(restore_steps(spark, folder, spark.range(1).schema)) == [(0,), (1,), (10,), (11,)]
    assert rows(restore_steps(spark, folder, spark.range(1).schema, below=10)) == [(0,), (1,)]


def test_old_numbers_stay_and_new_ones_follow_in_order(spark, rows):
    folder = new_path(spark, "numbers")
    first = [("E2", "b", 1), ("E1", "z", 2), ("E1", None, 1)]
    second = [("E1", "a", 1), ("E2", "b", 1), ("E1", None, 1), ("E1", "a", 1), (None, None, None)]
    number_new(spark.createDataFrame(first * 2, KEYS), folder, 0)
    number_new(spark.createDataFrame(second, KEYS), folder, 1)
    number_new(spark.createDataFrame([], KEYS), folder, 2)
    number_new(spark.createDataFrame(second, KEYS), folder, 1)  # the same step, once more
    number_new(spark.createDataFrame([("E0", "x", 1)], KEYS), folder, 3)
    schema = spark.createDataFrame([], KEYS).schema
    found = lasting_numbers(spark, folder, schema)
    expected = [("E1", None, 1, 0), ("E1", "z", 2, 1), ("E2", "b", 1, 2), (None, None, None, 3), ("E1", "a", 1, 4), ("E0", "x", 1, 5)]
    assert rows(found) == sorted(expected, key=repr)
    given = spark.createDataFrame([(*k, n) for n, k in enumerate(second)], f"{KEYS}, row int")
    joined = with_numbers(given, found)
    assert rows(joined, "row", "identification") == [(0, 4), (1, 2), (2, 0), (3, 4), (4, 3)]


def test_old_groups_are_not_numbered_again(spark, monkeypatch):
    folder, seen = new_path(spark, "numbers"), []
    monkeypatch.setattr(numbers, "number_rows", lambda new, *a: seen.append(new.count()) or number_rows(new, *a))
    many = spark.range(500).select(F.lit("E1").alias("exam_id"), F.col("id").cast("string").alias("student_id"), F.lit(1).alias("q_no"))
    for step, n in enumerate((400, 450, 500)):
        number_new(many.where(F.col("student_id").cast("int") < n), folder, step)
    assert seen == [400, 50, 50]


def test_papers_of_a_step_are_listed_in_few_tasks(spark):
    """Not in a task each; the setting of the session stays as it was."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    given = [(f"s{n:03d}", "of the heat", "slowly") for n in range(60)]
    items, box, folder = exam(spark), inbox(spark, given), new_path(spark, "arrivals")
    before, store = spark.conf.get(key), spark.sparkContext._jsc.sc().statusStore()
    seen = store.jobsList(None).size()
    arrivals.take_in(arrivals.arriving_papers(spark, box), items, folder)
    jobs = store.jobsList(None)
    jobs = [jobs.apply(n) for n in range(jobs.size() - seen)]  # latest first
    listing = [j.numTasks() for j in jobs if "Listing leaf files" in j.description().toString()]
    assert 0 < max(listing) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get(key) == before
    assert arrivals.scored_so_far(spark, folder).count() == 120


def test_papers_of_other_exams_stay_unopened(spark, rows, plan_of):
    folder = new_path(spark, "papers")
    given = spark.createDataFrame([("E1", "a"), ("E/2 x", "b"), ("E1", "c"), (None, "d")], "exam_id string, text string")
    write_papers(given, folder)
    found = read_papers(spark, folder).withColumn("text", F.trim(F.regexp_replace("text", "\n", "")))
    assert rows(found, "exam_id", "text") == rows(given)
    one = found.where("exam_id = 'E/2 x'")
    assert rows(one, "exam_id", "text") == [("E/2 x", "b")]
    assert "PartitionFilters: [isnotnull(exam_id" in plan_of(one)
