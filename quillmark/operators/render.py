"""Item table to marked-up papers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import fixed
from quillmark.functions.text import fill, whole_or_decimal
from quillmark.operators.joins import lookup



def _marked(front: str, label: str, end: str) -> Column:
    """Label of a question between its marks, numbered by ``q_no``."""
    k = F.col("q_no").cast("string")
    return fill(f"{front} {{k}}{label}{end} {{k}}", k=k)


def _identity_line(front: str, label: str, end: str, value: Column) -> Column:
    return F.concat(F.lit(f"{front}{label}{end}:"), value)


def _header(title: Column, first_name: Column, surname: Column, student_id: Column) -> Column:
    return F.concat_ws(
        "\n",
        title,
        F.lit("\n"),
        _identity_line(fixed.FRONT_FIRST_NAME, fixed.LABEL_FIRST_NAME, fixed.END_FIRST_NAME, first_name),
        _identity_line(fixed.FRONT_SURNAME, fixed.LABEL_SURNAME, fixed.END_SURNAME, surname),
        _identity_line(fixed.FRONT_STUDENT_ID, fixed.LABEL_STUDENT_ID, fixed.END_STUDENT_ID, student_id),
        F.lit("\n"),
    )


def teacher_block() -> Column:
    """Paragraphs of one item in the teacher's paper."""
    return F.concat_ws(
        "\n",
        _marked(fixed.FRONT_QUESTION, fixed.TEACHER_QUESTION_LABEL, fixed.END_QUESTION),
        F.col("question"),
        _marked(fixed.FRONT_ANSWER, fixed.TEACHER_ANSWER_LABEL, fixed.END_ANSWER),
        F.col("sample_solution"),
        _marked(fixed.FRONT_ALTERNATIVE, fixed.ALTERNATIVE_LABEL, fixed.END_ALTERNATIVE),
        F.coalesce("alternative_solution", F.lit("")),
        _marked(fixed.FRONT_POINTS, fixed.POINTS_LABEL, fixed.END_POINTS),
        whole_or_decimal(F.col("points")),
        F.lit("\n"),
    )


def student_block(answer: Column) -> Column:
    """Paragraphs of one item in a student's paper."""
    return F.concat_ws(
        "\n",
        _marked(fixed.FRONT_QUESTION, fixed.STUDENT_QUESTION_LABEL, fixed.END_QUESTION),
        F.col("question"),
        _marked(fixed.FRONT_ANSWER, fixed.STUDENT_ANSWER_LABEL, fixed.END_ANSWER),
        F.coalesce(answer, F.lit("")),
        _marked(fixed.FRONT_POINTS, fixed.POINTS_LABEL, fixed.END_POINTS),
        whole_or_decimal(F.col("points")),
        F.lit("\n"),
    )


def _body(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of each paper in the order of the questions. A group is one paper
    with one block per question, so it is as small as the paper."""
    ordered = F.sort_array(F.collect_list(F.struct("q_no", "block")))
    return blocks.groupBy(*by).agg(
        F.array_join(F.transform(ordered, lambda b: b.block), "\n").alias("body")
    )


def render_teacher(items: DataFrame) -> DataFrame:
    """Teacher's paper of each exam: ``exam_id, text``."""
    bodies = _body(items.withColumn("block", teacher_block()), ["exam_id"])
    title = F.concat("exam_id", F.lit(fixed.TEACHER_TITLE_SUFFIX))
    blank = F.lit("")
    return bodies.select(
        "exam_id", F.concat_ws("\n", _header(title, blank, blank, blank), "body").alias("text")
    )


def render_student(items: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Blank student's paper of each exam, or one per student of ``roster`` with
    the names filled in. The questions of an exam are put together once."""
    bodies = _body(items.withColumn("block", student_block(F.lit(""))), ["exam_id"])
    blank = F.lit("")
    if roster is None:
        header = _header(F.col("exam_id"), blank, blank, blank)
        return bodies.select("exam_id", F.concat_ws("\n", header, "body").alias("text"))
    filled = lookup(roster, bodies, ["exam_id"])
    return _with_names(filled)


def render_answered(evaluation: DataFrame) -> DataFrame:
    """Papers as students hand them in. A paper has one place per question; of two
    answers to one question the greater text stands there."""
    names = ("student_solution", "first_name", "surname", "question", "points")
    single = evaluation.groupBy("exam_id", "student_id", "q_no").agg(F.max(F.struct(*names)).alias("_row"))
    single = single.select("exam_id", "student_id", "q_no", "_row.*")
    blocks = single.withColumn("block", student_block(F.col("student_solution"))).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("first_name", "surname")}
    )
    return _with_names(_body(blocks, ["exam_id", "student_id", "first_name", "surname"]))


def _with_names(papers: DataFrame) -> DataFrame:
    filled = [F.concat(F.lit(" "), F.coalesce(c, F.lit(""))) for c in ("first_name", "surname", "student_id")]
    return papers.select(
        "exam_id",
        "student_id",
        F.concat_ws("\n", _header(F.col("exam_id"), *filled), "body").alias("text"),
    )


def render_bundle(items: DataFrame) -> DataFrame:
    """Both variants of every exam: ``variant, exam_id, text``."""
    teacher = render_teacher(items).withColumn("variant", F.lit("teacher"))
    student = render_student(items).withColumn("variant", F.lit("student"))
    return teacher.unionByName(student).select("variant", "exam_id", "text")
