"""Marked-up papers to rows by one scan for marks.

A paper is cut once, in front of every mark, so each part begins with a mark and
ends before the next one. A field is the part behind the mark that opens it, and
it is whole if the next mark is the one that closes it. So a broken mark costs the
field it belongs to and no other, and no field swallows another one. All of this
happens inside the paper's row: nothing is shuffled, and a question's fields meet
by number, not by a join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import fixed
from quillmark.functions.text import remove, strip
from quillmark.schemas import ANSWER, ITEM, conform

# Marks begin with "front_" or "end_"; what is common stands in front, so that a scan is quick to leave other text.
_PLAIN = "|".join(m.removeprefix("end_") for m in (fixed.END_FIRST_NAME, fixed.END_SURNAME, fixed.END_STUDENT_ID))
_NUMBERED = "|".join(
    m.removeprefix("end_") for m in (fixed.END_QUESTION, fixed.END_ANSWER, fixed.END_ALTERNATIVE, fixed.END_POINTS)
)
# A mark's number is the whole number: 1 is not the 1 of 10.
MARK = rf"[ef](?:ront|nd)_(?:{_PLAIN}|(?:{_NUMBERED}) \d+)"
#: A question's number; longer ones are no numbers of questions.
NUMBER = r"^\d{1,6}$"
POINTS = r"^\s*(\d+(?:\.\d+)?)"

#: The mark that opens a field, and the one that closes it.
FIELDS = {
    "question": (fixed.END_QUESTION, fixed.FRONT_ANSWER),
    "sample_solution": (fixed.END_ANSWER, fixed.FRONT_ALTERNATIVE),
    "alternative_solution": (fixed.END_ALTERNATIVE, fixed.FRONT_POINTS),
    "answer": (fixed.END_ANSWER, fixed.FRONT_POINTS),
    "first_name": (fixed.END_FIRST_NAME, fixed.FRONT_SURNAME),
    "surname": (fixed.END_SURNAME, fixed.FRONT_STUDENT_ID),
    "student_id": (fixed.END_STUDENT_ID, fixed.FRONT_QUESTION),
}


def scan_marks(docs: DataFrame) -> DataFrame:
    """Adds ``_marks``, all marks of the text in their order: kind, k (the number
    as it is written, empty for marks without), text, what stands up to the next
    mark, and that one's kind and number, ``next`` and ``next_k``.

    A null or empty text has none.
    """
    parts = F.split(F.coalesce("text", F.lit("")), f"(?={MARK})")
    headed = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, f"^{MARK}", 0).alias("head"), p.alias("part")))
    marks = F.transform(
        F.filter(headed, lambda x: x["head"] != ""),
        lambda x: F.struct(
            F.substring_index(x["head"], " ", 1).alias("kind"),
            F.when(F.contains(x["head"], F.lit(" ")), F.substring_index(x["head"], " ", -1)).otherwise(F.lit("")).alias("k"),
            F.substring(x["part"], F.length(x["head"]) + 1, F.length(x["part"])).alias("text"),
        ),
    )
    def following(m: Column, i: Column) -> Column:
        behind = F.get("_marks", i + 1)
        return F.struct(m["kind"].alias("kind"), m["k"].alias("k"), m["text"].alias("text"), behind["kind"].alias("next"), behind["k"].alias("next_k"))

    return docs.withColumn("_marks", marks).withColumn("_marks", F.transform("_marks", following))


def _closed(mark: Column, closing: str) -> Column:
    """Whether the next mark is that one, of the same number; a mark without
    number is closed by the first question's."""
    k = F.when(mark["k"] != "", mark["k"]).when(mark["next_k"] != "", F.lit("1")).otherwise(F.lit(""))
    return F.coalesce((mark["next"] == closing) & (mark["next_k"] == k), F.lit(False))


def _with_fields(docs: DataFrame, *names: str, unclosed: bool = False) -> DataFrame:
    """Adds, per field, the marks of the whole ones found, latest first. With
    ``unclosed`` those that no mark closes are there too, behind all whole ones."""

    def found(name: str) -> Column:
        opening, closing = FIELDS[name]
        whole = F.reverse(F.filter("_marks", lambda m: (m["kind"] == opening) & _closed(m, closing)))
        if not unclosed:
            return whole
        return F.concat(whole, F.reverse(F.filter("_marks", lambda m: (m["kind"] == opening) & ~_closed(m, closing))))

    return docs.withColumns({f"_{name}": found(name) for name in names})


def _with_points(docs: DataFrame) -> DataFrame:
    """Adds the points found, latest first: the number behind the mark."""
    points = F.transform(
        F.filter("_marks", lambda m: m["kind"] == fixed.END_POINTS),
        lambda m: F.struct(m["k"].alias("k"), F.regexp_extract(m["text"], POINTS, 1).alias("text")),
    )
    return docs.withColumn("_points", F.reverse(F.filter(points, lambda m: m["text"] != "")))


def _field(name: str) -> Column:
    """Text of the last field with the number ``q_no``; null if there is none."""
    at = F.array_position(F.col(f"_{name}.k"), F.col("q_no").cast("string"))
    return strip(F.get(F.col(f"_{name}.text"), at.cast("int") - 1))


def _numbers(written: Column) -> Column:
    """The different question numbers among those."""
    numbers = F.filter(F.array_distinct(written), lambda k: k.rlike(NUMBER))
    return F.transform(numbers, lambda k: k.cast("int"))


def _exam(docs: DataFrame, exam: str | None = None) -> DataFrame:
    """The exam of a paper: the one named, or the paper's own column, or its folder."""
    if exam is not None:
        return docs.withColumn("exam_id", F.lit(exam))
    if "exam_id" in docs.columns:
        return docs
    return docs.withColumn("exam_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def _one_field(docs: DataFrame, name: str) -> DataFrame:
    marked = scan_marks(_exam(docs))
    rows = _with_points(marked) if name == "points" else _with_fields(marked, name)
    rows = rows.withColumn("q_no", F.explode(_numbers(F.col(f"_{name}.k"))))
    return rows.select("exam_id", "path", "q_no", _field(name).alias(name))


def extract_questions(docs: DataFrame) -> DataFrame:
    return _one_field(docs, "question")


def extract_sample(docs: DataFrame) -> DataFrame:
    return _one_field(docs, "sample_solution")


def extract_alternative(docs: DataFrame) -> DataFrame:
    return _one_field(docs, "alternative_solution")


def extract_points(docs: DataFrame) -> DataFrame:
    return _one_field(docs, "points").withColumn("points", F.col("points").try_cast("double"))


def _with_identity(docs: DataFrame) -> DataFrame:
    """The last whole field of each; one that no mark closes ends with its line, as
    the label of a question whose mark is broken may stand below."""
    names = ("first_name", "surname", "student_id")
    rows = _with_fields(docs, *names, unclosed=True)
    for name in names:
        found = F.get(F.col(f"_{name}"), F.lit(0))
        line = F.regexp_extract(found["text"], r"^[^\r\n]*", 0)
        text = F.when(_closed(found, FIELDS[name][1]), found["text"]).otherwise(line)
        rows = rows.withColumn(f"_{name}", strip(remove(text, ":")))
    return rows.withColumns({name: F.col(f"_{name}") for name in names}).drop(*(f"_{name}" for name in names))


def extract_identity(docs: DataFrame, exam: str | None = None) -> DataFrame:
    """First name, surname and student id of each paper; null where not found."""
    return _with_identity(scan_marks(_exam(docs, exam))).drop("_marks")


def _handed_in() -> Column:
    """Whether a paper is a student's: a teacher's has marks for alternative solutions."""
    teachers = (fixed.FRONT_ALTERNATIVE, fixed.END_ALTERNATIVE)
    return ~F.exists("_marks", lambda m: m["kind"].isin(*teachers))


def _asked() -> Column:
    labels = F.filter("_marks", lambda m: m["kind"] == fixed.END_QUESTION)
    return F.size(_numbers(F.transform(labels, lambda m: m["k"])))


def count_questions(docs: DataFrame) -> DataFrame:
    """Adds ``n_questions``, the different questions of a student's paper; a
    teacher's paper, which has places for alternative solutions, has none."""
    rows = scan_marks(docs)
    return rows.withColumn("n_questions", F.when(_handed_in(), _asked()).otherwise(F.lit(0))).drop("_marks")


def _answer_rows(marked: DataFrame, unclosed: bool) -> DataFrame:
    """One row per question of each student's paper, with its answer.

    A question is there if any of its marks is, so a broken label hides neither
    the question nor those behind it, and a paper whose labels are all broken
    still has its answers.
    """
    rows = _with_fields(marked, "answer", unclosed=unclosed).withColumn("n_questions", _asked())
    named = F.filter(_numbers(F.col("_marks.k")), lambda k: k > 0)
    counted = F.when(F.col("n_questions") > 0, F.sequence(F.lit(1), F.col("n_questions"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("q_no", F.explode(F.when(_handed_in(), F.array_union(counted, named))))
    answer = _field("answer")
    if unclosed:
        # where its front mark is broken, the label of the points stands at the end
        answer = strip(F.regexp_replace(answer, rf"{fixed.POINTS_LABEL.format(k=r'\d+').strip()}$", ""))
    return rows.withColumn("student_solution", answer)


def extract_answers(docs: DataFrame, keep_unclosed: bool = False) -> DataFrame:
    """Answer to each question of each paper; null where its own marks are broken.

    With ``keep_unclosed`` an answer whose closing mark alone is broken is what
    stands up to the next mark.
    """
    rows = _answer_rows(scan_marks(_exam(docs)), keep_unclosed)
    return rows.select("exam_id", "path", "q_no", "student_solution")


def extract_items(docs: DataFrame, exam: str | None = None) -> DataFrame:
    """Item table from teachers' papers, all of one ``exam`` if it is named."""
    rows = _with_points(scan_marks(_exam(docs, exam)))
    rows = _with_fields(rows, "question", "sample_solution", "alternative_solution")
    written = F.concat(F.col("_question.k"), F.col("_sample_solution.k"), F.col("_points.k"))
    rows = rows.withColumn("q_no", F.explode(_numbers(written)))
    names = ("question", "sample_solution", "alternative_solution", "points")
    return conform(
        rows.select("exam_id", "q_no", *[_field(n).alias(n) for n in names]).withColumns(
            {
                "points": F.col("points").try_cast("double"),
                "alternative_solution": F.coalesce("alternative_solution", F.lit("")),
            }
        ),
        ITEM,
    )


def extract_student_table(docs: DataFrame, exam: str | None = None, keep_unclosed: bool = False) -> DataFrame:
    """Answer table from students' papers, all of one ``exam`` if it is named; see ``extract_answers``."""
    return conform(_answer_rows(_with_identity(scan_marks(_exam(docs, exam))), keep_unclosed), ANSWER)
