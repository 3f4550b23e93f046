"""The driver tables read as an exam.

``benchmark`` holds the questions, 20 to an exam; ``documents`` the answers, one
per question and student; ``customer`` the students; ``labels`` the gradings a
teacher entered. ``embeddings`` holds vectors for the same questions: first the
sample solutions, then the alternative ones, then the answers.
"""

import io
import zipfile
from functools import cached_property
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.fixed import SAMPLE
from quillmark.operators.align import align_answers, evaluation_table
from quillmark.operators.calibrate import join_gradings
from quillmark.operators.items import answered
from quillmark.operators.joins import lookup
from quillmark.operators.render import render_answered, render_teacher
from quillmark.operators.reshape import melt_solutions
from quillmark.operators.similarity import VECTORS
from quillmark.plans.grading import calibrate, fit_model
from quillmark.plans.scoring import score_answers
from quillmark.schemas import ANSWER, ITEM, SLOT, conform
from quillmark.sources.stages import stage

ITEMS_PER_EXAM = 20
VECTOR_COLUMNS = ("answer_vector", "sample_vector", "alternative_vector")


# Columns of the driver tables that are read here. A given schema saves a look
# into the files each time a table is opened.
SCHEMAS = {
    "benchmark": "item_id bigint, text string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double",
    "pages": "page_id bigint, url string",
}


class Data:
    """The driver tables of one folder, and the number of questions in them."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def n(self) -> Column:
        return F.lit(table(self, "benchmark").count())


def table(data: Data, name: str) -> DataFrame:
    return data.spark.read.schema(SCHEMAS[name]).parquet(f"{data.sf}/{name}.parquet")


def _exam_id(item_id: Column) -> Column:
    number = F.floor(item_id / ITEMS_PER_EXAM) + 1
    return F.concat(F.lit("E"), F.lpad(number.cast("string"), 4, "0"))


def _q_no(item_id: Column) -> Column:
    return (F.pmod(item_id, F.lit(ITEMS_PER_EXAM)) + 1).cast("int")


def _student_id(number: Column) -> Column:
    return F.lpad(number.cast("string"), 6, "0")


def raw_items(data: Data) -> DataFrame:
    """ITEM and ``item_id``; every second item has an alternative solution."""
    questions = table(data, "benchmark")
    other = questions.select(F.col("item_id").alias("_other"), F.col("text").alias("_text"))
    next_id = F.pmod(F.col("item_id") + 1, data.n)
    even = F.pmod("item_id", F.lit(2)) == 0
    return questions.withColumn("_other", F.when(even, next_id)).join(other, "_other", "left").select(
        "item_id",
        _exam_id(F.col("item_id")).alias("exam_id"),
        _q_no(F.col("item_id")).alias("q_no"),
        F.concat(F.lit("Item "), F.col("item_id").cast("string"), F.lit(": "), "text").alias("question"),
        F.col("text").alias("sample_solution"),
        F.coalesce("_text", F.lit("")).alias("alternative_solution"),
        F.pmod("item_id", F.lit(5)).cast("double").alias("points"),
    )


def items(data: Data) -> DataFrame:
    return conform(raw_items(data), ITEM)


def _names(data: Data) -> DataFrame:
    return table(data, "customer").select(
        F.col("c_custkey").alias("_student"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("surname"),
    )


def raw_answers(data: Data) -> DataFrame:
    """ANSWER and ``doc_id``; one document in 17 stands for a blank answer."""
    n = data.n
    docs = table(data, "documents").select(
        "doc_id",
        F.pmod("doc_id", n).alias("_item"),
        F.floor(F.col("doc_id") / n).alias("_student"),
        F.when(F.pmod("doc_id", F.lit(17)) == 0, F.lit("")).otherwise(F.col("text")).alias("student_solution"),
    )
    return docs.join(_names(data), "_student", "left").select(
        "doc_id",
        _exam_id(F.col("_item")).alias("exam_id"),
        _student_id(F.col("_student")).alias("student_id"),
        "first_name",
        "surname",
        _q_no(F.col("_item")).alias("q_no"),
        "student_solution",
    )


def answers(data: Data) -> DataFrame:
    return conform(raw_answers(data), ANSWER)


def evaluation(data: Data) -> DataFrame:
    return evaluation_table(answers(data), items(data))


def candidates(data: Data) -> DataFrame:
    """Answered rows next to each of their solutions."""
    return melt_solutions(answered(evaluation(data)))


def label_gradings(data: Data) -> DataFrame:
    """What the teacher entered: SLOT and ``grading`` for labelled answers."""
    labels = table(data, "labels").select("doc_id", "quality")
    keyed = raw_answers(data).select("doc_id", *SLOT).join(labels, "doc_id")
    points = items(data).select("exam_id", "q_no", "points")
    graded = lookup(keyed, points, ["exam_id", "q_no"])
    return graded.select(*SLOT, (F.col("quality") * F.col("points")).cast("string").alias("grading"))


# --- papers


def teacher_papers(data: Data) -> DataFrame:
    papers = render_teacher(items(data))
    path = F.concat(F.lit("papers/"), "exam_id", F.lit("/sample_solution.docx"))
    return papers.select(path.alias("path"), "text")


def student_papers(data: Data) -> DataFrame:
    papers = render_answered(evaluation(data))
    path = F.concat(F.lit("papers/"), "exam_id", F.lit("/"), "student_id", F.lit(".docx"))
    return papers.select(path.alias("path"), "text")


# --- vectors


def _vectors(data: Data) -> DataFrame:
    return table(data, "embeddings").select("vec_id", "embedding")


def vector_items(data: Data, blank: bool = False) -> DataFrame:
    """ITEM with the vectors of both solutions; a blank one has a vector if ``blank``."""
    n = data.n
    v = _vectors(data)
    sample = v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("sample_vector"))
    alternative = v.select(
        (F.col("vec_id") - n).alias("item_id"), F.col("embedding").alias("_alternative")
    )
    joined = raw_items(data).join(sample, "item_id").join(alternative, "item_id", "left")
    vector = F.when(F.lit(blank) | (F.col("alternative_solution") != ""), F.col("_alternative"))
    return joined.select(*[f.name for f in ITEM], "sample_vector", vector.alias("alternative_vector"))


def raw_vector_answers(data: Data) -> DataFrame:
    """ANSWER with a vector; ``vec_id`` and the points of the item are kept."""
    n = data.n
    at = F.col("vec_id") - 2 * n
    rows = (
        _vectors(data)
        .where(F.col("vec_id") >= 2 * n)
        .select(
            "vec_id",
            F.col("embedding").alias("answer_vector"),
            F.pmod(at, n).alias("_item"),
            F.floor(at / n).alias("_student"),
        )
    )
    text = F.concat(F.lit("Answer "), F.col("vec_id").cast("string"))
    return rows.join(_names(data), "_student", "left").select(
        "vec_id",
        "answer_vector",
        _exam_id(F.col("_item")).alias("exam_id"),
        _student_id(F.col("_student")).alias("student_id"),
        "first_name",
        "surname",
        _q_no(F.col("_item")).alias("q_no"),
        F.when(F.pmod("vec_id", F.lit(17)) == 0, F.lit("")).otherwise(text).alias("student_solution"),
        F.pmod("_item", F.lit(5)).cast("double").alias("item_points"),
    )


def vector_scored(data: Data) -> DataFrame:
    return score_answers(
        raw_vector_answers(data), vector_items(data), VECTORS, VECTOR_COLUMNS
    )


def vector_stage(data: Data) -> DataFrame:
    """The scored rows as a stage table, for steps that read them more than once."""
    return stage(vector_scored(data), "scored")


def entered_vector_gradings(data: Data) -> DataFrame:
    """SLOT and ``grading``: every third vector was graded by the teacher."""
    given = F.least(F.pmod("vec_id", F.lit(5)).cast("double"), F.col("item_points"))
    graded = F.when(F.pmod("vec_id", F.lit(3)) == 0, given.cast("string")).otherwise(F.lit(""))
    return raw_vector_answers(data).select(*SLOT, graded.alias("grading"))


def vector_grading(data: Data, scored: DataFrame) -> DataFrame:
    """GRADING table of the answered vectors with the entered gradings."""
    rows = answered(scored).join(entered_vector_gradings(data), SLOT)
    return rows.select(
        "identification", "question", "points", "solution", "student_solution", "grading"
    )


def vector_candidates(data: Data) -> DataFrame:
    """Answered vectors next to each of their solutions, one pair per row."""
    aligned = align_answers(
        raw_vector_answers(data),
        vector_items(data),
        ["answer_vector", "sample_vector", "alternative_vector"],
    )
    long = melt_solutions(answered(aligned))
    vector = F.when(F.col("solution_type") == SAMPLE, F.col("sample_vector")).otherwise(
        F.col("alternative_vector")
    )
    return long.withColumn("solution_vector", vector).drop("sample_vector", "alternative_vector")


def vector_merged(data: Data) -> DataFrame:
    scored = vector_stage(data)
    return join_gradings(vector_grading(data, scored), scored)


def vector_model(data: Data) -> DataFrame:
    scored = vector_stage(data)
    return fit_model(scored, vector_grading(data, scored))


def vector_graded(data: Data) -> DataFrame:
    scored = vector_stage(data)
    return calibrate(scored, vector_grading(data, scored))


# --- text generator and encoder that need nothing but their input

ENDINGS = [" 1.5 points. Good. rest", " .5", " Score -5", " no number", ""]


def responses(data: Data) -> DataFrame:
    """Replies to the documents as prompts; one in eleven does not repeat the prompt."""
    docs = table(data, "documents").select(
        "doc_id", F.col("text").alias("prompt")
    )
    ending = F.get(F.array(*map(F.lit, ENDINGS)), F.pmod("doc_id", F.lit(5)).cast("int"))
    echo = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit("")).otherwise(F.col("prompt"))
    return docs.withColumn("generated_text", F.concat(echo, ending))


def make_echo_generator(settings: dict):
    """Repeats the prompt and adds an ending picked by its length."""
    assert settings["top_k"] > 0

    def ask(prompts: list[str]) -> list[str]:
        return [p + ENDINGS[len(p) % len(ENDINGS)] for p in prompts]

    return ask


def make_letter_encoder():
    """Vector of how often each of the letters a to z stands in the text."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(chr(c)) for c in range(97, 123)] for t in texts])

    return encode


_DOCUMENT = (
    '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/'
    'wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
)


def packed(text: str) -> bytes:
    """A word-processing document with one paragraph per line."""
    paragraphs = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
        for line in text.split("\n")
    )
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", _DOCUMENT.format(paragraphs))
    return file.getvalue()


def packed_papers(data: Data) -> DataFrame:
    """Students' papers as files: ``path, content``."""

    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": batch["text"].map(packed)})

    return student_papers(data).mapInPandas(pack, "path string, content binary")
