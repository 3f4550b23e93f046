"""One named query per operator, over the driver tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import bindings as b
from quillmark.catalog.bindings import Data
from quillmark.functions import text as text_functions
from quillmark.functions.grades import relative, round_up
from quillmark.functions.vectors import cosine
from quillmark.operators import (
    align, calibrate, embed, extract, generate, items, moments, numbers, rank, render, reshape, sampling, similarity,
)
from quillmark.operators.joins import lookup
from quillmark.plans import generative, grading, scoring
from quillmark.schemas import ITEM_KEY, SLOT
from quillmark.session import new_path
from quillmark.sources import documents, sheets, stages
from quillmark.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 7


def query(function: Callable[[Data], DataFrame], name: str | None = None):
    QUERIES[name or function.__name__] = lambda spark, sf: function(Data(spark, sf))
    return function


def six(column: str | Column) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six(n) for n in names})


# --- sources and sinks


@query
def ingest_docs(data: Data) -> DataFrame:
    return documents.document_text(b.packed_papers(data)).select("path", "text")


@query
def read_papers(data: Data) -> DataFrame:
    """Students' papers written as files and read from their folder."""
    folder = new_path(data.spark, "papers")
    documents.write_papers(render.render_answered(b.evaluation(data)), folder)
    return extract.extract_student_table(documents.read_papers(data.spark, folder))


@query
def filter_extension(data: Data) -> DataFrame:
    suffix = F.when(F.col("lang") == "en", ".docx").otherwise(".pdf")
    path = F.concat(F.lit("papers/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    files = b.table(data, "documents").select("doc_id", path.alias("path"))
    return documents.only_documents(files)


@query
def append_items(data: Data) -> DataFrame:
    exam = b.items(data)
    resit = exam.drop("alternative_solution").withColumn("exam_id", F.concat(F.lit("R"), "exam_id"))
    return items.append_items(exam, resit)


@query
def render_teacher(data: Data) -> DataFrame:
    return render.render_teacher(b.items(data))


@query
def render_student(data: Data) -> DataFrame:
    return render.render_student(b.items(data))


@query
def render_student_named(data: Data) -> DataFrame:
    """Blank papers with the names of the students filled in."""
    return render.render_student(b.items(data), align.roster(b.answers(data)))


@query
def render_bundle(data: Data) -> DataFrame:
    """Both variants written as files and read back."""
    path = new_path(data.spark, "bundle")
    documents.write_bundle(render.render_bundle(b.items(data)), path)
    return documents.read_bundle(data.spark, path)


@query
def stage_roundtrip(data: Data) -> DataFrame:
    return stages.stage(b.evaluation(data), "evaluation", by=["exam_id"])


@query
def slots_in_buckets(data: Data) -> DataFrame:
    """Scored rows next to their answer and what the teacher entered: all three tables
    lie in buckets by slot, so no row of them is shuffled again."""
    answers = stages.stage_by(b.raw_vector_answers(data).select(*SLOT, "vec_id"), "answers", SLOT)
    scored = stages.stage_by(b.vector_scored(data), "scored", SLOT)
    entered = stages.stage_by(b.entered_vector_gradings(data), "entered", SLOT)
    rows = scored.join(answers, SLOT).join(entered, SLOT)
    return rounded(rows.select(*SLOT, "vec_id", "cosine_similarity", "grading"), "cosine_similarity")


@query
def sheet_generative(data: Data) -> DataFrame:
    rows = generate.parse_score(generate.strip_echo(_answered_replies(data)))
    return sheets.generative_sheet(generate.unanswered_feedback(rows))


@query
def sheet_similarity(data: Data) -> DataFrame:
    return rounded(
        sheets.similarity_sheet(grading.award(b.vector_graded(data), "none")),
        "points_for_student_answer",
    )


# --- projections, casts, conditional values


@query
def project_eval(data: Data) -> DataFrame:
    return b.evaluation(data).select(
        "first_name", "surname", "student_id", "question", "points", "sample_solution",
        "alternative_solution", "student_solution",
    )


@query
def cast_text(data: Data) -> DataFrame:
    labels = b.table(data, "labels").select("doc_id", "quality")
    docs = b.table(data, "documents").select("doc_id").join(labels, "doc_id", "left")
    return items.cast_text(docs, "quality")


@query
def cast_points(data: Data) -> DataFrame:
    points = F.when(F.col("toxic") == 1, F.lit("see me")).otherwise(
        F.concat(F.col("quality").cast("string"), F.lit(".25"))
    )
    labels = b.table(data, "labels").select("doc_id", points.alias("points"))
    return items.cast_points(labels, "points")


@query
def zero_unanswered(data: Data) -> DataFrame:
    rows = calibrate.zero_unanswered(b.evaluation(data), "points")
    return rows.select(*SLOT, "points")


@query
def default_alternative(data: Data) -> DataFrame:
    given = F.nullif("alternative_solution", F.lit(""))
    return items.default_alternative(b.items(data).withColumn("alternative_solution", given))


@query
def relative_points(data: Data) -> DataFrame:
    graded = _labelled(data)
    return graded.select(*SLOT, six(relative(F.col("grading"), F.col("points"))).alias("relative_points"))


@query
def number_items(data: Data) -> DataFrame:
    unnumbered = b.raw_items(data).select("item_id", "exam_id", "question")
    return items.number_items(unnumbered, "item_id")


# --- filters


@query
def split_answered(data: Data) -> DataFrame:
    return items.answered(b.evaluation(data)).select(*SLOT, "student_solution")


@query
def split_unanswered(data: Data) -> DataFrame:
    return items.unanswered(b.evaluation(data)).select(*SLOT, "question", "points")


@query
def rejected_answers(data: Data) -> DataFrame:
    """Answers of the labelled documents count as handed in without a student id, and
    every 19th document as an answer to a question the exam does not have."""
    labels = b.table(data, "labels").select("doc_id", "quality")
    rows = b.raw_answers(data).join(labels, "doc_id", "left")
    nameless = rows.withColumn("student_id", F.when(F.col("quality").isNull(), F.col("student_id")))
    stray = F.when(F.col("doc_id") % 19 == 0, F.col("q_no") + 1000).otherwise(F.col("q_no"))
    nameless = nameless.withColumn("q_no", stray)
    rejected = align.rejected_answers(nameless, b.items(data))
    return rejected.select("doc_id", "exam_id", "q_no", "reason")


@query
def training_rows(data: Data) -> DataFrame:
    rows = calibrate.training_rows(b.vector_merged(data))
    return rows.select("identification", "grading", "points_x", six("cosine_similarity").alias("cosine_similarity"))


@query
def validate_grading(data: Data) -> DataFrame:
    """Gradings twice as high as entered, and words in place of every blank one."""
    graded = _labelled(data)
    doubled = (F.col("grading").cast("double") * 2).cast("string")
    entered = F.when(F.col("grading") == "0.0", "none").otherwise(doubled)
    return sampling.validate_grading(graded.withColumn("grading", entered)).select(
        *SLOT, "points", "grading", "grading_value", "is_valid"
    )


@query
def validate_items(data: Data) -> DataFrame:
    """Every document as an item: points in thirds, a solution for some languages."""
    docs = b.table(data, "documents").select(
        "doc_id",
        F.col("text").alias("question"),
        F.when(F.col("lang").isin("en", "de"), F.col("text")).otherwise(" \n").alias("sample_solution"),
        (F.col("n_chars") / 3.0 - 100).alias("points"),
    )
    return items.validate_items(docs).select("doc_id", "is_valid")


# --- extraction


@query
def extract_questions(data: Data) -> DataFrame:
    return extract.extract_questions(b.teacher_papers(data)).drop("path")


@query
def extract_sample(data: Data) -> DataFrame:
    return extract.extract_sample(b.teacher_papers(data)).drop("path")


@query
def extract_alternative(data: Data) -> DataFrame:
    return extract.extract_alternative(b.teacher_papers(data)).drop("path")


@query
def extract_points(data: Data) -> DataFrame:
    return extract.extract_points(b.teacher_papers(data)).drop("path")


@query
def extract_identity(data: Data) -> DataFrame:
    return extract.extract_identity(b.student_papers(data)).drop("text")


@query
def extract_answers(data: Data) -> DataFrame:
    return extract.extract_answers(b.student_papers(data))


@query
def count_questions(data: Data) -> DataFrame:
    return extract.count_questions(b.student_papers(data)).drop("text")


@query
def extract_items(data: Data) -> DataFrame:
    return extract.extract_items(b.teacher_papers(data))


@query
def extract_student_table(data: Data) -> DataFrame:
    return extract.extract_student_table(b.student_papers(data))


# --- joins


@query
def align_answers(data: Data) -> DataFrame:
    return align.align_answers(b.answers(data), b.items(data))


@query
def student_item_grid(data: Data) -> DataFrame:
    grid = align.student_item_grid(align.roster(b.answers(data)), b.items(data))
    return grid.select(*SLOT, "first_name", "surname", "points")


@query
def evaluation_table(data: Data) -> DataFrame:
    """The grid where nobody has answered every third question."""
    rows = b.raw_answers(data).where(F.col("q_no") % 3 != 0)
    return align.evaluation_table(rows, b.items(data)).select(*SLOT, "points", "student_solution")


@query
def join_gradings(data: Data) -> DataFrame:
    return b.vector_merged(data).select(
        "identification", "grading", "points_x", "points_y", "question_x", "solution_y",
        six("cosine_similarity").alias("cosine_similarity"),
    )


@query
def fill_blank_solution(data: Data) -> DataFrame:
    """Every alternative solution, the blank ones filled from the lookup."""
    exam = b.items(data)
    rows = align.align_answers(b.answers(data), exam).withColumn(
        "solution", F.col("alternative_solution")
    )
    filled = items.fill_blank_solution(rows, items.solutions_by_question(exam))
    return filled.select(*SLOT, "question", "solution")


@query
def pool_minus_sample(data: Data) -> DataFrame:
    pool = sampling.grading_rows(b.vector_stage(data))
    return sampling.without(pool, sampling.sample_rows(pool, 10, SEED)).select("identification")


@query
def upsert_gradings(data: Data) -> DataFrame:
    scored = b.vector_stage(data)
    entered = b.vector_grading(data, scored).select("identification", "grading")
    return sampling.upsert_gradings(sampling.grading_rows(scored), entered)


@query
def pair_similarity(data: Data) -> DataFrame:
    pairs = similarity.pair_similarity(
        b.vector_candidates(data), "answer_vector", "solution_vector"
    )
    return rounded(pairs.select(*SLOT, "solution_type", "cosine_similarity"), "cosine_similarity")


# --- aggregations


@query
def max_questions(data: Data) -> DataFrame:
    return align.max_questions(extract.count_questions(b.student_papers(data)))


@query
def count_papers(data: Data) -> DataFrame:
    return align.count_papers(b.student_papers(data))


@query
def best_solution(data: Data) -> DataFrame:
    """Ranking in the long form: candidates, their similarity, best per slot."""
    pairs = similarity.pair_similarity(
        b.vector_candidates(data), "answer_vector", "solution_vector"
    )
    best = rank.best_solution(pairs)
    return rounded(
        best.select(*SLOT, "solution_type", "solution", "cosine_similarity"), "cosine_similarity"
    )


@query
def distinct_questions(data: Data) -> DataFrame:
    return items.distinct_questions(b.evaluation(data))


@query
def solutions_by_question(data: Data) -> DataFrame:
    return items.solutions_by_question(b.items(data))


@query
def fit_quadratic(data: Data) -> DataFrame:
    return rounded(b.vector_model(data), "b0", "b1", "b2")


@query
def fit_quadratic_by_exam(data: Data) -> DataFrame:
    """One curve per exam."""
    scored = b.vector_stage(data)
    model = grading.fit_model(scored, b.vector_grading(data, scored), ["exam_id"])
    return rounded(model, "b0", "b1", "b2")


@query
def fit_by_steps(data: Data) -> DataFrame:
    """One curve per exam, from gradings that come in four steps. In the second step a
    third of them is entered twice, which the third step takes back."""
    scored = b.vector_stage(data)
    merged = calibrate.join_gradings(b.vector_grading(data, scored), scored)
    points = calibrate.training_points(merged, ["exam_id", "identification"])
    points = stages.stage(points, "training_points")
    path, by, step = new_path(data.spark, "model"), ["exam_id"], F.pmod("identification", F.lit(4))
    none = points.where("false").select(*by, "x", "y")
    moments.grow(path, 0, calibrate.anchor_points(none, by, scored), by=by)
    twice = points.where(F.pmod("identification", F.lit(3)) == 0)
    for n in range(4):
        came = points.where(step == n)
        moments.grow(path, n + 1, came.unionByName(twice) if n == 1 else came, twice if n == 2 else None, by)
    return rounded(moments.solve(moments.state_at(data.spark, path, 4), by), "b0", "b1", "b2")


@query
def mean_pool(data: Data) -> DataFrame:
    pooled = similarity.mean_pool(b.table(data, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "v")).select(
        "label", "pos", six("v").alias("mean_value")
    )


# --- numbering, order, samples


@query
def identification(data: Data) -> DataFrame:
    numbered = rank.group_number(b.candidates(data))
    return numbered.select(*SLOT, "solution_type", "identification")


@query
def lasting_identification(data: Data) -> DataFrame:
    """Slots that come in three steps, by student; the second brings those of the first again."""
    keys = b.candidates(data).select(*SLOT)
    came = F.pmod(F.col("student_id").cast("int"), F.lit(3))
    folder = new_path(data.spark, "numbers")
    for n, of_step in enumerate((came == 0, came < 2, came == 2)):
        numbers.number_new(keys.where(of_step), folder, n)
    return numbers.lasting_numbers(data.spark, folder, keys.schema)


@query
def sort_sheet(data: Data) -> DataFrame:
    rows = sheets.sort_sheet(b.vector_scored(data))
    return rows.select("surname", "first_name", "identification")


@query
def sample_training(data: Data) -> DataFrame:
    pool = sampling.grading_rows(b.vector_scored(data))
    return sampling.sample_rows(pool, 2, SEED).select("identification", "question", "student_solution")


@query
def shuffle_rows(data: Data) -> DataFrame:
    docs = b.table(data, "documents").select("doc_id", sampling.draw(SEED, "doc_id").alias("draw"))
    return sampling.shuffle_rows(docs, SEED, "doc_id")


def _parts(rows: DataFrame, pool: DataFrame) -> DataFrame:
    return rows.select("identification", F.lit("grading").alias("part")).unionByName(
        pool.select("identification", F.lit("pool").alias("part"))
    )


@query
def initial_split(data: Data) -> DataFrame:
    return _parts(*sampling.initial_split(sampling.grading_rows(b.vector_stage(data)), SEED))


@query
def grow_training_set(data: Data) -> DataFrame:
    split = sampling.initial_split(sampling.grading_rows(b.vector_stage(data)), SEED)
    return _parts(*sampling.grow_training_set(*split, SEED + 1))


# --- putting together, reshaping


@query
def reunite_unanswered(data: Data) -> DataFrame:
    rows = b.evaluation(data)
    long = reshape.melt_solutions(items.answered(rows))
    both = reshape.reunite(long, reshape.as_candidates(items.unanswered(rows)))
    return both.select(*SLOT, "solution_type", "solution", "cosine_similarity")


@query
def anchor_points(data: Data) -> DataFrame:
    return rounded(calibrate.anchor_points(calibrate.training_points(b.vector_merged(data))), "x", "y")


@query
def training_points(data: Data) -> DataFrame:
    return rounded(calibrate.training_points(b.vector_merged(data)), "x", "y")


@query
def melt_solutions(data: Data) -> DataFrame:
    return b.candidates(data).select(*SLOT, "student_solution", "solution_type", "solution")


# --- scalar functions


@query
def fn_strip(data: Data) -> DataFrame:
    padded = F.concat(F.lit("\n\t "), "text", F.lit("  \r\n"))
    docs = b.table(data, "documents")
    return docs.select("doc_id", text_functions.strip(padded).alias("stripped"))


@query
def fn_replace(data: Data) -> DataFrame:
    pages = b.table(data, "pages")
    return pages.select("page_id", text_functions.remove(F.col("url"), ":").alias("without"))


def _rounding(name: str, method: str) -> None:
    def run(data: Data) -> DataFrame:
        points = F.col("l_quantity") * F.col("l_discount")
        return b.table(data, "lineitem").select(
            "l_orderkey", "l_linenumber", six(round_up(points, method)).alias("points")
        )

    query(run, name)


_rounding("round_full", "Full Points")
_rounding("round_half", "Half Points")
_rounding("round_quarter", "Quarter Points")
_rounding("round_none", "none")


@query
def fn_cosine(data: Data) -> DataFrame:
    """Each vector and the one after it."""
    v = b.table(data, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    both = v.join(after, "vec_id")
    return both.select("vec_id", six(cosine(F.col("embedding"), F.col("after"))).alias("cosine"))


@query
def poly_features(data: Data) -> DataFrame:
    rows = b.table(data, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return rounded(calibrate.poly_features(rows, "l_discount"), "x1", "x2")


# --- embedding, scoring, calibration


@query
def embed_precomputed(data: Data) -> DataFrame:
    scored = b.vector_candidates(data)
    prepare, compare = similarity.VECTORS
    rows = prepare(prepare(scored, "answer_vector", "_a"), "solution_vector", "_s")
    value = compare(F.col("_a"), F.col("_s"))
    return rows.select(*SLOT, "solution_type", six(value).alias("cosine_similarity"))


@query
def bow_cosine(data: Data) -> DataFrame:
    """Word-count cosine of every answer with every solution of its question."""
    solutions = reshape.melt_solutions(b.items(data)).drop("question", "points")
    solutions = similarity.count_words(solutions, "solution", "_s").drop("solution")
    rows = items.answered(b.answers(data))
    answers = similarity.count_words(rows, "student_solution", "_a").select(*SLOT, "_a")
    pairs = lookup(answers, solutions, ITEM_KEY)
    value = similarity.word_cosine(F.col("_a"), F.col("_s"))
    return pairs.select(*SLOT, "solution_type", six(value).alias("cosine_similarity"))


@query
def embed_udf(data: Data) -> DataFrame:
    """Cosine of answers and sample solutions by an encoder in Python."""
    exam = embed.embed(b.items(data), "sample_solution", "_s", b.make_letter_encoder)
    rows = align.align_answers(b.answers(data), exam, ["_s"])
    rows = embed.embed(items.answered(rows), "student_solution", "_a", b.make_letter_encoder)
    return rows.select(*SLOT, six(cosine(F.col("_a"), F.col("_s"))).alias("cosine_similarity"))


@query
def score_answers(data: Data) -> DataFrame:
    return rounded(b.vector_scored(data), "cosine_similarity")


@query
def score_answers_text(data: Data) -> DataFrame:
    scored = scoring.score_answers(b.answers(data), b.items(data))
    return rounded(scored, "cosine_similarity")


@query
def score_answers_encoder(data: Data) -> DataFrame:
    """Scored by vectors an encoder in Python makes of the texts."""
    exam = b.items(data)
    for text in ("sample", "alternative"):
        exam = embed.embed(exam, f"{text}_solution", f"{text}_vector", b.make_letter_encoder)
    answers = embed.embed(b.answers(data), "student_solution", "answer_vector", b.make_letter_encoder)
    scored = scoring.score_answers(answers, exam, similarity.VECTORS, b.VECTOR_COLUMNS)
    return rounded(scored, "cosine_similarity").select(
        *SLOT, "solution_type", "cosine_similarity", "identification"
    )


@query
def score_answers_blank_kept(data: Data) -> DataFrame:
    """Blank alternatives take part by their vectors, and are filled in where they win."""
    scored = scoring.score_answers(
        b.raw_vector_answers(data),
        b.vector_items(data, blank=True),
        similarity.VECTORS,
        b.VECTOR_COLUMNS,
        keep_blank_alternative=True,
    )
    return rounded(scored, "cosine_similarity").select(
        *SLOT, "solution_type", "solution", "cosine_similarity", "identification"
    )


@query
def fit_curve(data: Data) -> DataFrame:
    return rounded(calibrate.fit_curve(b.vector_model(data)), "x", "y")


@query
def predict_relative(data: Data) -> DataFrame:
    scored = b.vector_stage(data)
    model = grading.fit_model(scored, b.vector_grading(data, scored))
    predicted = calibrate.predict_relative(scored, model, clip=True)
    return predicted.select("identification", six("relative_points").alias("relative_points"))


def _calibrated(data: Data) -> DataFrame:
    return rounded(b.vector_graded(data), "cosine_similarity", "relative_points")


query(_calibrated, "calibrate")


@query
def calibrate_by_exam(data: Data) -> DataFrame:
    """One curve per exam; nobody has graded the second exam."""
    scored = b.vector_stage(data)
    ungraded = scored.where("exam_id = 'E0002'").select("identification")
    entered = b.vector_grading(data, scored).join(ungraded, "identification", "left_anti")
    graded = grading.calibrate(scored, entered, ["exam_id"])
    return graded.select("identification", six("relative_points").alias("relative_points"))


@query
def similarity_scores(data: Data) -> DataFrame:
    return grading.similarity_scores(b.vector_graded(data), "Half Points")


@query
def grade_papers(data: Data) -> DataFrame:
    """From marked-up papers to the sheet: extract, score, calibrate on the labels,
    round. Papers are parsed once and answers scored once: both are stage tables,
    of which later passes read only the columns they need."""
    exam = stages.stage(extract.extract_items(b.teacher_papers(data)), "items")
    answers = stages.stage(extract.extract_student_table(b.student_papers(data)), "answers")
    scored = stages.stage(scoring.score_answers(answers, exam), "scored")
    entered = scored.join(b.label_gradings(data), SLOT, "left").select(
        "identification", "grading"
    )
    graded = sampling.upsert_gradings(sampling.grading_rows(scored), entered)
    return grading.similarity_scores(grading.calibrate(scored, graded), "Quarter Points")


@query
def papers_in_steps(data: Data) -> DataFrame:
    """Papers of every other student arrive first, the others' when those are scored and numbered."""
    exam = stages.stage(extract.extract_items(b.teacher_papers(data)), "items")
    inbox, folder = new_path(data.spark, "inbox"), new_path(data.spark, "arrivals")
    for n in range(2):
        came = F.pmod(F.col("student_id").cast("int"), F.lit(2)) == n
        documents.write_papers(render.render_answered(b.evaluation(data).where(came)), inbox, append=n > 0)
        arrivals.take_in(arrivals.arriving_papers(data.spark, inbox), exam, folder)
    scored = arrivals.scored_so_far(data.spark, folder)
    return rounded(scored.select(*SLOT, "solution_type", "cosine_similarity", "identification"), "cosine_similarity")


@query
def grade_papers_rejects(data: Data) -> DataFrame:
    """Answers that are not graded, and why: one in 13 has a blank id, one in 11 belongs
    to no question, and to one in 7 the student has handed in a second, empty paper."""
    rows = b.raw_answers(data)
    second = rows.where(F.col("doc_id") % 7 == 0).withColumn("student_solution", F.lit(""))
    blank = F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("student_id"))
    stray = F.when(F.col("doc_id") % 11 == 0, F.col("q_no") + 1000).otherwise(F.col("q_no"))
    given = rows.unionByName(second).withColumns({"student_id": blank, "q_no": stray}).drop("doc_id")
    given = stages.stage(given, "answers")
    scored = scoring.score_answers(given, b.items(data)).select(*SLOT, "student_solution")
    scored = stages.stage(scored, "scored")
    rejected = align.rejected_answers(given, b.items(data), scored)
    return rejected.select(*SLOT, F.md5(F.col("student_solution").cast("binary")).alias("answer_md5"), "reason")


# --- generated scores and feedback


def _labelled(data: Data) -> DataFrame:
    points = b.items(data).select("exam_id", "q_no", "points")
    return b.label_gradings(data).join(points, ["exam_id", "q_no"])


def _answered_replies(data: Data) -> DataFrame:
    """Evaluation rows with a reply each, as if read from a table of replies."""
    rows = b.vector_scored(data).withColumn("prompt", generate.grading_prompt(F.lit("half_points")))
    ending = F.get(F.array(*map(F.lit, b.ENDINGS)), F.pmod("identification", F.lit(5)).cast("int"))
    return rows.withColumn("generated_text", F.concat("prompt", ending))


@query
def prompt_grading(data: Data) -> DataFrame:
    scored = items.answered(b.vector_scored(data))
    return scored.select("identification", generate.grading_prompt(F.lit("full_points")).alias("prompt"))


@query
def prompt_feedback(data: Data) -> DataFrame:
    awarded = items.answered(grading.award(b.vector_graded(data), "Half Points"))
    return awarded.select("identification", generate.feedback_prompt().alias("prompt"))


@query
def truncate_prompt(data: Data) -> DataFrame:
    docs = b.responses(data).select("doc_id", "prompt")
    return generate.truncate_prompts(docs)


@query
def truncate_prompt_keep_suffix(data: Data) -> DataFrame:
    docs = b.responses(data).select("doc_id", "prompt")
    return generate.truncate_prompts(docs, budget=200, keep_suffix="Score:")


@query
def generate_stub(data: Data) -> DataFrame:
    docs = b.responses(data).select("doc_id", "prompt")
    return generate.generate(docs, b.make_echo_generator).select("doc_id", "generated_text")


@query
def generate_once(data: Data) -> DataFrame:
    """Replies kept in a stage table, one for each different prompt."""
    docs = b.responses(data).select("doc_id", "prompt")
    replies = generate.generate_once(docs, b.make_echo_generator, new_path(data.spark, "replies"))
    return replies.select("doc_id", "generated_text")


@query
def strip_echo(data: Data) -> DataFrame:
    return generate.strip_echo(b.responses(data)).select("doc_id", "feedback")


@query
def parse_score(data: Data) -> DataFrame:
    scored = generate.parse_score(generate.strip_echo(b.responses(data)))
    return scored.select("doc_id", "points_for_student_answer")


@query
def parse_score_clamped(data: Data) -> DataFrame:
    replies = b.responses(data).withColumn("points", F.pmod("doc_id", F.lit(2)).cast("double"))
    scored = generate.parse_score(generate.strip_echo(replies), clamp=True)
    return scored.select("doc_id", "points_for_student_answer")


@query
def clean_feedback(data: Data) -> DataFrame:
    replies = generate.clean_feedback(generate.strip_echo(b.responses(data)))
    return replies.select("doc_id", "feedback")


@query
def unanswered_feedback(data: Data) -> DataFrame:
    rows = b.evaluation(data).withColumns(
        {"feedback": F.col("question"), "points_for_student_answer": F.col("points")}
    )
    done = generate.unanswered_feedback(rows)
    return done.select(*SLOT, "feedback", "points_for_student_answer")


@query
def scheme_text(data: Data) -> DataFrame:
    """The market segment of a customer stands for the scheme asked for."""
    name = (
        F.when(F.col("c_mktsegment") == "BUILDING", "full_points")
        .when(F.col("c_mktsegment") == "MACHINERY", "half_points")
        .otherwise(F.col("c_mktsegment"))
    )
    customers = b.table(data, "customer")
    return customers.select("c_custkey", items.scheme_text(name).alias("scheme"))


@query
def generative_scores(data: Data) -> DataFrame:
    scored = scoring.score_answers(b.answers(data), b.items(data))
    return generative.generative_scores(scored, b.make_echo_generator, "quarter_points")


@query
def explained_scores(data: Data) -> DataFrame:
    return generative.explained_scores(
        b.vector_graded(data), b.make_echo_generator, "Half Points"
    )
