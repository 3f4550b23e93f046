"""Answers and items to scored rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.align import align_answers, known_answers, missing_answers, slots
from quillmark.operators.items import fill_blank_solution, is_answered, solutions_by_question
from quillmark.operators.rank import best_solution, group_number
from quillmark.operators.reshape import as_candidates
from quillmark.operators.similarity import WORDS, better_solution
from quillmark.schemas import SCORED, SLOT, conform

TEXTS = ("student_solution", "sample_solution", "alternative_solution")


def score_answers(
    answers: DataFrame,
    items: DataFrame,
    measure=WORDS,
    compared: tuple[str, str, str] = TEXTS,
    keep_blank_alternative: bool = False,
) -> DataFrame:
    """The better solution for every answer, its similarity and its number.

    ``compared`` names the answer column and the two solution columns that
    ``measure`` works on. Solutions are prepared once per item, before they meet
    the answers; both similarities come from one row; the only shuffle of the
    texts is the one that keeps a single row per answer slot.
    """
    prepare, compare = measure
    answer, sample, alternative = compared
    prepared = prepare(prepare(items, sample, "_sample"), alternative, "_alternative")
    carry = ["_sample", "_alternative"] + [c for c in [answer] if c not in TEXTS]
    aligned = align_answers(known_answers(answers), prepared, carry)
    rows = prepare(aligned, answer, "_answer")

    done = is_answered(F.col("student_solution"))
    to_sample = F.when(done, compare(F.col("_answer"), F.col("_sample"))).otherwise(F.lit(0.0))
    to_alternative = F.when(done, compare(F.col("_answer"), F.col("_alternative")))
    given = (
        rows.withColumns({"_to_sample": to_sample, "_to_alternative": to_alternative})
        .drop("_sample", "_alternative", "_answer")
    )
    given = better_solution(
        given, F.col("_to_sample"), F.col("_to_alternative"), keep_blank_alternative
    )
    layout = [f.name for f in SCORED if f.name != "identification"]
    left_out = as_candidates(missing_answers(answers, items))
    best = best_solution(given.select(*layout).unionByName(left_out.select(*layout)))
    scored = group_number(best, ids=slots(answers, items).select(*SLOT))
    if keep_blank_alternative:
        scored = fill_blank_solution(scored, solutions_by_question(items))
    return conform(scored, SCORED)


