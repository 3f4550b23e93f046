"""Points, or feedback on points, from a text generator."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.generate import (
    Generate, clean_feedback, feedback_prompt, generate, generate_once, grading_prompt,
    parse_score, strip_echo, truncate_prompts, unanswered_feedback,
)
from quillmark.operators.items import is_answered
from quillmark.plans.grading import award
from quillmark.sources.sheets import generative_sheet, similarity_sheet
from quillmark.sources.stages import stage


def with_replies(
    rows: DataFrame,
    prompt: Column,
    make_generator: Callable[[dict], Generate],
    kept_at: str | None = None,
    **limits,
) -> DataFrame:
    """Adds ``feedback``, the reply to the prompt of each answered row.

    Unanswered rows stay in the table without a prompt, and only prompts are
    sent. What comes back is written down at once: a sort reads its input twice,
    and must not ask twice. By default the rows are staged with their replies;
    with ``kept_at`` replies are kept there per prompt, for later runs too.
    """
    asked = rows.withColumn("prompt", F.when(is_answered(F.col("student_solution")), prompt))
    asked = truncate_prompts(asked, **limits)
    if kept_at:
        replied = strip_echo(generate_once(asked, make_generator, kept_at))
    else:
        replied = stage(strip_echo(generate(asked, make_generator)), "replies")
    return replied.drop("prompt", "generated_text")


def generative_scores(
    scored: DataFrame,
    make_generator: Callable[[dict], Generate],
    scheme: str = "quarter_points",
    clamp: bool = False,
    kept_at: str | None = None,
    **limits,
) -> DataFrame:
    """Sheet of generated scores."""
    prompt = grading_prompt(F.lit(scheme))
    replied = with_replies(scored, prompt, make_generator, kept_at, **limits)
    return generative_sheet(unanswered_feedback(parse_score(replied, clamp)))


def explained_scores(
    graded: DataFrame,
    make_generator: Callable[[dict], Generate],
    method: str = "Full Points",
    kept_at: str | None = None,
    **limits,
) -> DataFrame:
    """Similarity sheet with generated feedback on the points."""
    replied = with_replies(
        award(graded, method), feedback_prompt(), make_generator, kept_at, **limits
    )
    return similarity_sheet(unanswered_feedback(clean_feedback(replied)))
