"""Points and feedback from a text generator the user supplies."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmark import fixed
from quillmark.functions.grades import within
from quillmark.functions.text import (
    after_echo, fill, first_number, to_last_full_stop, truncate_tokens, whole_or_decimal,
)
from quillmark.operators.items import is_answered, scheme_text
from quillmark.schemas import empty
from quillmark.session import new_path
from quillmark.sources.stages import restore, stage

Generate = Callable[[list[str]], list[str]]


def similarity_text(similarity: Column) -> Column:
    """Six decimals."""
    return F.format_string("%.6f", F.round(similarity, 6))


def grading_prompt(scheme: Column) -> Column:
    return fill(
        fixed.GRADING_PROMPT,
        points=whole_or_decimal(F.col("points")),
        scheme=scheme_text(scheme),
        question=F.col("question"),
        student_solution=F.col("student_solution"),
        solution=F.col("solution"),
        cosine_similarity=similarity_text(F.col("cosine_similarity")),
    )


def feedback_prompt(awarded: str = "points_for_student_answer") -> Column:
    return fill(
        fixed.FEEDBACK_PROMPT,
        awarded=F.col(awarded).cast("string"),
        points=whole_or_decimal(F.col("points")),
        question=F.col("question"),
        student_solution=F.col("student_solution"),
        solution=F.col("solution"),
    )


def truncate_prompts(
    df: DataFrame,
    prompt: str = "prompt",
    tokenizer: Callable[[], Callable[[str, int], str]] | None = None,
    **limits,
) -> DataFrame:
    """Prompts cut to the token budget. ``tokenizer`` may make a function
    ``(text, budget) -> text`` that counts with the generator's own vocabulary; it
    is not asked about null prompts, and has to keep a closing cue by itself."""
    if tokenizer is not None and limits.get("keep_suffix"):
        raise ValueError("keep_suffix is for the built-in counter; a tokenizer keeps its own")
    if tokenizer is None:
        return df.withColumn(prompt, truncate_tokens(F.col(prompt), **limits))
    budget = limits.get("budget", fixed.PROMPT_TOKENS)

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shorten = tokenizer()
        for texts in batches:
            yield texts.map(lambda t: shorten(t, budget), na_action="ignore")

    return df.withColumn(prompt, cut(F.col(prompt)))


def _replies(prompts: pa.Array, ask: Generate, per_call: int) -> Iterator[pa.Array]:
    """Replies to the rows of a batch, in order and in parts, one part a call.

    Only the texts of one call are Python objects. A reply is held while its prompt
    still has rows to come.
    """
    met = prompts.dictionary_encode()  # numbered as they first appear
    codes = met.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    different = met.dictionary
    known, first = np.unique(codes, return_index=True)
    first = first[known >= 0]
    last = np.zeros(len(different), np.int64)
    last[codes[codes >= 0]] = np.flatnonzero(codes >= 0)
    held: dict[int, str | None] = {}
    at = 0
    for begin in range(0, len(different), per_call):
        numbers = range(begin, min(begin + per_call, len(different)))
        held.update(zip(numbers, ask(different.slice(begin, per_call).to_pylist()), strict=True))
        end = int(first[numbers.stop]) if numbers.stop < len(different) else len(codes)
        yield pa.array([held.get(c) for c in codes[at:end].tolist()], prompts.type)
        for c in {*codes[at:end].tolist()}.intersection(held):
            if last[c] < end:
                del held[c]
        at = end
    yield pa.nulls(len(codes) - at, prompts.type)


def generate(
    df: DataFrame,
    make_generator: Callable[[dict], Generate],
    prompt: str = "prompt",
    out: str = "generated_text",
    per_call: int = 64,
) -> DataFrame:
    """Adds the reply to each prompt; null for a null prompt.

    ``make_generator`` gets the generation settings and runs once per task; the
    task hands it the different prompts of each Arrow batch, at most ``per_call``
    at a time. Only the prompt travels to Python, and replies leave it call by call.
    """

    @F.arrow_udf("string")
    def replies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = make_generator(dict(fixed.GENERATION))
        for prompts in batches:
            yield from _replies(prompts, ask, per_call)

    return df.withColumn(out, replies(F.col(prompt)))


def queue(prompts: DataFrame, slices: int) -> Iterator[DataFrame]:
    """The rows of ``prompts`` in that many slices, by a hash of ``prompt_key``.

    Each slice is written to a folder of its own, and reading one opens no file of
    another: however many slices there are, every prompt is read once. Rows of a
    slice are written by one task, which is bounded by the size of a slice.
    """
    if slices < 2:
        yield from [prompts] * slices
        return
    folder = new_path(prompts.sparkSession, "queue")
    dealt = prompts.withColumn("slice", F.pmod(F.xxhash64("prompt_key"), F.lit(slices)))
    dealt.repartition("slice").write.partitionBy("slice").parquet(folder)
    listed = restore(prompts.sparkSession, folder).select("slice").distinct().collect()
    for n in sorted(r["slice"] for r in listed):
        yield restore(prompts.sparkSession, f"{folder}/slice={n}", prompts.schema)


def generate_once(
    df: DataFrame,
    make_generator: Callable[[dict], Generate],
    path: str,
    prompt: str = "prompt",
    out: str = "generated_text",
    per_call: int = 64,
    callers: int | None = None,
    slice_rows: int = 100_000,
) -> DataFrame:
    """Replies kept in the table at ``path``: a prompt that has one is not sent again.

    New prompts are sent in slices of about ``slice_rows``, and the replies to a
    slice are committed before the next is begun, so a job that fails loses one
    slice at most and a later job sends only the rest. Within a slice a task that
    is run again asks again: a prompt may be sent twice, but one reply is kept.
    At most ``callers`` tasks ask at a time, as many as a shuffle has by default.
    """
    spark = df.sparkSession
    key = F.sha2(F.col(prompt), 256)
    table = StructType([StructField("prompt_key", StringType()), StructField(out, StringType())])
    empty(spark, table).write.mode("append").parquet(path)
    wanted = (
        df.where(F.col(prompt).isNotNull())
        .select(key.alias("prompt_key"), F.col(prompt).alias("_prompt"))
        .groupBy("prompt_key")
        .agg(F.min("_prompt").alias("_prompt"))
    )
    kept = spark.read.schema(table).parquet(path)
    new = stage(wanted.join(kept.select("prompt_key"), "prompt_key", "left_anti"), "prompts")
    tasks = callers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in queue(new, -(-new.count() // slice_rows)):
        replies = generate(part.repartition(tasks, "prompt_key"), make_generator, "_prompt", out, per_call)
        replies.select("prompt_key", out).write.mode("append").parquet(path)
    replies = spark.read.schema(table).parquet(path).groupBy("prompt_key").agg(F.min(out).alias(out))
    # Rows without prompt meet nothing; a key of their own spreads them.
    own = F.coalesce(key, F.xxhash64(*df.columns).cast("string"))
    return df.withColumn("prompt_key", own).join(replies, "prompt_key", "left").drop("prompt_key")


def strip_echo(df: DataFrame, prompt: str = "prompt", reply: str = "generated_text") -> DataFrame:
    """``feedback``: the reply without the prompt it repeats."""
    return df.withColumn("feedback", after_echo(F.col(reply), F.col(prompt)))


def parse_score(df: DataFrame, clamp: bool = False) -> DataFrame:
    """Points are the first number of the reply; as it says, or within 0 and the
    item's points with ``clamp``."""
    score = first_number(F.col("feedback"))
    if clamp:
        score = within(score, F.col("points"))
    return df.withColumn("points_for_student_answer", score)


def clean_feedback(df: DataFrame) -> DataFrame:
    return df.withColumn("feedback", to_last_full_stop(F.col("feedback")))


def unanswered_feedback(df: DataFrame) -> DataFrame:
    """Fixed feedback and no points where nothing was answered."""
    done = is_answered(F.col("student_solution"))
    given = {
        "feedback": F.lit(fixed.NOT_ANSWERED),
        "points_for_student_answer": F.lit(0.0),
    }
    return df.withColumns({c: F.when(done, F.col(c)).otherwise(v) for c, v in given.items()})
