"""Papers taken in as they arrive: read once, scored once, numbered for good.

    take_in(arriving_papers(spark, inbox), items, folder)     # as often as papers came
    scored = scored_so_far(spark, folder)

A call takes what has arrived since the last one and ends. Which files were taken
is in the stream's checkpoint; every step writes folders of its own, so a step
that is broken off and runs again replaces itself, and no paper counts twice.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.operators.extract import extract_student_table
from quillmark.operators.numbers import lasting_numbers, number_new, with_numbers
from quillmark.operators.rank import best_solution
from quillmark.operators.similarity import WORDS
from quillmark.plans.scoring import score_answers
from quillmark.schemas import SCORED, SLOT, conform
from quillmark.sources.stages import stage
from quillmark.sources.steps import restore_steps, save_step

ROWS = StructType([f for f in SCORED if f.name != "identification"])


def arriving_papers(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Papers in folders per exam, as ``write_papers`` leaves them, as a stream:
    path, exam_id, text. A step takes ``most`` files, or all there are."""
    reader = spark.readStream.schema("value string, exam_id string")
    if most:
        reader = reader.option("maxFilesPerTrigger", most)
    files = reader.text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "exam_id", F.col("value").alias("text"))


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Streams that run inside list a step's papers in as many tasks as a shuffle has.

    By default there is a task for each paper up to 10,000, which takes ten times as
    long; and a stream that goes on lists the papers of its last step once more.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def take_in(papers: DataFrame, items: DataFrame, folder: str, measure=WORDS) -> None:
    """Extracts, scores and numbers the answers of all papers that have arrived.

    ``items`` is a written table. A step reads its own papers, the items and the
    keys numbered so far; it reads no earlier paper, answer or score.
    """

    def step(batch: DataFrame, number: int) -> None:
        answers = stage(extract_student_table(batch), "answers")
        scored = stage(score_answers(answers, items, measure).drop("identification"), "scored")
        # numbers first: whoever sees the scores of a step finds their numbers
        number_new(scored.select(*SLOT), f"{folder}/numbers", number)
        save_step(conform(scored, ROWS), f"{folder}/scored", number)

    writer = papers.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    with _few_listing_tasks(papers.sparkSession):
        writer.trigger(availableNow=True).start().awaitTermination()


def scored_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """The better solution per slot of all papers taken in, with lasting numbers.

    Where a student has handed in several papers for an exam, in one step or in
    several, the better answer to a question counts; a question left out on one of
    them is not left out if another answers it.
    """
    best = best_solution(restore_steps(spark, f"{folder}/scored", ROWS))
    return conform(with_numbers(best, lasting_numbers(spark, f"{folder}/numbers", ROWS)), SCORED)
