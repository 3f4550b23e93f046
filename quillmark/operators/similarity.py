"""Similarity of an answer and a solution."""

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.fixed import ALTERNATIVE, SAMPLE
from quillmark.functions.text import words
from quillmark.functions.vectors import cosine, ratio_or_zero

# A measure adds what it needs to a table, then compares two such columns.
Prepare = Callable[[DataFrame, str, str], DataFrame]
Compare = Callable[[Column, Column], Column]


def pair_similarity(candidates: DataFrame, answer: str, solution: str) -> DataFrame:
    """Cosine of the two vectors of each row; one value per row, no matrix."""
    return candidates.withColumn("cosine_similarity", cosine(F.col(answer), F.col(solution)))


def mean_pool(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per group. Tasks add up their own rows first."""
    mean = Summarizer.mean(array_to_vector(vector))
    return vectors.groupBy(*by).agg(vector_to_array(mean).alias(vector))


def _squares(words: Column) -> Column:
    """Sum of the squared counts of sorted words.

    A word that occurs c times gives c - 1 equal neighbours in a row, and c words
    with k = c - 1 such neighbours give c + k (k + 1) = c squared.
    """
    neighbours = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda x, y: F.when(x == y, "=").otherwise(" "))
    repeats = F.regexp_extract_all(F.array_join(neighbours, ""), F.lit("=+"), F.lit(0))
    k = lambda r: F.length(r).cast("bigint")
    return F.aggregate(repeats, F.size(words).cast("bigint"), lambda s, r: s + k(r) * (k(r) + 1))


def count_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the words of a text in order and the sum of their squared counts.

    Both are found inside the row, so no word is ever shuffled.
    """
    return (
        df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(out, F.struct(F.col("_words").alias("words"), _squares(F.col("_words")).alias("squares")))
        .drop("_words")
    )


def word_cosine(answer: Column, solution: Column) -> Column:
    """Cosine of two columns made by ``count_words``, in time that grows with the words.

    The words of both, in order, have counts a + s, and the squares of those sum up
    to the squares of both sides and twice the product of a and s. Sorting two
    sorted lists as one merges them.
    """
    merged = F.sort_array(F.concat(answer.words, solution.words))
    # the merged list gets a name by a list of its own, so that it is merged once
    both = F.get(F.transform(F.array(merged), _squares), 0)
    top = (both - answer.squares - solution.squares) / 2
    return ratio_or_zero(top, F.sqrt(answer.squares.cast("double")), F.sqrt(solution.squares.cast("double")))


def take_vector(df: DataFrame, vector: str, out: str) -> DataFrame:
    """The measure for vectors that are in the table already."""
    return df.withColumn(out, F.col(vector).cast("array<double>"))


WORDS: tuple[Prepare, Compare] = (count_words, word_cosine)
VECTORS: tuple[Prepare, Compare] = (take_vector, cosine)


def better_solution(
    rows: DataFrame, sample_similarity: Column, alternative_similarity: Column,
    keep_blank_alternative: bool = False,
) -> DataFrame:
    """Wide form of melting and ranking: both similarities of a row side by side,
    so the better solution is chosen without a shuffle."""
    allowed = F.lit(True) if keep_blank_alternative else F.col("alternative_solution") != ""
    wins = F.coalesce(
        allowed
        & (alternative_similarity > F.coalesce(sample_similarity, F.lit(float("-inf")))),
        F.lit(False),
    )
    return (
        rows.withColumn("_wins", wins)
        .withColumn("solution_type", F.when(F.col("_wins"), ALTERNATIVE).otherwise(SAMPLE))
        .withColumn(
            "solution",
            F.when(F.col("_wins"), F.col("alternative_solution")).otherwise(F.col("sample_solution")),
        )
        .withColumn(
            "cosine_similarity",
            F.when(F.col("_wins"), alternative_similarity).otherwise(sample_similarity),
        )
        .drop("_wins")
    )
