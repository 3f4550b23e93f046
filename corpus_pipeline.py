"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it to
the shared folder and the next stage reads it from there. All stages but the last
return the columns of the documents they were given.
"""

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillmark
from quillmark.llm import lines, packing, quality, simhash, toxicity
from quillmark.session import small_batches
from quillmark.sources.stages import stage

# Python workers need not have the package installed.
cloudpickle.register_pickle_by_value(quillmark)

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds likelier to be of quality 1 than not."""
    scored = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("quality_score") >= 0.5).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds less likely to be toxic than not."""
    small_batches(spark)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("toxic_score") < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with only the lines that no earlier line equals or nearly equals."""
    return lines.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    small_batches(spark)
    return simhash.without_near_duplicates(docs, words=4, bits=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place and their ids in the packed sequences, which are written."""
    small_batches(spark)
    return packing.placed_pieces(packing.write_sequences(docs, public_tokenizers.path(TOKENIZER), end_id=2))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models and tokenizers can't be put in SQL; the tests hold the stages
#: against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
