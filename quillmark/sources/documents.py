"""Papers as files."""

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraph_text(content: bytes) -> str:
    """Paragraphs of one word-processing document, joined by line breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for paragraph in body.findall(f"{_W}p"):
        marks = {f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}tab": "\t"}
        lines.append(
            "".join(
                n.text or "" if n.tag == f"{_W}t" else marks.get(n.tag, "")
                for run in paragraph.iter(f"{_W}r")
                for n in run
            )
        )
    return "\n".join(lines)


def document_text(files: DataFrame) -> DataFrame:
    """``path, content`` to ``path, text, error``, one file at a time.

    A file that cannot be read has no text, and the error says why.
    """

    def text_or_error(content: bytes) -> tuple[str | None, str | None]:
        try:
            return paragraph_text(content), None
        except Exception as error:  # whatever is wrong with one file, the others count
            return None, f"{type(error).__name__}: {error}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_or_error(c) for c in batch["content"]]
            texts, errors = zip(*found) if found else ((), ())
            yield pd.DataFrame({"path": batch["path"].tolist(), "text": texts, "error": errors})

    files = only_documents(files).select("path", "content")
    return files.mapInPandas(read, "path string, text string, error string")


def unreadable(docs: DataFrame) -> DataFrame:
    """Files that gave no text: ``path, error``."""
    return docs.where(F.col("error").isNotNull()).select("path", "error")


def only_documents(files: DataFrame, suffix: str = ".docx") -> DataFrame:
    return files.where(F.col("path").endswith(suffix))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.docx")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return document_text(files)


def read_plain_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All plain-text papers below a folder, one row per file."""
    texts = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_papers(papers: DataFrame, folder: str, append: bool = False) -> None:
    """``exam_id, text``: one text file per paper, in a folder per exam."""
    writer = papers.select("exam_id", F.col("text").alias("value")).write
    writer = writer.mode("append" if append else "errorifexists")
    writer.option("maxRecordsPerFile", 1).partitionBy("exam_id").text(folder)


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_papers`` has written: ``path, exam_id, text``.

    The exam is the folder, so a predicate on it leaves other exams' files unopened.
    """
    files = spark.read.schema("value string, exam_id string").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "exam_id", F.col("value").alias("text"))


def write_bundle(bundle: DataFrame, folder: str) -> None:
    """``variant, exam_id, text``: one text file per paper, in folders."""
    bundle.select("variant", "exam_id", F.col("text").alias("value")).write.partitionBy(
        "variant", "exam_id"
    ).text(folder)


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    papers = spark.read.schema("value string, variant string, exam_id string").text(
        folder, wholetext=True
    )
    # The writer ends each file with a line break.
    text = F.expr("substring(value, 1, length(value) - 1)")
    return papers.select("variant", "exam_id", text.alias("text"))
