"""The registered queries of the operators, one each, over whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import (
    best_fit, binary_search, byte_bpe, lines, near_vectors, packing, periodic, quality, simhash, spelling, token_files, toxicity, warc,
)
from quillmark.llm.training import remainder
from quillmark.session import new_path
from quillmark.sources.stages import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = new_path(spark, "tokens")
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer, end_id=1)
    read = token_files.read_tokens(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.write_sequences(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)
    placed = packing.placed_pieces(packed)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _scored(found: DataFrame, score: str, held_out) -> DataFrame:
    predicted = (F.col(score) >= 0.5).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), F.col(score).alias("score"), predicted.alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.quality(documents, _table(spark, sf_dir, "labels"), held_out_by=3, held_out=1, columns=["doc_id"])
    return _scored(found, "quality_score", remainder("doc_id", 3) == 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.toxicity(documents, _table(spark, sf_dir, "labels"), held_out_by=5, held_out=0)
    return _scored(found, "toxic_score", remainder("doc_id", 5) == 0)


def op5_binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, by the signs of its components."""
    coded = stage(binary_search.codes(_table(spark, sf_dir, "embeddings")), "codes")
    found = binary_search.search(coded, coded.where("id % 20 = 0"), k=10)
    return found.select(F.col("query_id").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "distance")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, bits=4)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokens = byte_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    tokens = tokens.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(listed.cast("binary"), 256)}
    )
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return byte_bpe.decode(tokens, tokenizer).select(
        "doc_id", "n_tokens", "ids_sha256", decoded.alias("decoded_sha256")
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, sf_dir, "documents")).drop("row")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, revisits from their headers alone."""
    spark.dataSource.register(warc.WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = new_path(spark, "warc")
    records = warc.page_records(_table(spark, sf_dir, "pages"))
    records.write.format("warc").mode("append").save(folder)
    archive = spark.read.format("warc")
    responses = archive.load(folder).where(F.col("record_type") == "response")
    revisits = archive.option("payload", "false").load(folder).where(F.col("record_type") == "revisit")
    responses = responses.select(
        warc.page_id("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    return responses.unionByName(
        revisits.select(
            warc.page_id("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
            "record_type",
            warc.page_id("refers_to").alias("refers_to"),
        )
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all words of the corpus, with one letter left out of about one run in 199."""
    runs = spelling.runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run").cast("binary"))
    gone = F.pmod(h, F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    runs = runs.select(F.when(h % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.frequent(runs, least_letters=6, least=5), times=5)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    packed = best_fit.write_sequences(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)
    return best_fit.placed_pieces(packed).drop("ids")


def _with_repeats(documents: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(periodic.WORD), F.lit(0))
    rows = documents.select("doc_id", "text", h.alias("h")).withColumn("own", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("own"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, n)).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform("own", lambda w, i: F.get("own", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    by_length = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    found = found.withColumn("best", F.array_max(by_length))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_packing,
        op3_quality,
        op4_toxicity,
        op5_binary_search,
        op6_simhash,
        op7_byte_bpe,
        op8_lines,
        op9_near_vectors,
        op10_warc,
        op11_spelling,
        op12_best_fit,
        op13_periodic_runs,
    )
}
