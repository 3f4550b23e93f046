"""Operator 8: lines that repeat over the corpus, by a deletion-neighbourhood join.

A line is a row of words. Two lines are near if one word put in, taken out or
replaced makes them equal. Every line is given all its variants with one word
deleted, as hashed keys: lines of equal length that are equal without word j are
a replacement apart, and a line equal to a variant of a longer one is a deletion
apart. Only built-in functions are used.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.stages import stage

#: Of near lines, the longer one has this many words at least; shorter lines are
#: only dropped if they are equal, as one word of few is no small change.
LEAST_WORDS = 10
ID = ("h1", "h2")


def words_of(line: Column) -> Column:
    """The words of a line, as they stand between ASCII white space."""
    return F.array_remove(F.split(line, r"[ \t\n\x0B\f\r]+"), "")


def _halves(words: Column) -> Column:
    """Keys of which near lines have one in common.

    Of two near lines, the longer one with n words, (n - 1) / 2 words at the
    beginning or the end are equal, as the one change is not among them.
    """
    n = F.size(words)
    half = lambda size: F.array(
        F.xxhash64(F.lit(0), size, F.slice(words, F.lit(1), size)),
        F.xxhash64(F.lit(1), size, F.slice(words, n - size + 1, size)),
    )
    sizes = [F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")]
    return F.array_distinct(F.concat(*map(half, sizes)))


def _hashed(documents: DataFrame, least_words: int) -> DataFrame:
    """All lines: place (doc_id, line_no, row), a hash of 128 bits, null for blank lines, and halves."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", F.xxhash64(text).alias("row"), F.split(text, "\n").alias("lines"))
    lines = docs.select("doc_id", "row", F.posexplode("lines").alias("line_no", "line"))
    words = F.col("words")
    return lines.select("doc_id", "line_no", "row", words_of(F.col("line")).alias("words")).select(
        F.struct("doc_id", "line_no", "row").alias("place"),
        F.when(F.size(words) > 0, F.xxhash64(words)).alias("h1"),
        F.when(F.size(words) > 0, F.xxhash64(F.lit(8), words)).alias("h2"),
        F.when(F.size(words) >= least_words - 1, _halves(words)).alias("halves"),
    )


def _sharing(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another row has too."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), key)


def _with_words(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (h1, h2, place) with their words: their numbers are brought to the documents."""
    wanted = lines.groupBy("place.doc_id", "place.row").agg(
        F.collect_list(F.struct(F.col("place.line_no").alias("line_no"), *ID)).alias("wanted")
    )
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))
    docs = docs.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")))
    found = docs.select("doc_id", "row", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    return found.select(
        *(F.col(f"w.{c}").alias(c) for c in ID),
        F.struct("doc_id", "w.line_no", "row").alias("place"),
        words_of(F.get("lines", F.col("w.line_no"))).alias("words"),
    ).dropDuplicates([*ID])


def _same_but_one(a: Column, b: Column) -> Column:
    """Whether two rows of words, a not shorter, differ by one word put in, taken out or replaced."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    differs = F.greatest(differs, F.lit(1))
    rest = lambda x, at: F.slice(x, at, F.size(x))
    behind = F.when(F.size(a) == F.size(b), differs + 1).otherwise(differs)
    return (F.size(a) - F.size(b) <= 1) & (rest(a, differs + 1) == rest(b, behind))


def _near(lines: DataFrame, least_words: int) -> DataFrame:
    """h1, h2 and ``near``, the earliest other line within the bound, for lines (with words) that have one."""
    words, n = F.col("words"), F.size("words")
    without = lambda j: F.xxhash64(F.slice(words, F.lit(1), j - 1), F.slice(words, j + 1, n))
    deleted = F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(without(j).alias("key"), j.alias("at")))
    whole = F.array(F.struct(F.xxhash64(words).alias("key"), F.lit(0).alias("at")))
    variants = F.when(n >= least_words, F.concat(whole, deleted)).otherwise(whole)
    rows = lines.select("h1", F.explode(variants).alias("v")).select("h1", "v.key", "v.at")
    rows = _sharing(stage(rows, "line_variants"), "key")
    shared = stage(rows.join(lines.select("h1", "h2", "place", n.alias("n")), "h1"), "shared_variants")

    # rows of one group are near one another: the earliest two are enough for all
    replaced = shared.where("at > 0").withColumn("group", F.xxhash64("key", "n", "at"))
    put_in = shared.withColumn("group", F.xxhash64("key", F.when(F.col("at") > 0, F.col("n") - 1).otherwise(F.col("n"))))
    put_in = put_in.select("*", (F.col("at") == 0).alias("whole"))
    line = F.struct("place", "h1", "h2")
    first = replaced.groupBy("group").agg(F.min(line).alias("first"))
    met = replaced.join(first, "group").select("h1", "h2", "place", "first")
    firsts = put_in.groupBy("group").agg(
        F.min(F.when(F.col("whole"), line)).alias("short"), F.min(F.when(~F.col("whole"), line)).alias("long")
    )
    across = put_in.join(firsts.where("short IS NOT NULL AND long IS NOT NULL"), "group")
    across = across.select("h1", "h2", "place", F.when(F.col("whole"), F.col("long")).otherwise(F.col("short")).alias("first"))
    met = met.unionByName(across).where(F.col("first.place") < F.col("place"))
    found = met.groupBy("h1", "h2").agg(F.min("first").alias("first"))

    own = lines.select("h1", "h2", "words")
    other = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("other"))
    pair = found.join(own, [*ID]).join(other, (F.col("first.h1") == F.col("o1")) & (F.col("first.h2") == F.col("o2")))
    longer = F.when(F.size("words") >= F.size("other"), F.struct(F.col("words").alias("a"), F.col("other").alias("b")))
    longer = longer.otherwise(F.struct(F.col("other").alias("a"), F.col("words").alias("b")))
    pair = pair.withColumn("pair", longer).where(_same_but_one(F.col("pair.a"), F.col("pair.b")))
    return pair.select("h1", "h2", F.col("first.place").alias("near"))


def repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, line_no, kept, first_doc_id, first_line_no, distance, row of every line.

    Lines are what stands between line feeds, numbered from 0, and compared by
    their words, so white space makes no difference. A line is kept if no
    earlier line, by doc_id (null first) and number, is equal to it or within one
    word of it; else first_* is the earliest such line and distance 0 or 1. Of
    lines one word apart the longer has at least ``least_words`` words. Blank
    lines, those of null and empty texts too, are kept and have no first. ``row``
    is a hash of the text; documents repeated with id and text share their places
    and what is kept there.
    """
    lines = stage(_hashed(documents, least_words), "hashed_lines")
    classes = lines.where("h1 IS NOT NULL").groupBy(*ID).agg(F.min("place").alias("place"), F.first("halves").alias("halves"))
    classes = stage(classes, "line_classes")
    halves = classes.where("halves IS NOT NULL").select("h1", F.explode("halves").alias("half"))
    near = _sharing(halves, "half").select("h1").distinct()
    wanted = classes.select(*ID, "place").join(near, "h1")
    near = _near(stage(_with_words(documents, wanted), "near_lines"), least_words)
    known = classes.select(*ID, "place").join(near, [*ID], "left").select(
        *ID, F.coalesce("near", "place").alias("first"), F.col("near").isNotNull().cast("int").alias("distance")
    )
    blank = lines.where("h1 IS NULL").select("place", F.col("place").alias("first"), F.lit(0).alias("distance"))
    all_lines = lines.where("h1 IS NOT NULL").join(known, [*ID]).select("place", "first", "distance").unionByName(blank)
    kept = F.col("place") == F.col("first")
    of = lambda c: F.when(~kept, F.col(c))
    return all_lines.select(
        "place.doc_id",
        "place.line_no",
        kept.alias("kept"),
        of("first.doc_id").alias("first_doc_id"),
        of("first.line_no").alias("first_line_no"),
        of("distance").alias("distance"),
        "place.row",
    )


def without_repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with only the lines that ``repeated_lines`` keeps, all columns as they were.

    A document of which no line is kept has an empty text; null texts stay null.
    """
    dropped = repeated_lines(documents, least_words).where("NOT kept")
    dropped = dropped.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"))
    row = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    same = documents["doc_id"].eqNullSafe(dropped["doc_id"]) & (row == dropped["row"])
    lines = F.split(documents["text"], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped["gone"])
    rebuilt = F.array_join(F.transform(left, lambda n: F.get(lines, n)), "\n")
    text = F.when(dropped["gone"].isNull(), documents["text"]).otherwise(rebuilt)
    return documents.join(dropped, same, "left").select(
        *(text.alias(c) if c == "text" else documents[c] for c in documents.columns)
    )
