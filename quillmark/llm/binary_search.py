"""Operator 5: exact nearest neighbours of binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and every code is listed under each of
its segments. Round r looks up all segments that differ from the query's in
exactly r bits. A code that no round so far has met differs in more than r bits
in every segment, so in ``segments * (r + 1)`` bits at least: a query is done as
soon as its k-th verified distance is below that.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.worker import slices
from quillmark.sources.stages import stage

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Codes of one segment that a task looks up in at once.
GROUP = 8192
#: Queries that a task looks up in them at once, about.
ASKED = 1 << 16
#: Looked-up values, and codes met, that are held at once; of codes up to a group more.
LOOKUPS = HITS = 1 << 20


def codes(embeddings: DataFrame) -> DataFrame:
    """id and code of every vector: bit i is set if component i is above zero.

    Of vectors longer than 64, components 64 apart are summed first, so all
    count. Null components are zero; null and empty vectors and rows without an
    id have no code and are left out.
    """

    def run(batches):
        for batch in slices(batches, 4096):
            lists = batch.column("embedding")
            flat = np.nan_to_num(pa.compute.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(float))
            sizes = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(sizes)), sizes)
            spots = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sums = np.bincount(rows * BITS + spots % BITS, flat, len(sizes) * BITS).reshape(-1, BITS)
            found = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8")[:, 0]
            yield pa.record_batch([batch.column("id"), pa.array(found)], ["id", "code"])

    sound = embeddings.where("vec_id IS NOT NULL AND size(embedding) > 0")
    vectors = sound.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.mapInArrow(run, "id long, code long")


def _masks(bits: int, ones: int) -> np.ndarray:
    """All numbers of some bits with so many ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), ones)], np.int64)


def _segments(code: str):
    """Column of all segments of a code: number and value."""
    parts = [
        F.struct(F.lit(n).alias("segment"), F.shiftrightunsigned(code, n * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).alias("value"))
        for n in range(SEGMENTS)
    ]
    return F.explode(F.array(*parts))


def _look_up(own: pa.Table, asked: pa.Table, radius: int, low: int, k: int) -> pa.Table:
    """Of one group of codes, those met by the queries: the best k for a query and number of differing lower bits."""
    names = ["query", "code", "least", "copies", "distance"]
    out = [[] for _ in names]
    if own.num_rows and asked.num_rows:
        order = np.argsort(own["value"].to_numpy() & ((1 << low) - 1), kind="stable")
        keys = (own["value"].to_numpy() & ((1 << low) - 1))[order]
        code, least, copies = (own[c].to_numpy()[order] for c in ("code", "least", "copies"))
        starts = np.searchsorted(keys, np.arange((1 << low) + 1))
        upper = int(own["upper"][0].as_py())
        query, bound, value = (asked[c].to_numpy() for c in ("query", "bound", "value"))
        left = radius - np.bitwise_count((value >> low) ^ upper)
        for ones in np.unique(left[(left >= 0) & (left <= low)]).tolist():
            masks, rows = _masks(low, ones), np.flatnonzero(left == ones)
            step = max(1, LOOKUPS // len(masks))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                spots = (value[some] & ((1 << low) - 1))[:, None] ^ masks
                sizes = starts[spots + 1] - starts[spots]
                met = np.cumsum(sizes.sum(axis=1))
                cuts = np.searchsorted(met, np.arange(HITS, met[-1] + HITS, HITS)) + 1
                for first, last in zip(np.concatenate([[0], cuts[:-1]]), cuts):  # of a query at most the group's codes
                    part = sizes[first:last].ravel()
                    begin = starts[spots[first:last].ravel()]
                    who = np.repeat(np.repeat(some[first:last], len(masks)), part)
                    hit = np.repeat(begin - np.cumsum(part) + part, part) + np.arange(part.sum())
                    differing = (query[who] ^ code[hit]).view(np.uint64)
                    distance = np.bitwise_count(differing).astype(np.int32)
                    near = distance <= bound[who]
                    who, hit, distance = who[near], hit[near], distance[near]
                    order = np.lexsort((least[hit], distance, query[who]))
                    who, hit, distance = who[order], hit[order], distance[order]
                    q = query[who]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < k
                    for column, x in zip(out, (q, code[hit], least[hit], copies[hit], distance)):
                        column.append(x[best])
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
    return pa.table({n: np.concatenate([np.empty(0, t), *x]).astype(t) for n, x, t in zip(names, out, kinds)})


def _met(index: DataFrame, active: DataFrame, radius: int, high: int, k: int) -> DataFrame:
    """Codes met in one round: query, code, least id, copies, distance; of each task the best k for a query.

    Segments are grouped by their ``high`` upper bits; a query goes to each group
    that is near enough and looks up the other bits there. Both sides of a group
    are cut: each part of its codes meets each part of its queries.
    """
    low = WIDTH - high
    steps = F.array(*(F.lit(int(m)) for ones in range(min(radius, high) + 1) for m in _masks(high, ones)))
    probes = active.select("query", "bound", _segments("query").alias("s"))
    probes = probes.select(
        "query", "bound", F.col("s.segment").alias("segment"), F.col("s.value").alias("value"), F.explode(steps).alias("step")
    )
    upper = F.shiftright("value", low).bitwiseXOR(F.col("step")).cast("int")
    probes = probes.withColumn("upper", upper).drop("step")
    salts = probes.groupBy("segment", "upper").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))
    parts = index.groupBy("segment", "upper").agg((F.max("part") + 1).alias("parts"))
    both = stage(parts.join(salts, ["segment", "upper"]), "parts")  # at most segments * 2**high rows
    probes = probes.join(F.broadcast(both), ["segment", "upper"])
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")).drop("salts")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    codes = index.join(F.broadcast(both.drop("parts")), ["segment", "upper"])
    codes = codes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def look_up(own: pa.Table, asked: pa.Table) -> pa.Table:
        return _look_up(own, asked, radius, low, k)

    group = ["segment", "upper", "part", "salt"]
    cogroup = codes.groupBy(*group).cogroup(probes.groupBy(*group))
    return cogroup.applyInArrow(look_up, "query long, code long, least long, copies int, distance int")


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest other rows of every query: query_id, rank (from 1), id, distance.

    Both tables have id and code; a query's own id is left out. Neighbours are
    ordered by Hamming distance and, where that is equal, by id, which is exact;
    a query has fewer only if there are no more rows. Equal codes are looked up
    once; of the ids of one code the first k + 1 are all that can be among a
    query's nearest. Repeated rows count once. Null ids or codes are left out.
    """
    rows = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    first = Window.partitionBy("code").orderBy("id")
    members = stage(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"), "members")
    known = members.groupBy("code").agg(F.min("id").alias("least"), F.count(F.lit(1)).cast("int").alias("copies"))
    known = stage(known, "codes")
    total = known.count()
    high = min(WIDTH, max(0, (max(1, total) // GROUP).bit_length()))
    index = known.select("code", "least", "copies", _segments("code").alias("s"))
    index = index.select("code", "least", "copies", F.col("s.segment").alias("segment"), F.col("s.value").alias("value"))
    index = index.withColumn("upper", F.shiftright("value", WIDTH - high).cast("int"))
    sizes = index.groupBy("segment", "upper").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    index = stage(index.join(F.broadcast(sizes), ["segment", "upper"]).withColumn("part", part).drop("parts"), "segments")

    asked = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    asked = asked.distinct()
    active = stage(asked.select("query").distinct().withColumn("bound", F.lit(BITS)), "queries")
    best = rows.sparkSession.createDataFrame([], "query long, code long, least long, copies int, distance int")
    done = []
    order = Window.partitionBy("query").orderBy("distance", "least")
    for radius in range(WIDTH + 1):
        met = _met(index, active, radius, high, k + 1)
        met = met.unionByName(best).dropDuplicates(["query", "code"])
        met = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
        # a query is done when k + 1 rows, itself among them, are nearer than all that were not met
        enough = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) >= k + 1
        kth = F.min(F.when(F.col("enough"), F.col("distance"))).over(Window.partitionBy("query"))
        met = met.withColumn("enough", enough).withColumn("bound", F.coalesce(kth, F.lit(BITS))).drop("enough")
        met = stage(met, "nearest")
        over = F.lit(radius == WIDTH) | (F.col("bound") < SEGMENTS * (radius + 1))
        done.append(met.where(over))
        best = met.where(~over).drop("bound")
        left = active.select("query").join(done[-1].select("query").distinct(), "query", "left_anti")
        bounds = met.select("query", F.col("bound")).distinct()
        active = stage(left.join(bounds, "query", "left").select("query", F.coalesce("bound", F.lit(BITS)).alias("bound")), "queries")
        if active.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    nearest = found.select("query", "code", "distance").join(members, "code")
    order = Window.partitionBy("query").orderBy("distance", "id")
    nearest = nearest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    own = asked.join(nearest, "query").where(F.col("id") != F.col("query_id"))
    others = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return own.select("query_id", others.alias("rank"), "id", "distance").where(F.col("rank") <= k)
