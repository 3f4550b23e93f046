"""Connected components of a written table of links, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.stages import stage


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node it is linked to by any number of steps.

    ``links`` has two long columns a and b; null ends, loops and repeated links
    are left out, and nodes without a link are not listed. Large stars hang the
    larger neighbours of a node on its smallest, small stars the smaller ones,
    until nothing changes: a number of rounds that grows with the logarithm of
    the longest chain. Every round is written to the shared folder; a hub's links
    are reduced before they are shuffled, and the join back on a hub can be split.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stage(links.select(high, low).where("a > b").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(larger.distinct(), "large_stars")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        smaller = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stage(smaller.where("a > b").distinct(), "small_stars")
