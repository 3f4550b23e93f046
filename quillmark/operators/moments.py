"""Moments of training points that can be put together and taken apart.

The state of a fit is a row of centred moments per group: the count and means of
x, x^2 and y, and the sums of their products around the means. Two states make the
state of all their points, and a state minus that of some of its points is the
state of the rest, so a further grading changes the fit without a look at old ones.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.stages import restore

#: n; means of x, x^2 and y; sums of products: x x, x^2 x^2, x x^2, y x, y x^2.
STATE = ("n", "mx", "mx2", "my", "a", "b", "c", "p", "q")
_PRODUCTS = {"a": ("mx", "mx"), "b": ("mx2", "mx2"), "c": ("mx", "mx2"), "p": ("my", "mx"), "q": ("my", "mx2")}


def moments(train: DataFrame, by: list[str] = ()) -> DataFrame:
    """State of all points (x, y), per group, in one aggregation; tasks send a handful of numbers each."""
    x = F.col("x")
    sums = train.withColumn("x2", x * x).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"),
        F.avg("x2").alias("mx2"),
        F.avg("y").alias("my"),
        F.regr_sxx("x", "x").alias("a"),
        F.regr_sxx("x2", "x2").alias("b"),
        F.regr_sxy("x", "x2").alias("c"),
        F.regr_sxy("y", "x").alias("p"),
        F.regr_sxy("y", "x2").alias("q"),
    )
    return sums.fillna(0.0, list(STATE[1:]))


def negated(state: DataFrame) -> DataFrame:
    """The state that takes those points away from one it is put together with."""
    return state.withColumns({c: -F.col(c) for c in ("n", *_PRODUCTS)})


def _both(s: Column, t: Column) -> Column:
    """Pairwise update of centred moments; counts may be negative."""
    n = s["n"] + t["n"]
    apart = {m: t[m] - s[m] for m in ("mx", "mx2", "my")}
    weight = F.try_divide(s["n"].cast("double") * t["n"], n)
    means = {m: s[m] + F.try_divide(d * t["n"], n) for m, d in apart.items()}
    products = {c: s[c] + t[c] + apart[x] * apart[y] * weight for c, (x, y) in _PRODUCTS.items()}
    # without any point left the moments are those of nothing
    return F.struct(n.alias("n"), *(F.coalesce(v, F.lit(0.0)).alias(c) for c, v in (means | products).items()))


def merge(states: list[DataFrame], by: list[str] = ()) -> DataFrame:
    """State of the points of all those states; a group need not be in each."""
    every = states[0].select(*by, *STATE)
    for more in states[1:]:
        every = every.unionByName(more.select(*by, *STATE))
    # as many rows to a group as there are states
    listed = every.groupBy(*by).agg(F.collect_list(F.struct(*STATE)).alias("_all"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0.0).alias(c) for c in STATE[1:]))
    return listed.select(*by, F.aggregate("_all", nothing, _both).alias("_s")).select(*by, "_s.*")


def solve(state: DataFrame, by: list[str] = ()) -> DataFrame:
    """Least squares for y = b0 + b1 x + b2 x^2 from its moments.

    Where all x are 0 or 1, x and x^2 are the same column and the fit of smallest
    norm shares the slope between them. Without points there is no b0.
    """
    det = F.expr("a * b - c * c")
    degenerate = F.coalesce(det <= 1e-12 * F.col("a") * F.col("b"), F.lit(True))
    half = F.coalesce(F.expr("try_divide(p, a) / 2"), F.lit(0.0))
    solved = state.withColumn("degenerate", degenerate).withColumns(
        {
            "b1": F.when(F.col("degenerate"), half).otherwise(F.try_divide(F.expr("p * b - q * c"), det)),
            "b2": F.when(F.col("degenerate"), half).otherwise(F.try_divide(F.expr("q * a - p * c"), det)),
        }
    )
    b0 = F.when(F.col("n") > 0, F.expr("my - b1 * mx - b2 * mx2"))
    return solved.select(*by, b0.alias("b0"), "b1", "b2", "n", "degenerate")


def state_at(spark: SparkSession, path: str, step: int) -> DataFrame:
    """The state that ``grow`` has written for a step."""
    return restore(spark, f"{path}/step={step}")


def grow(path: str, step: int, added: DataFrame, removed: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """State after a step, from the one before and the points that came and went.

    Only those points and the state before are read, so a step costs the same
    however many gradings there are. Steps count from 0 and are tables at ``path``;
    one that runs again writes the same table again.
    """
    spark = added.sparkSession
    states = [state_at(spark, path, step - 1)] if step else []
    states.append(moments(added, by))
    if removed is not None:
        states.append(negated(moments(removed, by)))
    merge(states, by).coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step}")
    return state_at(spark, path, step)
