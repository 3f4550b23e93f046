from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import calibrate, moments, sampling
from quillmark.plans import grading
from quillmark.schemas import GRADING, SCORED, TRAIN
from quillmark.session import new_path
from quillmark.sources import sheets, stages

POINTS = [(0.1, 0.0), (0.4, 0.25), (0.55, 0.5), (0.8, 0.75), (0.9, 1.0)]


def train(spark, points):
    return spark.createDataFrame(points, TRAIN)


def coefficients(model):
    r = model.first()
    return [r.b0, r.b1, r.b2]


def test_fit_agrees_with_numpy_and_ml(spark):
    df = calibrate.anchor_points(train(spark, POINTS))
    x, y = np.array(POINTS + [(0, 0), (1, 1)]).T
    expected = np.linalg.lstsq(np.stack([np.ones_like(x), x, x * x], 1), y, rcond=None)[0]
    assert coefficients(calibrate.fit_quadratic(df)) == pytest.approx(list(expected))
    features = df.withColumn("v", array_to_vector(F.array("x")))
    expanded = PolynomialExpansion(degree=2, inputCol="v", outputCol="f").transform(features)
    ml = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(expanded)
    assert coefficients(calibrate.fit_quadratic(df)) == pytest.approx([ml.intercept, *ml.coefficients])


@pytest.mark.parametrize("points", [[], [(1.0, 0.5)], [(0.0, 0.2), (1.0, 0.9), (1.0, 0.7)]])
def test_fit_of_smallest_norm_where_x_is_its_square(spark, points):
    model = calibrate.fit_quadratic(calibrate.anchor_points(train(spark, points)))
    x, y = np.array(points + [(0, 0), (1, 1)], dtype=float).T
    centred = np.stack([x - x.mean(), x * x - (x * x).mean()], 1)
    slopes = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    intercept = y.mean() - slopes @ [x.mean(), (x * x).mean()]
    assert model.first().degenerate
    assert coefficients(model) == pytest.approx([intercept, *slopes])


def test_one_curve_per_group(spark):
    rows = [("a", x, y) for x, y in POINTS] + [("b", x, 1 - y) for x, y in POINTS]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    models = calibrate.fit_quadratic(calibrate.anchor_points(df, ["g"]), ["g"])
    alone = calibrate.fit_quadratic(calibrate.anchor_points(train(spark, POINTS)))
    a = models.where("g = 'a'").drop("g")
    assert coefficients(a) == pytest.approx(coefficients(alone))
    assert models.count() == 2


def test_fit_is_one_small_shuffle(spark, plan_of):
    text = plan_of(calibrate.fit_quadratic(train(spark, POINTS)))
    assert text.count("Exchange") == 1 and "partial_regr" in text.lower() or "partial" in text


def scored(spark, n=12):
    rows = [
        ("E", f"{i:02d}", "Ann", "Lee", 1, "q", "" if i % 6 == 0 else f"a {i}", 2.0, "Sample Solution", "s", i / n, i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCORED)


def graded_rows(spark, *entries):
    return spark.createDataFrame(
        [(i, "q", 2.0 if i < 9 else 0.0, "s", "a", g) for i, g in entries], GRADING
    )


def test_calibration_uses_graded_rows_with_points_only(spark):
    rows = graded_rows(spark, (1, ""), (2, "1"), (3, "x"), (9, "2"), (4, "5"))
    points = calibrate.training_points(calibrate.join_gradings(rows, scored(spark)))
    assert sorted(tuple(r) for r in points.collect()) == [(2 / 12, 0.5), (4 / 12, 1.0)]


def test_overlapping_columns_get_suffixes(spark):
    merged = calibrate.join_gradings(graded_rows(spark, (1, "1"), (99, "1")), scored(spark))
    assert {"points_x", "points_y", "question_x", "solution_y", "grading", "cosine_similarity"} <= set(merged.columns)
    assert merged.count() == 2 and merged.where("points_y is null").count() == 1


def test_unanswered_rows_get_nothing(spark):
    graded = grading.calibrate(scored(spark), graded_rows(spark, (2, "1")))
    awarded = grading.award(graded, "Half Points")
    got = {r.identification: r.points_for_student_answer for r in awarded.collect()}
    assert got[0] == got[6] == 0.0 and len(got) == 12
    assert all((2 * v).is_integer() for v in got.values())


def test_prediction_is_clipped_on_request(spark):
    model = spark.createDataFrame([(-1.0, 0.0, 4.0)], "b0 double, b1 double, b2 double")
    wild = calibrate.predict_relative(scored(spark), model).agg(F.min("relative_points"), F.max("relative_points")).first()
    tame = calibrate.predict_relative(scored(spark), model, clip=True).agg(F.min("relative_points"), F.max("relative_points")).first()
    assert wild[0] < 0 and wild[1] > 1 and tuple(tame) == (0.0, 1.0)


def test_one_model_is_no_join(spark, plan_of):
    model = calibrate.fit_quadratic(train(spark, POINTS))
    text = plan_of(calibrate.predict_relative(scored(spark), model)).split("Subquery")[0]
    assert "Join" not in text


def test_model_per_exam(spark):
    grading_rows = graded_rows(spark, (1, "1"), (2, "0"), (5, "2"))
    together = grading.calibrate(scored(spark), grading_rows).orderBy("identification").collect()
    per_exam = grading.calibrate(scored(spark), grading_rows, ["exam_id"]).orderBy("identification").collect()
    assert [r.relative_points for r in per_exam] == pytest.approx([r.relative_points for r in together])


def test_split_of_few_and_many_rows(spark):
    pool = sampling.grading_rows(scored(spark))
    assert pool.count() == 10
    grade, rest = sampling.initial_split(pool, 1)
    assert (grade.count(), rest.count()) == (2, 8)
    one = pool.where("identification = 1")
    grade, rest = sampling.initial_split(one, 1)
    assert (grade.count(), rest.count()) == (1, 0)
    grade, rest = sampling.grow_training_set(grade, rest, 2)
    assert (grade.count(), rest.count()) == (1, 0)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_sample_does_not_depend_on_partitions(spark, rows, partitions):
    pool = sampling.grading_rows(scored(spark, 200)).repartition(partitions)
    assert rows(sampling.sample_rows(pool, 5, 3), "identification") == rows(
        sampling.sample_rows(sampling.grading_rows(scored(spark, 200)), 5, 3), "identification"
    )


def test_other_seeds_give_other_rows(spark, rows):
    pool = sampling.grading_rows(scored(spark, 200))
    assert rows(sampling.sample_rows(pool, 5, 3)) != rows(sampling.sample_rows(pool, 5, 4))


def test_sampling_sorts_no_whole_table(spark, plan_of):
    assert "TakeOrderedAndProject" in plan_of(sampling.sample_rows(scored(spark), 2, 1))


def test_gradings_entered_replace_the_old_ones(spark, rows):
    old = graded_rows(spark, (1, "1"), (2, "2"))
    new = spark.createDataFrame([(2, "0.5")], "identification bigint, grading string")
    assert rows(sampling.upsert_gradings(old, new), "identification", "grading") == [(1, ""), (2, "0.5")]


def test_gradings_above_the_points_are_capped(spark, rows):
    df = graded_rows(spark, (1, "9"), (2, ""), (3, "bad"), (4, "1.5"))
    got = rows(sampling.validate_grading(df), "identification", "grading_value", "is_valid")
    assert got == [(1, 2.0, True), (2, None, True), (3, None, False), (4, 1.5, True)]


def test_sheet_order_puts_missing_names_last(spark):
    df = spark.createDataFrame(
        [(None, "a", 1), ("Lee", None, 2), ("Lee", "b", 4), ("Lee", "b", 3), ("Abe", "z", 9)],
        "surname string, first_name string, identification int",
    )
    assert [r.identification for r in sheets.sort_sheet(df).collect()] == [9, 3, 4, 2, 1]


def test_csv_sheet_keeps_line_breaks_and_quotes(spark, rows, tmp_path):
    odd = scored(spark).withColumns(
        {"student_solution": F.lit('a "quoted", text\nwith\n\nlines'), "points_for_student_answer": F.lit(1.5),
         "feedback": F.lit("")}
    )
    sheet = sheets.generative_sheet(odd)
    path = sheets.write_sheet(sheet, str(tmp_path), "llm", "full_points")
    assert path.endswith("llm_grading_full_points")
    assert rows(sheets.read_sheet(spark, path, sheet.schema)) == rows(sheet)
    path = sheets.write_sheet(sheets.similarity_sheet(odd), str(tmp_path), "similarity", "half_points", "parquet")
    assert spark.read.parquet(path).count() == 12


def test_stage_tables(spark, rows):
    df = scored(spark)
    path = new_path(spark, "stage")
    stages.save(df, path, by=["exam_id"])
    stages.save(df, path, by=["exam_id"], append=True)
    assert stages.restore(spark, path, df.schema).count() == 24
    assert rows(stages.stage(df, "s"), *df.columns) == rows(df)


def test_shared_folder_is_the_one_the_session_names(spark):
    def session(**conf):
        settings = {f"spark.{k.replace('_', '.')}": v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=settings.get))

    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        assert new_path(spark, "x").startswith(f"{named}/x-")
    assert new_path(session(checkpoint_dir="hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    with pytest.raises(RuntimeError):
        new_path(session(master="yarn"), "x")
    assert new_path(session(master="local[2]"), "x") != new_path(session(master="local[2]"), "x")


def test_growth_by_steps_keeps_its_plan(spark, plan_of):
    """However many steps, the plan is that of one, and no row is drawn twice."""
    pool = sampling.grading_rows(scored(spark))
    grade, rest = sampling.initial_split(pool, 1, n=1)
    total = pool.count()
    sizes = []
    for step in range(3):
        grade, rest = sampling.grow_training_set(grade, pool, step + 2)
        sizes.append(len(plan_of(rest)))
        assert grade.select("identification").distinct().count() == grade.count() == min(total, step + 2)
        assert rest.count() == total - grade.count()
    assert max(sizes) < 1.2 * min(sizes)


def state_of(spark, points):
    return moments.moments(spark.createDataFrame(points, "g string, x double, y double"), ["g"])


def test_merged_moments_are_those_of_all_points(spark):
    rng = np.random.default_rng(2)
    rows = [(str(n % 5), float(x), float(y)) for n, (x, y) in enumerate(1000 + 0.01 * rng.random((300, 2)))]
    rows += [(None, 0.5, 0.25), (None, 0.75, 0.5), ("alone", 1.0, 1.0)]
    whole = {r.g: r for r in state_of(spark, rows).collect()}
    parts = [state_of(spark, rows[a::7]) for a in range(7)]
    merged = {r.g: r for r in moments.merge(parts, ["g"]).collect()}
    assert set(merged) == set(whole)
    for g, r in whole.items():
        assert tuple(merged[g])[1:] == pytest.approx(tuple(r)[1:], rel=1e-9, abs=1e-12)
    rest = moments.merge([state_of(spark, rows), moments.negated(state_of(spark, rows[:200]))], ["g"])
    left = {r.g: r for r in state_of(spark, rows[200:]).collect()}
    for r in rest.collect():
        assert tuple(r)[1:] == pytest.approx(tuple(left[r.g])[1:], rel=1e-6, abs=1e-9)


def test_nothing_is_left_of_a_state_without_its_points(spark):
    rows = [("a", 0.3, 0.4), ("a", 0.7, 0.5), ("b", 0.1, 0.2)]
    state = moments.merge([state_of(spark, rows), moments.negated(state_of(spark, rows[:2]))], ["g"])
    got = {r.g: r for r in state.collect()}
    assert tuple(got["a"])[1:] == (0, *[0.0] * 8) and got["b"].n == 1
    again = {r.g: r.n for r in moments.merge([state, state_of(spark, rows)], ["g"]).collect()}
    assert again == {"a": 2, "b": 2}
    models = {r.g: r for r in moments.solve(state, ["g"]).collect()}
    assert models["a"].b0 is None and models["b"].b0 == pytest.approx(0.2)


def test_a_step_reads_only_what_is_new(spark):
    path = new_path(spark, "model")
    points = [(n / 40, (n / 40) ** 2 / 2 + 0.1 * (n % 3)) for n in range(40)]
    for step in range(4):
        state = moments.grow(path, step, train(spark, points[10 * step : 10 * step + 10]))
    assert len(state.inputFiles()) == 1  # the state after three steps is one row, not forty points
    assert coefficients(moments.solve(state)) == pytest.approx(coefficients(calibrate.fit_quadratic(train(spark, points))))
    moments.grow(path, 3, train(spark, points[30:]))  # a step that runs again
    again = moments.grow(path, 4, train(spark, []), removed=train(spark, points[35:]))
    assert coefficients(moments.solve(again)) == pytest.approx(coefficients(calibrate.fit_quadratic(train(spark, points[:35]))))
    assert again.first().n == 35


def test_tables_in_buckets_meet_without_a_shuffle(spark, plan_of):
    rows = spark.range(3000).select(F.format_string("e%d", F.col("id") % 7).alias("e"), (F.col("id") % 501).alias("s"), "id")
    one, other = (stages.stage_by(rows.withColumnRenamed("id", c), c, ["e", "s"], 5) for c in ("a", "b"))
    unique = other.groupBy("e", "s").agg(F.min("b").alias("b"))
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("e", "s").orderBy("a")))
    joined = ranked.join(unique, ["e", "s"], "left")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (unique, ranked, joined, one.join(other, ["e", "s"], "left_anti")):
            assert "Exchange" not in plan_of(df)
        got = sorted(map(tuple, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected, met = [], {}
    for n in range(3000):
        met.setdefault((f"e{n % 7}", n % 501), []).append(n)
    for key, ids in met.items():
        expected += [(*key, n, k, ids[0]) for k, n in enumerate(ids, 1)]
    assert got == sorted(expected)
    assert len(one.inputFiles()) <= 5
