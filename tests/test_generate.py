import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.operators import embed, generate
from quillmark.plans import generative
from quillmark.schemas import SCORED
from quillmark.session import new_path
from quillmark.sources.stages import stage


def scored(spark, *texts):
    rows = [
        ("E", f"{i:02d}", "Ann", "Lee", 1, "q?", t, 2.0, "Sample Solution", "s", 0.5, i)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCORED)


def fixed_reply(reply, echo=True):
    def make(settings):
        assert settings == {"top_k": 3, "top_p": 0.5, "temperature": 0.5}
        return lambda prompts: [(p if echo else "") + reply for p in prompts]

    return make


def sheet(spark, reply, *texts, **options):
    got = generative.generative_scores(scored(spark, *texts), fixed_reply(reply), **options)
    return {r.student_id: (r.points_for_student_answer, r.feedback) for r in got.collect()}


def test_prompt_reads_as_published(spark):
    row = scored(spark, "mine").withColumn("p", generate.grading_prompt(F.lit("full_points"))).first()
    assert row.p == (
        "You are a teacher grading exam questions, please provide a score from 0 to 2 for the following "
        "student answer. Use the following grading scheme: full points like 0, 1 or 2. Question: q?, "
        "Student Solution: mine, Sample Solution: s, Cosine Similarity between sample solution and "
        "student solution: 0.500000, Score:"
    )


def test_unanswered_rows_are_not_sent(spark):
    got = sheet(spark, " 1.5 of 2", "a", "", " \n")
    assert got == {
        "00": (1.5, "1.5 of 2"),
        "01": (0.0, "Question has not been answered"),
        "02": (0.0, "Question has not been answered"),
    }


def test_score_is_as_it_says_or_clamped(spark):
    assert sheet(spark, " 7 points", "a")["00"][0] == 7.0
    assert sheet(spark, " 7 points", "a", clamp=True)["00"][0] == 2.0
    assert sheet(spark, " -0.5", "a", clamp=True)["00"][0] == 0.0
    assert sheet(spark, " none", "a", clamp=True)["00"][0] is None


def test_reply_without_echo_is_kept_whole(spark):
    got = generative.generative_scores(scored(spark, "a"), fixed_reply("2 points", echo=False)).first()
    assert (got.points_for_student_answer, got.feedback) == (2.0, "2 points")


def test_long_prompts_lose_their_tail_or_keep_the_cue(spark):
    df = scored(spark, "word " * 2000).withColumn("prompt", generate.grading_prompt(F.lit("")))
    assert not generate.truncate_prompts(df).first().prompt.endswith("Score:")
    assert generate.truncate_prompts(df, keep_suffix="Score:").first().prompt.endswith("Score:")


def test_tokenizer_of_the_generator(spark):
    df = spark.createDataFrame([("abcdef",)], "prompt string")
    cut = generate.truncate_prompts(df, tokenizer=lambda: lambda text, budget: text[:budget], budget=3)
    assert cut.first().prompt == "abc"


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make(settings):
        def ask(prompts):
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [p + " 1" for p in prompts]

        return ask

    path = new_path(spark, "replies")
    first = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "id int, prompt string")
    got = generate.generate_once(first, make, path).collect()
    assert len(got) == 30 and all(r.generated_text == f"p{r.id % 3} 1" for r in got)
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "id int, prompt string")
    assert generate.generate_once(more, make, path).count() == 2
    assert sorted(open(log).read().split()) == ["new", "p0", "p1", "p2"]


def test_replies_leave_call_by_call():
    """No more than a call's replies, and those whose prompt comes again, are held at a time."""
    asked = []

    def ask(prompts):
        asked.append(prompts)
        return [p + "!" for p in prompts]

    given = ["a", None, "b", "a", "c", "", None, "d", "b", "e", None]
    parts = generate._replies(pa.array(given), ask, 2)
    assert asked == [] and next(parts).to_pylist() == ["a!", None, "b!", "a!"] and asked == [["a", "b"]]
    assert next(parts).to_pylist() == ["c!", "!", None] and len(asked) == 2
    rest = [x for part in parts for x in part.to_pylist()]
    assert rest == ["d!", "b!", "e!", None] and asked == [["a", "b"], ["c", ""], ["d", "e"]]
    assert [p.to_pylist() for p in generate._replies(pa.array([None, None], "string"), ask, 2)] == [[None, None]]
    with pytest.raises(ValueError):
        list(generate._replies(pa.array(["a", "b"]), lambda prompts: ["one"], 2))


def test_replies_meet_their_rows(spark):
    """Over several Arrow batches, with repeated, empty and null prompts."""
    text = F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), (F.col("id") % 1000).cast("int")))
    df = spark.range(0, 25_000, 1, 2).withColumn("prompt", text)
    make = lambda settings: lambda prompts: [f"{len(p)}" for p in prompts]
    right = F.col("generated_text").eqNullSafe(F.length("prompt").cast("string"))
    assert generate.generate(df, make, per_call=16).where(right).count() == 25_000


def test_sorting_a_sheet_does_not_ask_twice(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make(settings):
        def ask(prompts):
            with open(log, "a") as f:
                f.writelines("x\n" for _ in prompts)
            return [p + " 1" for p in prompts]

        return ask

    texts = [f"answer {i}" for i in range(40)] + ["", " "]
    assert generative.generative_scores(scored(spark, *texts), make).count() == 42
    assert len(open(log).readlines()) == 40
    graded = scored(spark, *texts).withColumn("relative_points", F.lit(0.6))
    sheet_of = generative.explained_scores(graded, make, kept_at=new_path(spark, "replies"))
    assert len(sheet_of.collect()) == 42
    assert len(open(log).readlines()) == 80


def test_replies_kept_for_a_sheet(spark):
    path = new_path(spark, "replies")
    for _ in range(2):
        got = generative.generative_scores(scored(spark, "a", ""), fixed_reply(" 1"), kept_at=path)
        assert sorted(r.points_for_student_answer for r in got.collect()) == [0.0, 1.0]
    assert spark.read.parquet(path).count() == 1


def test_explained_sheet(spark):
    graded = scored(spark, "a", "").withColumn("relative_points", F.lit(0.6))
    got = generative.explained_scores(graded, fixed_reply(" Good. And mo"), "Half Points").collect()
    assert [(r.points_for_student_answer, r.feedback) for r in got] == [
        (1.5, "Good."), (0.0, "Question has not been answered"),
    ]


def test_vectors_come_back_in_order(spark):
    def letters():
        return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], dtype=float)

    texts = ["ab", "a", None, "", "ab", "bbb"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.v for r in embed.embed(df, "t", "v", letters, batch=2).collect()}
    assert [got[i] for i in range(6)] == [[1, 1], [1, 0], [0, 0], [0, 0], [1, 1], [0, 3]]
    assert len(got) == 300


def test_every_text_is_encoded_once(spark, tmp_path):
    """However many tasks hold it, and however often the result is read."""
    log = str(tmp_path / "encoded")

    def make():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return np.ones((len(texts), 1))

        return encode

    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 40).cast("string").alias("t"))
    rows = embed.embed(df, "t", "v", make)
    assert rows.where("v[0] = 1").count() == rows.count() == 5000
    assert sorted(open(log).read().split()) == sorted(map(str, range(40)))


def test_a_failed_job_keeps_its_replies(spark, tmp_path):
    """The second run sends only the prompts that have no reply yet."""
    log, broken = tmp_path / "asked", tmp_path / "broken"
    broken.touch()

    def make(settings):
        def ask(prompts):
            assert len(prompts) <= 5
            if os.path.exists(broken) and os.path.exists(log) and len(open(log).readlines()) >= 30:
                raise RuntimeError("the generator is gone")
            with open(log, "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return [f"{p}!" for p in prompts]

        return ask

    path = new_path(spark, "replies")
    df = spark.range(100).select(F.format_string("prompt%03d", "id").alias("prompt"))
    run = lambda: generate.generate_once(df, make, path, per_call=5, callers=2, slice_rows=10)
    with pytest.raises(Exception, match="the generator is gone"):
        run()
    kept = {r.prompt_key for r in spark.read.parquet(path).collect()}
    first = open(log).read().split()
    assert 0 < len(kept) < 100
    broken.unlink()
    assert {(r.prompt, r.generated_text) for r in run().collect()} == {(f"prompt{n:03d}", f"prompt{n:03d}!") for n in range(100)}
    second = open(log).read().split()[len(first):]
    assert len(second) == 100 - len(kept) == len(set(second))


def test_a_slice_of_the_queue_opens_no_file_of_another(spark):
    prompts = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("prompt_key"), F.col("id").cast("string").alias("_prompt"))
    slices = list(generate.queue(stage(prompts, "prompts"), 20))
    files = [set(part.inputFiles()) for part in slices]
    assert len(slices) == 20 and sum(map(len, files)) == len(set().union(*files))
    assert [part.columns for part in slices] == [prompts.columns] * 20
    counts = [part.count() for part in slices]
    assert sum(counts) == 5000 and min(counts) > 150  # every prompt is read once
    assert sorted(int(r._prompt) for part in slices for r in part.collect()) == list(range(5000))
    assert list(generate.queue(prompts.where("false"), 0)) == []
    assert [part.count() for part in generate.queue(prompts, 1)] == [5000]


def test_own_tokenizer(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, prompt string")
    cut = generate.truncate_prompts(df, tokenizer=lambda: lambda t, n: " ".join(t.split()[:n]), budget=2)
    assert {r.id: r.prompt for r in cut.collect()} == {1: "a b", 2: None}
    with pytest.raises(ValueError):
        generate.truncate_prompts(df, tokenizer=lambda: lambda t, n: t, keep_suffix="Score:")
