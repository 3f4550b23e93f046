import itertools

from pyspark.sql import functions as F

from quillmark.catalog.bindings import packed
from quillmark.operators import extract, render
from quillmark.operators.items import append_items, number_items, validate_items
from quillmark.schemas import EVAL, ITEM, empty
from quillmark.session import new_path
from quillmark.sources import documents, stages


def exam(spark, n=40):
    """Every other item has an alternative; points with decimals; odd text."""
    return spark.createDataFrame(
        [
            ("E1", k, f"What is {k}?\nSecond line: 1{k}", f"It is {k}.", f"Or {k} + 0" if k % 2 else "", k / 4)
            for k in range(1, n + 1)
        ],
        ITEM,
    )


def answered(spark, n=40):
    """Students with 40 answers each; every fifth one is empty, some start with digits."""
    rows = [
        ("E1", f"{s:03d}", f"Ann {s}", f"Lee: {s}", k, "" if k % 5 == 0 else f"{k} {s}\n2 lines",
         f"What is {k}?", 1.0, "", "")
        for s in range(4) for k in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, EVAL)


def as_docs(papers, name):
    return papers.select(F.concat(F.lit("x/"), "exam_id", F.lit(f"/{name}.docx")).alias("path"), "text")


def test_teacher_paper_gives_back_the_items(spark, rows):
    items = exam(spark)
    docs = as_docs(render.render_teacher(items), "sample")
    assert rows(extract.extract_items(docs)) == rows(items)


def test_student_papers_give_back_the_answers(spark, rows):
    papers = render.render_answered(answered(spark))
    docs = papers.select(
        F.concat(F.lit("x/"), "exam_id", F.lit("/"), "student_id", F.lit(".docx")).alias("path"), "text"
    )
    got = rows(extract.extract_student_table(docs), "exam_id", "student_id", "surname", "q_no", "student_solution")
    expected = [
        ("E1", f"{s:03d}", f"Lee {s}", k, "" if k % 5 == 0 else f"{k} {s}\n2 lines")
        for s in range(4) for k in range(1, 41)
    ]
    assert got == sorted(expected, key=repr)


def test_number_one_is_not_the_one_of_ten(spark):
    docs = as_docs(render.render_answered(answered(spark, 12).where("student_id = '000'")), "p")
    one = extract.extract_answers(docs).where("q_no = 1").first()
    assert one.student_solution == "1 0\n2 lines"


def test_blank_paper_has_empty_answers(spark):
    docs = as_docs(render.render_student(exam(spark, 3)), "blank")
    table = extract.extract_student_table(docs).collect()
    assert [(r.q_no, r.student_solution, r.student_id) for r in table] == [(k, "", "") for k in (1, 2, 3)]


def test_broken_marks_give_null_and_keep_the_rest(spark):
    docs = as_docs(render.render_answered(answered(spark, 3).where("student_id = '001'")), "p")
    broken = docs.withColumn("text", F.replace("text", F.lit("front_P01NT5 2"), F.lit("")))
    got = {r.q_no: r.student_solution for r in extract.extract_answers(broken).collect()}
    assert got == {1: "1 1\n2 lines", 2: None, 3: "3 1\n2 lines"}


def test_last_of_two_matches_counts(spark):
    docs = as_docs(render.render_teacher(exam(spark, 2)), "t")
    twice = docs.withColumn("text", F.concat("text", F.lit("\n"), F.replace("text", F.lit("It is"), F.lit("Was"))))
    got = {r.q_no: r.sample_solution for r in extract.extract_items(twice).collect()}
    assert got == {1: "Was 1.", 2: "Was 2."}


def test_teacher_papers_are_not_counted_as_students(spark):
    docs = as_docs(render.render_teacher(exam(spark, 3)), "t")
    assert extract.count_questions(docs).first().n_questions == 0
    assert extract.extract_student_table(docs).count() == 0


def test_extraction_needs_no_shuffle_and_no_python(spark, plan_of):
    docs = spark.createDataFrame([("x/E/1.docx", "t")], "path string, text string")
    for df in (extract.extract_items(docs), extract.extract_student_table(docs)):
        assert "Exchange" not in plan_of(df) and "Python" not in plan_of(df)


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "E1"
    folder.mkdir()
    (folder / "a.docx").write_bytes(packed("one\n\n<two> & three"))
    (folder / "notes.pdf").write_bytes(b"not a paper")
    got = documents.read_documents(spark, str(tmp_path)).collect()
    assert [(r.path.split("/")[-2:], r.text) for r in got] == [(["E1", "a.docx"], "one\n\n<two> & three")]


def test_breaks_and_tabs_inside_a_paragraph():
    content = packed("x").replace(b"x", b"x")
    assert documents.paragraph_text(content) == "x"
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = (
        f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r>'
        "<w:r><w:rPr><w:vanish/></w:rPr><w:t>c</w:t><w:tab/></w:r></w:p><w:p/></w:body></w:document>"
    )
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as archive:
        archive.writestr("word/document.xml", xml)
    assert documents.paragraph_text(file.getvalue()) == "a\nbc\t\n"


def test_plain_text_papers(spark, tmp_path):
    (tmp_path / "E1").mkdir()
    (tmp_path / "E1" / "a.txt").write_text("one\ntwo")
    got = documents.read_plain_texts(spark, str(tmp_path)).first()
    assert got.path.endswith("E1/a.txt") and got.text == "one\ntwo"


def test_bundle_is_one_file_per_paper(spark, rows):
    bundle = render.render_bundle(exam(spark, 3))
    path = new_path(spark, "bundle")
    documents.write_bundle(bundle, path)
    assert rows(documents.read_bundle(spark, path)) == rows(bundle)


def test_named_papers_carry_the_names(spark):
    roster = spark.createDataFrame(
        [("E1", "7", "Ann", "Lee"), ("E1", "8", "Bo", None)],
        "exam_id string, student_id string, first_name string, surname string",
    )
    papers = render.render_student(exam(spark, 2), roster)
    docs = papers.select(F.concat(F.lit("E1/"), "student_id").alias("path"), "text")
    got = {r.student_id: (r.first_name, r.surname) for r in extract.extract_identity(docs).collect()}
    assert got == {"7": ("Ann", "Lee"), "8": ("Bo", "")}


def test_items_are_appended_to_an_empty_exam(spark, rows):
    new = spark.createDataFrame(
        [("E", 1, "q", "s", 2.0)], "exam_id string, q_no int, question string, sample_solution string, points double"
    )
    assert rows(append_items(empty(spark, ITEM), new)) == [("E", 1, "q", "s", "", 2.0)]


def test_validity_of_items(spark):
    df = spark.createDataFrame(
        [("q", "s", 0.0), ("q", "s", 1.25), ("q", "s", 0.001), ("q", "s", -1.0), ("q", " ", 1.0), (None, "s", 1.0), ("q", "s", None)],
        "question string, sample_solution string, points double",
    )
    assert [r.is_valid for r in validate_items(df).collect()] == [True, True] + [False] * 5


def test_numbering_starts_at_one_per_exam(spark, rows):
    df = spark.createDataFrame([("A", 5), ("A", 3), ("B", 9)], "exam_id string, at int")
    assert rows(number_items(df, "at")) == [("A", 3, 1), ("A", 5, 2), ("B", 9, 1)]


def broken_paper(spark, broken):
    """A paper of three answers whose question label ``broken`` is damaged."""
    rows = [("E1", "007", "Ann", "Lee", k, f"answer {k}", f"What is {k}?", 1.0, "", "") for k in (1, 2, 3)]
    docs = as_docs(render.render_answered(spark.createDataFrame(rows, EVAL)), "007")
    return docs.withColumn("text", F.replace("text", F.lit(f"Question {broken}:"), F.lit("Qu?")))


def test_a_broken_label_hides_no_answer(spark):
    for broken in (1, 2, 3):
        got = extract.extract_student_table(broken_paper(spark, broken)).collect()
        assert {r.q_no: r.student_solution for r in got} == {k: f"answer {k}" for k in (1, 2, 3)}


def test_a_mark_that_stands_twice_is_one_question(spark):
    docs = broken_paper(spark, 9)
    twice = docs.withColumn("text", F.concat("text", F.lit("\n"), "text"))
    got = extract.extract_student_table(twice).collect()
    assert sorted(r.q_no for r in got) == [1, 2, 3]
    assert extract.count_questions(twice).first().n_questions == 3


def test_one_bad_file_costs_only_itself(spark, tmp_path):
    (tmp_path / "students").mkdir()
    (tmp_path / "students" / "good.docx").write_bytes(packed(broken_paper(spark, 9).first().text))
    (tmp_path / "students" / "bad.docx").write_bytes(b"no archive")
    docs = documents.read_documents(spark, str(tmp_path))
    bad = documents.unreadable(docs).collect()
    assert [r.path.rsplit("/")[-1] for r in bad] == ["bad.docx"] and "BadZipFile" in bad[0].error
    got = extract.extract_student_table(docs, exam="physics").collect()
    assert {(r.exam_id, r.student_id, r.q_no) for r in got} == {("physics", "007", k) for k in (1, 2, 3)}


def test_a_run_leaves_nothing_behind(spark):
    from quillmark.session import run_folder

    with run_folder(spark) as folder:
        staged = stages.stage(spark.range(10), "numbers")
        assert staged.count() == 10 and staged.inputFiles()[0].removeprefix("file://").startswith(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert not new_path(spark, "x").startswith(folder)


QUESTION_LABELS = ("front_QU35T10N {k} ", "Question {k}:", "end_QU35T10N {k}")


def test_answers_outlive_any_broken_labels(spark):
    """Every set of broken question marks and labels, a paper of one question included."""
    docs, expected = [], {}
    for n in (1, 2, 3):
        text = broken_paper(spark, 9).first().text
        if n < 3:
            text = text[: text.index(f"front_QU35T10N {n + 1}")]
        for part in range(1, 8):
            for hurt in itertools.product((False, True), repeat=n):
                bad = text
                for k in (k for k, h in enumerate(hurt, 1) if h):
                    for bit, mark in enumerate(QUESTION_LABELS):
                        if part >> bit & 1:
                            bad = bad.replace(mark.format(k=k), "?")
                path = f"x/E1/{n}-{part}-{''.join(map(str, map(int, hurt)))}.docx"
                docs.append((path, bad))
                expected[path] = {k: f"answer {k}" for k in range(1, n + 1)}
    docs = spark.createDataFrame(docs, "path string, text string")
    got = {}
    for r in extract.extract_answers(docs).collect():
        got.setdefault(r.path, {})[r.q_no] = r.student_solution
    assert got == expected
    names = extract.extract_student_table(docs).select("student_id", "first_name", "surname").distinct().collect()
    assert [tuple(r) for r in names] == [("007", "Ann", "Lee")]


def test_a_field_without_its_closing_mark_swallows_nothing(spark):
    """The paper stands twice in the text, and the first time the points' front mark of question 2 is broken."""
    text = broken_paper(spark, 9).first().text
    first = text.replace("front_P01NT5 2", "")
    docs = spark.createDataFrame([("x/E1/a.docx", first + "\n" + text), ("x/E1/b.docx", first)], "path string, text string")
    got = {(r.path[-6], r.q_no): r.student_solution for r in extract.extract_answers(docs).collect()}
    assert got == {("a", 1): "answer 1", ("a", 2): "answer 2", ("a", 3): "answer 3", ("b", 1): "answer 1", ("b", 2): None, ("b", 3): "answer 3"}
    kept = {(r.path[-6], r.q_no): r.student_solution for r in extract.extract_answers(docs, keep_unclosed=True).collect()}
    assert kept == {(p, k): f"answer {k}" for p in "ab" for k in (1, 2, 3)}


def test_a_broken_field_of_an_item_costs_only_itself(spark):
    text = render.render_teacher(exam(spark, 2)).first().text
    fields = {"question": "front_4N5W3R 1", "sample_solution": "front_41T 1", "alternative_solution": "front_P01NT5 1", "points": "end_P01NT5 1"}
    for name, mark in fields.items():
        docs = spark.createDataFrame([("x/E1/t.docx", text.replace(mark, ""))], "path string, text string")
        whole = {r.q_no: r.asDict() for r in exam(spark, 2).collect()}
        got = {r.q_no: r.asDict() for r in extract.extract_items(docs).collect()}
        whole[1][name] = "" if name == "alternative_solution" else None
        assert got == whole


def test_odd_papers(spark):
    docs = spark.createDataFrame(
        [("x/E/1", None), ("x/E/2", ""), ("x/E/3", "no marks"), ("x/E/4", "end_4N5W3R 1"), ("x/E/5", "end_4N5W3R 1a front_P01NT5 1"),
         ("x/E/6", "end_4N5W3R 12345678901 a front_P01NT5 12345678901"), ("x/E/7", "end_4N5W3R 0 a front_P01NT5 0")],
        "path string, text string",
    )
    assert [tuple(r)[1:] for r in extract.extract_answers(docs).collect()] == [("x/E/4", 1, None), ("x/E/5", 1, "a")]
    assert extract.extract_identity(docs).where("student_id IS NULL").count() == 7


def test_a_paper_is_scanned_once(spark, plan_of):
    docs = spark.createDataFrame([("x/E/1.docx", "t")], "path string, text string")
    for df in (extract.extract_items(docs), extract.extract_student_table(docs), extract.extract_answers(docs)):
        assert plan_of(df).count(f"split(coalesce(text") == 1
