import pytest

pytest.importorskip("quillmark.llm")

LONG = "one very long text with words " * 20_000
TEXTS = [
    (7, "The first line of a text.\nA second line, and more."),
    (3, "The first line of a text.\nA second line, and more."),
    (3, "The first line of a text.\nA second line, and more."),
    (5, None),
    (4, ""),
    (None, "A row without an id."),
    (None, None),
    (9, " \t\r\n \n"),
    (1, LONG),
    (2, "日本語 émigré ÀÉÎ İ ǅ Σας 🎉 don't \x00\x1c\x85\xa0 <|endoftext|>!"),
    (8, "x" * 70_000),
    (-6, "0123456789 " * 300),
]
#: Names that the operators use themselves.
CLASHING = (
    "ids start length n_tokens row rank part tile key alone words line lines place h1 h2 halves near gone fp id "
    "component component_id score label x features sentence toxic_sentences quality_score toxic_score decoded _n"
).split()


@pytest.fixture(scope="session")
def documents(spark):
    rows = [(d, t, "en", "src", 0) + ("clash",) * len(CLASHING) for d, t in TEXTS]
    names = ["lang string", "source string", "n_chars long", *(f"`{c}` string" for c in CLASHING)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *names])).repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def texts():
    return TEXTS
