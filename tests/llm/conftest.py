import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, body string, size long, key string, hash string, node string, "
    "spans string, words string, copies long, n long, rid long, target double, found string, scores string, new string, s string, z long, "
    "copy string, hit_id string, plan_id string, place string"
)
PROSE = "\n".join(f"line {i} of a plain text that says nothing of note {i * i}" for i in range(12))
LONG = "word" * 20_000 + " " + "7" * 30_000 + "@" + "f" * 30_000 + " " + " ".join(f"w{i}" for i in range(4_000)) + "\n" * 500 + "é😀" * 2_000


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty, blank, very long, repeated and tied rows, characters beyond ASCII."""
    return [
        (None, None, None, None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\x0b ", "en", None), (4, LONG, "en", "b"), (5, PROSE, "en", "a"),
        (5, PROSE, "en", "a"), (6, PROSE, "en", "a"), (7, PROSE, "en", None), (None, PROSE, "fr", "c"), (8, "Ünïcödé 😀 text ÉTÉ", "fr", "c"), (9, "one", "en", "d"),
        (10, PROSE.replace("plain", "clear", 1), "en", "a"), (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """A table with the columns of documents, further columns whose names operators might use themselves, and awkward rows."""
    extra = ("x", "x", 1, "x", "x", "x", "x", "x", 1, 1, 1, 1.0, "x", "x", "x", "x", 1, "c", "x", "x", "x")
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *extra) for r in texts()], COLUMNS).cache()


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 1), (9, None, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, "line 3 of a PLAIN text that says nothing of note"), (2, "one"), (3, None), (4, ""), (None, "says nothing of note 9 line"), (2, "one"), (5, "absent words " * 9)]
    return spark.createDataFrame(rows, "item_id long, text string")
