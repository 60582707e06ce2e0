
import pytest

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/out"


#: Rows that every operator on documents must take: nulls, empty and odd texts, ties, repeated rows.
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \n\t ", "fr", None),
    (6, "short one", "de", "b"),
    (7, "Short ONE", "de", "b"),
    (8, "é" * 70000 + " x", None, "b"),
    (9, "word " * 30000, "en", "a"),
    (None, "no id here at all, none", "en", "a"),
    (10, "\x00\x1c  a\x85b \U0001f600 d", "es", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns whose names operators use inside."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, n int, key string, h string, "
              "host string, n_line string, _bad string, ids string, spans string, score string, page string, gone string")
    return spark.createDataFrame([(*r, 0, 1, "k", "h", "x", "l", "b", "i", "s", "s", "p", "g") for r in ODD], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id < 0")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
