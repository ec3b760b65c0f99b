import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, `kept` int, `id` string, row int"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 4000


def passage(name: str, n: int) -> str:
    return " ".join(f"{name}{k}" for k in range(n))


#: Texts by id: copies, near copies, shared passages, empty and odd ones.
TEXTS = {
    0: passage("a", 60),
    1: passage("a", 60).replace(" ", "\n\t", 3),
    2: passage("a", 58) + " x y",
    3: "",
    4: None,
    5: passage("b", 20) + " " + passage("s", 30) + " " + passage("c", 20),
    6: passage("d", 25) + " " + passage("s", 30) + " " + passage("e", 5),
    7: "one two",
    8: "ONE two",
    9: LONG,
    10: LONG,
    11: " leading  and trailing   ",
    12: "café \U0001f600 本語 <|endoftext|> </s> ▁ tail\r\n",
    13: "\n",
    14: passage("f", 13),
    15: passage("f", 13) + " g",
}


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, repeated rows, clashing column names."""
    rows = [
        (i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), i, i, str(i), 0)
        for i, t in TEXTS.items()
    ]
    rows += [rows[0], rows[14], (None, passage("a", 60), None, None, None, None, None, None, None)]
    rows += [(5, "another text with the same id", None, "s0", 1, 1, 1, "", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3, F.rand(5))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
