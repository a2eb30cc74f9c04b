import pytest
from llm_helpers import SCHEMA, SF_DIR, words


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, or from the texts alone; columns whose names clash come along."""

    def make(rows, extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(d, t, "en", None, None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("size", "shard", "row", "__row", "packet", "score", "ids", "start", "key"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(words(30000, 5))
    return [
        (1, None), (2, ""), (3, "   "), (4, "one"), (None, "no id here"), (None, None), (5, long), (6, long + " tail"),
        (7, "Ünïcode ÉCOLE 漢字 é  x\t\ty  z\n\n q"), (8, "a b c d e f g h i j k l m n o p"), (9, "a b c d e f g h i j k l m n o p"),
        (9, "a b c d e f g h i j k l m n o p"), (10, "\nlead and trail \n"), (11, "it's we'll don't 123 <|endoftext|> x"),
    ]


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
