import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for their own results and helpers
    T.StructField("row", T.StringType()), T.StructField("id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()), T.StructField("rank", T.IntegerType()),
])


def doc(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", 7, "y", "z", 1)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=3):
        return spark.createDataFrame(rows, DOC).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empties, ties, repeats, copies, a very long text, a hot source."""
    long_text = "Alpha beta gamma delta epsilon zeta eta theta " * 8000
    rows = [doc(0, None), doc(1, ""), doc(2, "  \t\n"), doc(3, "One"), doc(4, "ONE"), doc(5, "One two"), doc(6, long_text), doc(7, long_text.upper()), doc(8, "Çédille ÉTÉ"), doc(9, "çédille été"), doc(9, "çédille été"), doc(None, "no identifier"), doc(11, "no identifier", None), doc(12, "x" * 3000, "t")]
    rows += [doc(100 + k, f"copy {k % 4} of the same words over and over again", "hot") for k in range(120)]
    rows += [doc(300 + k, " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(k % 37)), "tuv"[k % 3], ["en", None][k % 2]) for k in range(60)]
    return rows
