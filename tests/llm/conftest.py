import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows and clashing extra columns."""
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    long = " ".join(rnd.choice(words) for _ in range(20_000))
    rows = [(k, t, "en" if k % 3 else "de", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n ", "en", None, 4), (None, texts[0], "de", "s1", 9), (103, long, "en", "s2", len(long))]
    rows += [(104, texts[1], "en", "s1", 1), (105, texts[1] + " extra", "en", "s1", 1), (106, texts[2], "en", "s2", 1), (106, texts[2], "en", "s2", 1), (None, None, None, None, None)]
    rows += [(107, long.replace("w17 ", "w18 "), "en", "s2", 1), (108, "ÄÖÜ ß é\n\nabc  def", "de", "s3", 1), (109, "12 34 %%", "en", "s3", 1)]
    d = spark.createDataFrame(rows, DOCS)
    return d.selectExpr("*", "1 AS size", "'x' AS shard", "2 AS score", "3 AS row", "4 AS n", "5 AS cls", "6 AS part").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows_of(odd_docs):
    return [tuple(r) for r in odd_docs.select("doc_id", "text", "lang", "source").collect()]
