import random

import pytest


def prose(r, n, vocabulary):
    return " ".join(r.choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Documents with everything odd: nulls in any column, empty, blank and very long texts, repeated rows,
    equal ids, and columns named like the operators' own."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(800)]
    shared = prose(r, 60, words)
    rows = [(i, prose(r, r.randrange(0, 120), words), "en", f"s{i % 3}", None) for i in range(120)]
    rows += [(1000 + i, f"{prose(r, 40, words)} {shared} {prose(r, 40, words)}", "de", "hot", 5) for i in range(60)]
    rows += [(2000, shared, None, None, 1), (2000, shared, None, None, 1), (2001, shared, "en", None, 1), (None, shared, "en", "x", None), (None, None, None, None, None)]
    rows += [(3000, "", "en", "x", 0), (3001, " \n\t ", "en", "x", 0), (3002, None, "fr", "x", None), (3003, "é😀 ß\x1fword", "fr", "x", 3)]
    rows += [(4000, prose(r, 60_000, words), "en", "long", 1), (4001, "x" * 200_000, "en", "long", 1), (4002, "again and " * 3000, "en", "long", 1)]
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'c' AS score", "1 AS fp", "'d' AS kind", "2 AS n_words", "3 AS _row", "4 AS ids", "5 AS `odd.name`", "6 AS component_id")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("doc_id = -1")
