import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, block long"


def documents():
    """Small tables' every case: nulls, empties, ties, repeated rows, long texts, clashing column names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("aeioutnrs", k=rng.randint(2, 8))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(30)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in texts[3].split()) for _ in range(4)]
    texts += [None, "", " \t\n ", "one", "ONE", "12 34 ??", "漢字 かな العربية é", "a b\x00c", "x" * 3000, " ".join(vocabulary * 40), texts[3], texts[3].upper(), *near, f"first {passage} end", f"other {passage} tail {passage}", "call +1 (988) 555-2485 or a.b@c.example 10.0.0.1", "Released under the MIT License."]
    rows = [(i, t, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[1], None, None, 3, 1, 2), (None, None, "en", "s0", None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
