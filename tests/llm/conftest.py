import random

import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd_texts():
    """Missing, empty, blank, very long and unusual texts, ties and repeated rows."""
    rng = random.Random(3)
    words = [rng.choice(["one", "two", "Three", "vier", "fünf", "🙂", "x,"]) for _ in range(30_000)]
    return [
        (10, None), (11, ""), (12, " \t\n\x0b "), (13, "one"), (14, "one  two "), (15, " lead"), (16, "tail "),
        (17, "line\n line x᠎ y"), (18, "▁mark ▁▁ x"), (19, "<s> <|endoftext|> </s>"), (20, "a\x00b c"),
        (21, "日本語のテキスト 漢字"), (22, " ".join(words)), (23, " ".join(words)), (24, "w" * 50_000),
        (13, "one"), (None, "one"), (None, None), (30, "A B c d E"), (31, "a b C D e"), (32, "spaces    many     here"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    """The odd texts as documents, with columns whose names clash with the operators' own."""
    data = [(d, t, "en", None, len(t or ""), 1, "r", 2) for d, t in odd_texts]
    return spark.createDataFrame(data, f"{DOCS}, did int, row string, spans int")
