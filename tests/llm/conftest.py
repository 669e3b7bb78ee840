import pytest

#: What texts can be: null, empty, white space, ties and repeats, long, beyond ASCII.
ODD = [
    None, "", " ", "\n\n", "a", "The same text, twice over.", "The same text, twice over.", "word " * 3000, "x" * 5000,
    "Ünïcödé — 𝔘𝔫𝔦 ½ Ⅷ    don't we'll 12345", "<|endoftext|> a<|endoftext|>b", "tab\tand\x0bother\x1fspace", "é" * 40,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with columns whose names operators use themselves, and one row twice."""
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 3}", None if i % 4 == 0 else "en", i, "clash", 0.5) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string, lang string, size long, word string, part double")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
