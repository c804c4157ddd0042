"""Small tables for the corpus operators."""

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and odd texts, ties, repeated rows, long texts and extra columns."""
    base = " ".join(f"word{k % 97}x{k // 3}" for k in range(300))
    near = base.replace("word5x1", "changed")
    rows = [
        (1, base, "en", 0),
        (2, base, "en", 1),
        (3, near, "en", 2),
        (4, None, None, 3),
        (5, "", "de", 4),
        (6, " \t\n ", "de", 5),
        (7, "one two three", "de", 6),
        (8, "ONE two three", "en", 7),
        (9, "Grüße aus Köln\nein zwei drei vier fünf sechs\n<|endoftext|> ende", "de", 8),
        (10, "a\nein zwei drei vier fünf sechs\nb  c\r\n d", "de", 9),
        (10, "a\nein zwei drei vier fünf sechs\nb  c\r\n d", "de", 9),
        (None, "no name for this one here", "en", 10),
        (11, "x" * 5000 + " " + "y z " * 4000, "en", 11),
        (12, "日本語のテキスト \x1c odd\x85gap  here", "xx", 12),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id < 0")
