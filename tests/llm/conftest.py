import pytest

ROWS = [
    (1, "Hello  the world\tagain\n and again", "en"),
    (2, "Hello the world again and again", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "  <|endoftext|> it's 100% ½ ²x İstanbul ßtraße _a_ don't\r\n\n  x ", "de"),
    (6, "日本語のテキスト Ω ς ΣΑΣ é \x1c a\x85b 🙂🙂 \U0001F9D1‍", "fr"),
    (7, "a b" * 9000, "en"),
    (7, "a b" * 9000, "en"),
    (None, "Hello the world again and again", "en"),
    (8, "... 12,345 !!", None),
    (9, "trailing  \n\n", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, lang, "x", t, "y") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _id string, _content string, ids string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
