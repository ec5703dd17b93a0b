import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

# columns whose names an operator uses itself
CLASHING = "key string, node long, n int, size int, row string, w string, label string, part int, hit string, ll int, target double, id long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing columns."""
    long = " ".join(f"word{i % 7919} of the long text" for i in range(40_000))
    rows = [
        (1, "the cat sat on the mat and looked at the other cat in the house of the man", "en", "a"),
        (1, "the cat sat on the mat and looked at the other cat in the house of the man", "en", "a"),
        (2, "the cat sat on the mat and looked at the other cat in the house of the man", "en", None),
        (3, None, "en", "a"),
        (4, "", "en", "b"),
        (5, " \n\t ", None, "b"),
        (6, long, "en", "b"),
        (None, "Der Hund und die Katze sind in dem Haus, und der Mann ist auf der Straße.", "de", "c"),
        (None, None, None, None),
        (7, "one two", "xx", "c"),
        (8, "ONE  two", "fr", "c"),
        (9, "a<|endoftext|>b  ▁c \U0001f600 中文\r\n", "fr", "c"),
    ]
    return spark.createDataFrame(
        [(*r, 0, "k", 1, 1, 1, "r", "w", "l", 1, "h", 1, 1.0, 1) for r in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}",
    )


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path
