import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    long = " ".join(f"word{i % 900} {i}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with a jar of liquid " * 4
    rows = [
        (1, None, "en"), (2, "", None), (3, "   \n\t", "en"), (4, long, "de"), (5, base, "en"), (6, base, "en"), (5, base, "en"), (7, base + "and then some more words come", "fr"),
        (None, "a row without an id that has several words", "en"), (None, None, None), (8, "one", "en"), (9, "one", "xx"), (10, "é" * 300, "es"), (11, "ab" * 400, "es"),
        (12, "<|endoftext|> marks ### $$$", "en"), (2**62, "a very large id", "en"), (-3, "a negative id", "en"), (13, long, "de"),
    ]
    names = "ids spans kept n rep key component bucket stretch text_key block shard slot level severity row word held_out registers count _key".split()
    wide = [(*r, *([0] * len(names))) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
