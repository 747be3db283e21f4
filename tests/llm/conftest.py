import pytest

pytest.importorskip("catchment.llm", exc_type=ImportError)

LONG = "lorem ipsum dolor sit amet " * 40_000
#: Null, empty, blank, wordless, tiny, very long, repeated rows, odd characters.
TEXTS = [(1, None), (2, ""), (3, " \t\n "), (4, "!!!"), (5, "a"), (6, LONG), (7, "the same words here again"), (7, "the same words here again"), (None, "no id here at all"), (8, "Σίσυφος İstanbul é́ <|endoftext|>\x1c\x85x"), (9, "1234567890")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([(k, x, "token_ids", 1, "s") for k, x in TEXTS], "doc_id long, text string, decoded string, n_tokens int, score string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
