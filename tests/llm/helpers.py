"""Small tables with the cases that every operator has to stand."""

DOCS = "doc_id long, text string, fp string, row string"

ODD_DOCS = [
    (1, "The quick brown fox jumps over the lazy dog", "x", "y"),
    (1, "The quick brown fox jumps over the lazy dog", "x", "y"),
    (2, None, "x", None),
    (3, "", None, "y"),
    (None, "a text without an id but with some words in it", "x", "y"),
    (None, None, None, None),
    (4, "   \n\t \n\n", "x", "y"),
    (5, "one", "x", "y"),
    (6, "lorem ipsum dolor sit amet " * 4000, "x", "y"),
    (7, "É ü 漢字 \U0001f600 <|endoftext|> \\ <|im_end|>", "x", "y"),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD_DOCS, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
