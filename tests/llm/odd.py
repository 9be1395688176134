"""Rows that every operator on documents has to take."""

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (None, "a row without an id"),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\f\r "),
    (4, "one"),
    (5, "One TWO three"),
    (6, "ein Wörtchen naïve   日本語 \U0001f600 \x00 \x1c end"),
    (7, LONG),
    (8, LONG),
    (9, "x" * 50_000),
    (9, "the same id with another text"),
    (10, "the very same row twice"),
    (10, "the very same row twice"),
]


def documents(spark, more=()):
    """The odd rows and more, with columns whose names operators also use."""
    rows = [(i, t, "en", "s", 1, 2, "x") for i, t in [*ODD, *more]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_hit int, spans string")


def empty(spark):
    return documents(spark).where("false")
