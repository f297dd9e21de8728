"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, matches string, cluster long, bucket int, h1 long, spans string, tag string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old barn."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog and runs away from the old barn."),
    (7, "x"),
    (7, "x"),
    (8, "é" * 50_000),
    (9, "日本語 テスト 😀 naïve Σίσυφος \x1c\x85   end"),
    (None, "a text without an id, mail me at someone@example.org or +1 202 555 0143 99"),
    (None, None),
    (10, "1" * 5_000 + " " + "9-" * 2_000 + "9 " + "a" * 9_000 + " @ x@y"),
]


def documents(spark, texts=None):
    rows = [(i, t, "en", "s", len(t) if t else 0, 0.5, 1, "m", 2, 3, 4, "s", "t") for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
