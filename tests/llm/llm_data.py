"""Small awkward inputs that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, shard string"


def words(n, seed=0, pool=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_rows():
    """Nulls everywhere, empty and very long texts, repeated rows, one key with two
    texts, ties, and extra columns whose names the operators use themselves."""
    long = words(30_000, 1)
    rows = [
        (1, words(120, 2), "en", "a", 1, True, 0.5, "x"),
        (1, words(120, 2), "en", "a", 1, True, 0.5, "x"),           # repeated row
        (1, words(90, 3), "de", "a", None, None, None, None),        # same key, other text
        (2, words(120, 2), "en", "b", 1, False, 0.1, "y"),          # equal text
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, True, 0.0, "z"),
        (5, " \t\n ", "en", "a", 3, True, 0.0, "z"),
        (6, long, "en", "a", len(long), True, 0.0, "z"),
        (7, "x" * 100_000, "fr", "a", 1, True, 0.0, "z"),            # one very long word
        (None, words(60, 4), "de", "a", 1, True, 0.0, "z"),
        (None, None, "de", "a", 1, True, 0.0, "z"),
        (8, "日本語 テキスト. Ünïcode ß \U0001F600", "ja", "a", 1, True, 0.0, "z"),
        (9, "one two three", "en", "a", 1, True, 0.0, "z"),
        (10, "a  b\n\n c\x00d\x1fe\x85f\u2028g <|endoftext|> \x01", "en", "a", 1, True, 0.0, "z"),
    ]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
