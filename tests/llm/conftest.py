import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BIG = 2**60 + 1
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the night falls on the quiet river bank today.", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", "fr", None, 0),
    (4, " \n\t\x0b ", None, "a", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x" * 20_000, "en", "b", 20_000),
    (7, "same text " * 30, "en", "b", 300),
    (7, "same text " * 30, "en", "b", 300),
    (8, "same text " * 30, "en", "b", 300),
    (None, "no id here but some words", "en", "a", 3),
    (BIG, "12 34 !? ▁ literal \U0001f600", "de", "c", None),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, repeated rows, ties, large ids, columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "n_chars")
    for name in ("_d", "_h", "d", "h", "n", "rank", "gone", "_row", "_text", "_s", "_host", "score", "lang_pred", "signature", "length", "first", "component_id", "digest", "a.b"):
        df = df.withColumn(name, F.lit(name))
    return df
