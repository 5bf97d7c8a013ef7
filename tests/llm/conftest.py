import pytest

LONG = "alpha beta gamma delta " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "one two three four five six seven", "en", "src0", 5), (2, "one two three four five six seven", "en", "src1", None), (2, "one two three four five six seven", "en", "src1", None),
        (3, None, None, None, None), (4, "", "en", "src0", 0), (5, "  \n\t ", "fr", "src0", 5), (6, "tiny", "de", None, 4), (7, LONG, "en", "src0", len(LONG)), (8, LONG, "en", "src2", len(LONG)),
        (None, "no id here at all", "es", "src0", 3), (None, None, None, None, None), (9, "漢字 \U0001f642 été naïve \x00 ​", "fr", "src3", 9), (10, "12345 !!! --- 67890", "en", "src3", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = ["h", "n", "t", "s", "kept", "keep_id", "row", "id", "digest", "tokens", "cap", "epoch", "rep", "key", "component_id", "host", "line", "bucket", "whole", "family"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
