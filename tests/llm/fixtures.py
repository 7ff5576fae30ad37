"""Small tables that hold every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 997} and" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "a row without an id", "en", "b", 19),
    (5, " \t\n ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, "ÄÖÜ straße 日本語 😀 <|endoftext|> password = hunter22xyz", "de", "c", 50),
    (8, "x", "en", "c", 1),
]


def odd(spark, clash=False):
    df = spark.createDataFrame(ROWS, SCHEMA)
    if clash:
        for name in ("score", "predicted", "copy_no", "shuffle_key", "secrets", "fp", "component", "held_out", "key", "media", "thumb", "id", "length", "base_score", "n_tokens"):
            df = df.selectExpr("*", f"'mine' as {name}")
    return df


def none(spark):
    return spark.createDataFrame([], SCHEMA)
