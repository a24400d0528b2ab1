"""Small tables for the tests of the training-data operators."""

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])
VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])

#: Nulls in any column, empty and long texts, repeated rows.
AWKWARD = [
    (1, "a b c d e f", "en", "x", 11), (2, None, "en", "x", None), (3, "", None, "y", 0), (4, " \t\n\x0b\x0c\r ", "en", None, 7),
    (None, "a b c d e f", "de", "x", 11), (None, None, None, None, None), (5, "one", "fr", "y", 3), (5, "one", "fr", "y", 3),
    (6, "word " * 60_000, "en", "x", 300_000), (7, "two\n\nlines of text", "es", "z", 18), (8, "ein Wort mehr \U0001F600", "de", "z", 16),
]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)
