"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, component_id long, p int"
LONG = "lorem ipsum dolor " * 40_000


def documents(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, "   \t\n ", "en", None),
        (None, "a text whose id is not known", "en", "a"), (6, LONG, "en", "a"), (7, "<|endoftext|> <|im_start|> don't 123456 日本語 \U0001f600 é", "xx", "a"), (8, "one two", "en", "a"), (10, "two  spaces\n\n  and lines x ", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, 1, 2, 3) for r in rows], DOCS)


def empty(df):
    return df.where(F.lit(False))


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
