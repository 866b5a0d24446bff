"""Message records: parsing, retweets, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import text as X

#: Fields of a message line that operators use; a line's other fields stay in ``raw``.
MESSAGE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("user", T.LongType()), T.StructField("lang_det", T.StringType()),
    T.StructField("retweeted_status", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tok_lang", T.StringType()),
    T.StructField("analysis", T.StructType([T.StructField("tokens", T.StructType([T.StructField("all", T.ArrayType(T.StringType())), T.StructField("unprotected", T.ArrayType(T.StringType()))]))])),
])


def parse_lines(lines: DataFrame, raw: str = "raw", schema: T.StructType = MESSAGE) -> DataFrame:
    """One column for each field of ``schema`` beside ``raw``; broken lines, cut-off ones too, give no row.

    Works alike on batches and streams. Control characters within strings are allowed.
    """
    strict = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_m", F.from_json(F.col(raw), strict, options)).where(F.col("_m").isNotNull() & F.col("_m._corrupt").isNull())
    return parsed.select(raw, *[F.col(f"_m.{f.name}").alias(f.name) for f in schema.fields]).where(F.coalesce(*[F.col(f.name).isNotNull().cast("int") for f in schema.fields]) >= 0)


def is_retweet(text: Column, quoted_text: Column) -> Column:
    """Whether a message only passes on another: the platform says so, or its text quotes one."""
    return F.coalesce(quoted_text, X.quoted(text), F.lit("")) != ""


def drop_retweets(df: DataFrame) -> DataFrame:
    """Messages with a text that don't pass on another."""
    return df.where(F.col("text").isNotNull() & ~is_retweet(F.col("text"), F.col("retweeted_status.text")))


def first_occurrences(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """(key, first): the least ``order_col`` of each key. Null keys drop out. Partial minima, so a hot key is no burden."""
    return df.select(key.alias("key"), F.col(order_col).alias("o")).where("key is not null and o is not null").groupBy("key").agg(F.min("o").alias("first"))


def dedup_messages(df: DataFrame, order_col: str = "ord") -> DataFrame:
    """(key, first) over the messages that aren't retweets and have tokens."""
    rows = drop_retweets(df).select(order_col, F.col("analysis.tokens.unprotected").alias("t")).where("t is not null")
    return first_occurrences(rows, X.dedup_key(F.col("t")), order_col)
