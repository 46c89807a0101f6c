"""Arrow-batched UDFs over refsift.functions.text, and their SQL names."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as t

_MATCH = T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("passage", T.StringType())])


def _each(function, *columns):
    return pd.Series([function(*row) for row in zip(*columns)], dtype=object)


@F.pandas_udf(T.StringType())
def normalise_title(text: pd.Series) -> pd.Series:
    return _each(t.normalise_title, text)


@F.pandas_udf(T.DoubleType())
def title_similarity(claimed: pd.Series, resolved: pd.Series) -> pd.Series:
    return _each(t.title_similarity, claimed, resolved)


@F.pandas_udf(_MATCH)
def find_passage(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([t.find_passage(q, s) for q, s in zip(quote, source)], columns=["similarity", "passage"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalise_names(names: pd.Series) -> pd.Series:
    """Names without case, accents and punctuation."""
    return names.map(lambda x: None if x is None else [t.normalise_title(n) for n in x])


@F.pandas_udf(T.DoubleType())
def author_overlap(claimed: pd.Series, resolved: pd.Series) -> pd.Series:
    """For SQL; columns.author_overlap is the same as a column expression."""
    return _each(t.author_overlap, claimed, resolved)


def register(spark: SparkSession) -> None:
    """Make the text functions callable from SQL."""
    for f in (normalise_title, title_similarity, find_passage, author_overlap):
        spark.udf.register(f.__name__, f)
