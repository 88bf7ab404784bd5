"""Name similarities that Spark has no function for, as Arrow UDFs; apply them to distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nomen.functions.columns import free_name, split_name

SIMILAR = 0.6


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null with a null side."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: str | Column, b: str | Column) -> Column:
    """At least ``name_ratio``: twice the letters in common, whatever their order, over both lengths; 1 for two empty names."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1))))
    count = lambda name, c: F.length(name) - F.length(F.replace(name, c, F.lit("")))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@F.pandas_udf(T.DoubleType())
def word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - word edit distance / longer length; 1 for equal (also empty) word lists; null with a null side."""
    out = []
    for x, y in zip(a, b):
        d = None if x is None or y is None else edit_distance(list(x), list(y))
        out.append(None if d is None else 1.0 if d == 0 else 1 - d / max(len(x), len(y)))
    return pd.Series(out, dtype="float64")


def register(spark: SparkSession) -> None:
    spark.udf.register("name_ratio", name_ratio)
    spark.udf.register("word_similarity", word_similarity)


def _once(pairs: DataFrame, a: str, b: str, value: Column, out: str) -> DataFrame:
    """``pairs`` with a value of columns a and b that is computed once per distinct pair."""
    left, right = (free_name([*pairs.columns, out], name) for name in ("_left", "_right"))
    once = pairs.select(a, b).distinct().select(F.col(a).alias(left), F.col(b).alias(right), value.alias(out))
    return pairs.join(once, F.col(a).eqNullSafe(F.col(left)) & F.col(b).eqNullSafe(F.col(right)), "left").drop(left, right)


def with_ratio(pairs: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    return _once(pairs, a, b, name_ratio(a, b), out)


def with_similar_ratio(pairs: DataFrame, a: str, b: str, least: float = SIMILAR, out: str = "ratio") -> DataFrame:
    """As ``with_ratio``, but pairs that cannot reach ``least`` never go to Python: their ratio is their bound, which is less."""
    bound, taken = ratio_bound(a, b), [*pairs.columns, out]
    left, right, most = (free_name(taken, name) for name in ("_left", "_right", "_bound"))
    once = pairs.select(a, b).distinct().select(F.col(a).alias(left), F.col(b).alias(right), bound.alias(most))
    near = once.where((F.col(most) >= least) | F.col(most).isNull()).select(left, right, name_ratio(left, right).alias(out))
    far = once.where(F.col(most) < least).select(left, right, F.col(most).alias(out))
    both = near.unionByName(far)
    return pairs.join(both, F.col(a).eqNullSafe(F.col(left)) & F.col(b).eqNullSafe(F.col(right)), "left").drop(left, right)


def with_name_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    return _once(pairs, a, b, word_similarity(split_name(a), split_name(b)), out)
