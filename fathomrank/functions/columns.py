"""Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomrank.schema import HALF_LIFE_SECONDS, K1, B


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits; null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda t: t != "")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def has_direction(v: Column) -> Column:
    """Whether a vector can be compared by its angle: present, not empty, not zero."""
    return v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)


def ordered_sum(*order_and_value: Column) -> Column:
    """Sum of the last column over a group, in the order of the ones before it.

    Plain sums of doubles depend on how rows were shuffled; equal votes must give equal bits.
    """
    *_, value = order_and_value
    names = [c.alias(f"c{i}") for i, c in enumerate(order_and_value)]
    last = f"c{len(names) - 1}"
    return F.aggregate(F.array_sort(F.collect_list(F.struct(*names))), F.lit(0.0), lambda s, x: s + x[last])


def idf(n_docs: Column, df: Column) -> Column:
    n = F.least(df, n_docs)
    return F.log(F.lit(1.0) + (n_docs - n + F.lit(0.5)) / (n + F.lit(0.5)))


def bm25_term(weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    """A term's part of a document's score; a corpus of empty texts has norm 1."""
    size = F.when(avgdl > 0, F.lit(1.0 - B) + F.lit(B) * length / F.when(avgdl > 0, avgdl)).otherwise(F.lit(1.0))
    return weight * tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * size)


def recency(time: Column, now: Column, half_life: float = HALF_LIFE_SECONDS) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(time)) / F.lit(1e6)
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(age, F.lit(0.0)) / F.lit(float(half_life)))
