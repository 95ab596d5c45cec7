"""Column functions on probabilities and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.text import search_form, words

EPS = 1e-7


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def entropy_bits(p: Column) -> Column:
    q = clipped(p)
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def margin(p: Column) -> Column:
    return 1 - 2 * F.abs(clipped(p) - 0.5)


def least_confidence(p: Column) -> Column:
    q = clipped(p)
    return 1 - F.greatest(q, 1 - q)


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-50.0)), F.lit(50.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def blend(a: Column, b: Column, weight: float) -> Column:
    return weight * a + (1 - weight) * b


def at_least(p: Column, threshold: float) -> Column:
    """Inclusive threshold, as 0 and 1."""
    return (p >= threshold).cast("int")


def edge_bin(p: Column, n_bins: int) -> Column:
    """The bin of ``p`` among equal-width, left-closed bins, by search in the literal edges; p = 1 gives n_bins."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(n_bins)], F.lit(1.0))
    return F.size(F.filter(edges, lambda e: e <= p)) - 1


def length_threshold(query: Column) -> Column:
    """0.65 for queries of up to two words of their search form, else 0.35."""
    return F.when(F.size(words(search_form(query))) <= 2, 0.65).otherwise(0.35)


def adaptive_threshold(category: Column, query: Column) -> Column:
    return F.greatest(F.lit(0.15), F.least(F.lit(0.85), 0.5 * category + 0.5 * length_threshold(query)))
