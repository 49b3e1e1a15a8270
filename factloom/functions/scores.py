"""Label scores: softmax, decision, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logs: Column) -> Column:
    """Array of log weights -> array of shares that add up to 1."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def valid(scores: Column) -> Column:
    """Whether an array of scores is a distribution: finite, from 0 to 1, of sum 1."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return (F.size(scores) > 0) & F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)) & (F.abs(total - 1) <= 1e-6)


def decide(labels: Column, scores: Column, threshold: float) -> Column:
    """The label of the highest score, the first of equals, if it reaches the threshold; else ABSTAIN."""
    best = F.array_max(scores)
    return F.when(best >= threshold, F.get(labels, F.array_position(scores, best).cast("int") - 1)).otherwise("ABSTAIN")
