"""Column functions of the searches: priors, values, PUCT, log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_value(value_sum: Column, visits: Column) -> Column:
    return F.when(visits > 0, value_sum / visits).otherwise(F.lit(0.0))


def puct(value: Column, prior: Column, parent_visits: Column, visits: Column, c_puct: float = 1.0) -> Column:
    """Value plus an exploration bonus that falls with the child's visits."""
    seen = F.sqrt(F.greatest(parent_visits, F.lit(1)).cast("double"))
    return value + F.lit(float(c_puct)) * prior * seen / (visits + F.lit(1))


def softmax(values: Column) -> Column:
    """Softmax of a short array, such as the candidates of one node."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)


def log_softmax_at(logits: Column, token: Column) -> Column:
    """Log-probability of the token (from 0) under one step's logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.get(logits, token) - top - F.log(total)


def sequence_logprob(ids: Column, logprobs: Column, eos: int) -> Column:
    """Sum of token log-probabilities up to and including the first end token."""
    at = F.array_position(ids, F.lit(eos).cast("int"))
    kept = F.when(at > 0, F.slice(logprobs, F.lit(1), at.cast("int"))).otherwise(logprobs)
    return F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)


def sequence_logprob_from_logits(ids: Column, logits: Column, eos: int) -> Column:
    """The same from one logit array per step."""
    return sequence_logprob(ids, F.zip_with(ids, logits, lambda t, z: log_softmax_at(z, t)), eos)
