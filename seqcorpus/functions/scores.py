"""Functions on per-position score arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax_tag(logits: Column) -> Column:
    """0-based index of the first largest score."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def _exp_sum(logits: Column, top: Column) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))


def log_normalizer(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    return top + F.log(_exp_sum(logits, top))


def tag_prob(logits: Column) -> Column:
    """Probability of the best tag."""
    return F.lit(1.0) / _exp_sum(logits, F.array_max(logits).cast("double"))


def tag_loss(
    logits: Column,
    gold: Column,
    smoothing: float = 0.0,
    exp_smoothing: bool = False,
    one_sided: bool = False,
) -> Column:
    """Per-position cross entropy against tag ``gold``, with the three smoothing forms."""
    norm = log_normalizer(logits)
    entropy = norm - F.get(logits, gold).cast("double")
    if smoothing == 0.0:
        return entropy
    shift = F.log(F.lit(1.0 - smoothing))
    if exp_smoothing:
        moved = entropy + shift
        return F.greatest(moved, F.lit(0.0)) if one_sided else moved * moved
    # The other tags share the smoothing mass evenly.
    other = F.lit(smoothing) / (F.size(logits) - 1)
    mean_all = F.aggregate(logits, F.lit(0.0), lambda a, x: a + x.cast("double"))
    picked = F.get(logits, gold).cast("double")
    return (1.0 - smoothing) * entropy + other * ((F.size(logits) - 1) * norm - (mean_all - picked))
