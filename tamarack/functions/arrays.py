"""Array and arithmetic functions of encoding and training."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(ids: Column, length: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention(ids: Column, length: int) -> Column:
    """1 for each id, 0 for each place of padding."""
    return F.slice(F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), length)), 1, length)


def before(values: Column, stop) -> Column:
    """The values before the first ``stop``, all of them where there is none."""
    at = F.array_position(values, F.lit(stop))
    return F.when(at > 0, F.slice(values, F.lit(1), (at - 1).cast("int"))).otherwise(values)


def unique(values: Column) -> Column:
    return F.array_distinct(values)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def log_softmax(logits: Column) -> Column:
    """The largest logit and the sum are each worked out once for an array, not once for each of its items."""
    def shifted(most: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
        return bound(most + F.log(total), lambda all_: F.transform(logits, lambda x: x - all_))

    return F.when(F.size(logits) > 0, bound(F.array_max(logits), shifted)).otherwise(logits)


def causal_mask(length: int) -> Column:
    """For each place a row of 1 up to itself and 0 beyond it."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: (j <= i).cast("int")))


def activated(values: Column) -> Column:
    return F.transform(values, F.tanh)


def smoothed_loss(log_probs: Column, target: Column, smoothing: float) -> Column:
    """Cross entropy against a target that keeps 1 - smoothing and gives the rest to the others in equal parts."""
    hit = F.element_at(log_probs, target + 1)
    rest = F.aggregate(log_probs, F.lit(0.0), lambda acc, x: acc + x) - hit
    return -((1 - smoothing) * hit + smoothing / (F.size(log_probs) - 1) * rest)


def active(log_probs_and_targets: Column, mask: Column) -> Column:
    """The items whose mask, shifted by one place, isn't 0."""
    return F.filter(log_probs_and_targets, lambda _, i: F.element_at(mask, i + 2) != 0)


def scaled_loss(losses: Column, mask: Column) -> Column:
    """struct(length, loss): how many tokens are active, and their mean loss times that number."""
    return bound(active(losses, mask), lambda kept: F.struct(F.size(kept).alias("length"), F.coalesce(F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)).alias("loss")))


def schedule(step: Column, total: int, share: float = 0.1) -> Column:
    """Learning-rate factor: linear up over the first share of the steps, then linear down to 0."""
    warm = int(total * share)
    return F.when(step < warm, step / F.lit(max(1, warm))).otherwise(F.greatest(F.lit(0.0), (total - step) / F.lit(max(1, total - warm))))


def total_steps(batches: int, accumulated: int, epochs: int) -> int:
    return batches // accumulated * epochs


def decays(name: Column) -> Column:
    """Parameters that weight decay applies to."""
    return ~name.rlike(r"bias|LayerNorm\.weight")


def is_random_model(kind: Column) -> Column:
    return kind.startswith("random-")


def summarised(uids: list[int]) -> str:
    """Up to three in full, else the first two and the last."""
    uids = sorted(uids)
    return "{" + (", ".join(map(str, uids)) if len(uids) <= 3 else f"{uids[0]}, {uids[1]}, ..., {uids[-1]}") + "}"
