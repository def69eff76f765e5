"""Scalar functions of training and evaluation as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A logit's clip, the least factor of a focal loss.
CLIP, LEAST_FACTOR = 1e-6, 1e-7
SCHEDULES = ("linear", "cosine", "constant_with_warmup")
LOSSES = ("bce", "focal")


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow for large negative x."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column) -> Column:
    """The log odds of a probability, clipped to [1e-6, 1 - 1e-6]."""
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return F.log(q / (1 - q))


def platt(p: Column, a: float, b: float) -> Column:
    """A Platt calibrator's probability."""
    return sigmoid(a * logit(p) + b)


def isotonic(p: Column, xs: list[float], ys: list[float]) -> Column:
    """A piecewise linear calibrator's probability: between two knots on the line through them, beyond the ends the end's value. The knots are a fitted model, found by binary search over a literal array in the JVM."""
    if len(xs) != len(ys) or not xs:
        raise ValueError("an isotonic calibrator needs as many values as knots, and one at least")
    knots = F.array(*[F.lit(float(x)) for x in xs])
    values = F.array(*[F.lit(float(y)) for y in ys])
    at = F.size(F.filter(knots, lambda x: x <= p))  # knots at or below p
    low, high = F.get(knots, at - 1), F.get(knots, at)
    y0, y1 = F.get(values, at - 1), F.get(values, at)
    line = y0 + (y1 - y0) * (p - low) / (high - low)
    return F.when(p.isNull() | F.isnan(p), None).when(at == 0, ys[0]).when(at == len(xs), ys[-1]).otherwise(line)


def blend(p: Column, rule: Column, boost: float = 0.15) -> Column:
    """A probability raised by ``boost`` where a rule score is above 0, kept within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p + F.when(rule > 0, F.lit(boost)).otherwise(F.lit(0.0))))


def binary_cross_entropy(x: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Weighted cross-entropy of a logit x and a target y of 0 or 1."""
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return F.when(y == 1, F.lit(float(pos_weight))).otherwise(1.0) * bce


def focal_loss(x: Column, y: Column, gamma: float, pos_weight: float = 1.0) -> Column:
    """Focal loss of a logit; gamma 0 is weighted cross-entropy, a negative gamma is refused."""
    if gamma < 0:
        raise ValueError("gamma must not be negative")
    right = sigmoid(F.when(y == 1, x).otherwise(-x))
    return F.pow(F.greatest(1 - right, F.lit(LEAST_FACTOR)), F.lit(float(gamma))) * binary_cross_entropy(x, y, pos_weight)


def loss(name: str, x: Column, y: Column, pos_weight: float = 1.0, gamma: float = 2.0) -> Column:
    """A loss by its name."""
    if name not in LOSSES:
        raise ValueError(f"a loss is one of {LOSSES}")
    return binary_cross_entropy(x, y, pos_weight) if name == "bce" else focal_loss(x, y, gamma, pos_weight)


def learning_rate(name: str, step: Column, total: int, warmup_ratio: float, base: float = 1.0) -> Column:
    """The learning rate of a step from 0: it rises from 0 over the first int(total * warmup_ratio) steps, then falls to 0 on a line or half a cosine, or stays."""
    if name not in SCHEDULES:
        raise ValueError(f"a schedule is one of {SCHEDULES}")
    total = max(1, total)
    warm = int(total * warmup_ratio)
    rise = step / F.lit(float(max(1, warm)))
    done = (step - warm) / F.lit(float(max(1, total - warm)))
    fall = {"linear": F.greatest(F.lit(0.0), 1 - done), "cosine": F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * done))), "constant_with_warmup": F.lit(1.0)}[name]
    return base * F.when(step < warm, rise).otherwise(fall)


def uniform(seed: int, *keys: Column) -> Column:
    """A number of [0, 1) that depends on the seed and the keys only: the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def preview(c: Column, most: int = 300) -> Column:
    """A value's text, cut after ``most`` characters with a mark that it was."""
    t = c.cast("string")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most)), F.lit(" ...")))


def scalar_fields(payload: Column) -> Column:
    """The fields of a JSON object that are texts, numbers, truth values or null, as a map of texts; null for anything else."""
    keys = F.json_object_keys(payload)
    v = F.try_parse_json(payload)
    as_map = F.try_variant_get(v, "$", "map<string,variant>")
    kept = F.map_filter(as_map, lambda _, x: ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"))
    return F.when(keys.isNotNull(), F.transform_values(kept, lambda _, x: F.try_variant_get(x, "$", "string")))


def coerced_list(v: Column) -> Column:
    """A VARIANT as a list of trimmed texts without blank ones: arrays entry by entry, another value as one entry, null as none."""
    from siltworks.functions.text import trimmed

    items = F.try_variant_get(v, "$", "array<string>")
    one = F.array(F.try_variant_get(v, "$", "string"))
    kind = F.schema_of_variant(v)
    entries = F.when(kind.startswith("ARRAY"), items).when(kind.isNull() | (kind == "VOID") | kind.startswith("OBJECT"), F.array().cast("array<string>")).otherwise(one)
    return F.coalesce(F.filter(F.transform(entries, trimmed), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
