"""Scalar helpers over doubles where null is the only kind of 'missing'."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and both infinities become null."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INFINITY)), c)


def to_number(c: Column | str) -> Column:
    """Text or number to a finite double; anything unreadable becomes null."""
    return finite(_col(c).try_cast("double"))


def row_sum(columns: list) -> Column:
    """Sum over columns; null only when every member is null."""
    cols = [_col(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


def row_mean(columns: list) -> Column:
    cols = [_col(c) for c in columns]
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, row_sum(cols) / present)


def row_first(columns: list) -> Column:
    return F.coalesce(*[_col(c) for c in columns])


def combine(columns: list, method: str) -> Column:
    """Row-wise merge of several sources of one field."""
    rules = {"sum": row_sum, "mean": row_mean, "first": row_first}
    if method not in rules:
        raise ValueError(f"unknown combine method {method!r}")
    return rules[method](columns)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is null, not an error, on a zero denominator."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d != 0, n / d)


def at_least(c: Column | str, low) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def at_most(c: Column | str, high) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def ape_official(y_true: Column | str, y_pred: Column | str) -> Column:
    """|y - p| / |y| without any floor: y = 0 gives infinity, 0/0 gives NaN."""
    y, p = _col(y_true), _col(y_pred)
    miss = F.abs(y - p)
    at_zero = F.when(miss == 0, F.lit(float("nan"))).otherwise(F.lit(INFINITY))
    return F.when(y == 0, at_zero).otherwise(miss / F.abs(y))


def ape_floor(y_true: Column | str, y_pred: Column | str, floor: float = 1e-6) -> Column:
    """|y - p| / max(|y|, floor): the loss every selection step uses."""
    y, p = _col(y_true), _col(y_pred)
    return F.abs(p - y) / F.when(y.isNotNull(), F.greatest(F.abs(y), F.lit(floor)))


def mape_weight(y: Column | str, floor: Column | float, age: Column | None = None,
                half_life: float | None = None) -> Column:
    """Unnormalised weight 1/max(|y|, floor), optionally halved every ``half_life`` of age."""
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    weight = 1.0 / F.greatest(F.abs(_col(y)), floor)
    if age is not None and half_life:
        weight = weight * F.pow(F.lit(0.5), age / F.lit(float(half_life)))
    return weight
