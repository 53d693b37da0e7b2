"""Divisions and logarithms with the result of array arithmetic: NaN where a guard fails, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def over(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NaN where the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator).when(denominator == 0, nan())


def over_positive(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else NaN."""
    return F.when(denominator > 0, numerator / denominator).when(denominator.isNotNull(), nan())


def to_db(power: Column) -> Column:
    """10 log10 of a power; NaN where it isn't positive."""
    return F.when(power > 0, 10 * F.log10(power)).when(power.isNotNull(), nan())


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)
