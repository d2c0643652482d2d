"""Operators that the device's documentation describes: perfusion, oxygen saturation, display classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plethora.operators.cleaning import ratio


def perfusion_index(value: str, over: WindowSpec) -> Column:
    return ratio(F.max(value).over(over) - F.min(value).over(over), F.avg(value).over(over)) * 100


def oxygen_saturation(red_pi: Column, infrared_pi: Column) -> Column:
    """110 - 25 R; NULL outside 70 to 100."""
    s = 110 - 25 * ratio(red_pi, infrared_pi)
    return F.when(s.between(70, 100), s)


def display_class(quality: Column) -> Column:
    return F.when(quality >= 0.7, "good").when(quality >= 0.4, "fair").otherwise("poor")
