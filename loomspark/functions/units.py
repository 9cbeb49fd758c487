"""Conversion between the units that fibre data come in; others are refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: unit: (dimension, factor to SI).
UNITS = {
    "m": ("length", 1.0), "mm": ("length", 1e-3), "um": ("length", 1e-6),
    "m^2": ("area", 1.0), "mm^2": ("area", 1e-6),
    "kg/m": ("linear density", 1.0), "tex": ("linear density", 1e-6),
    "kg/m^3": ("density", 1.0), "g/cm^3": ("density", 1e3),
    "Pa": ("stress", 1.0), "MPa": ("stress", 1e6), "GPa": ("stress", 1e9),
    "/K": ("expansion", 1.0),
}


def convert(value: Column, source: Column | str, target: str) -> Column:
    """``value`` in ``target``; a unit that isn't known, or of another dimension, gives null."""
    if target not in UNITS:
        raise ValueError(f"{target} is no known unit")
    kind, to = UNITS[target]
    unit = F.lit(source) if isinstance(source, str) else source
    factor = F.lit(None).cast("double")
    for name, (dimension, f) in UNITS.items():
        if dimension == kind:
            factor = F.when(unit == name, F.lit(f)).otherwise(factor)
    return value * factor / F.lit(to)
