"""Expressions for measurements censored at a detection limit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnkit.functions.semantics import as_col, divide, if_else3, log10

# Molar masses used for nutrient ratios (g/mol).
NITROGEN_MASS = 14.0
PHOSPHORUS_MASS = 31.0
CARBON_MASS = 12.0


def detected(value, limit, inclusive: bool = False) -> Column:
    """Is the value above its limit? NULL when either is missing."""
    value, limit = as_col(value), as_col(limit)
    return value >= limit if inclusive else value > limit


def detection_label(value, limit, yes="detected", no="not_detected", inclusive: bool = False) -> Column:
    """Two labels (or two numbers) for detected and not detected; NULL stays NULL."""
    return if_else3(detected(value, limit, inclusive), F.lit(yes), F.lit(no))


def censoring(value, limit) -> Column:
    """``left`` for values at or below the limit; ``none`` for values above it and for missing values."""
    value, limit = as_col(value), as_col(limit)
    return if_else3(value.isNull() | (value > limit), F.lit("none"), F.lit("left"))


def at_least_limit(value, limit) -> Column:
    """Values below the limit are replaced by the limit."""
    value, limit = as_col(value), as_col(limit)
    return if_else3(value < limit, limit, value)


def log10_or_zero(value, limit) -> Column:
    """Log scale with values below the limit put at zero."""
    value = as_col(value)
    return if_else3(value < as_col(limit), F.lit(0.0), log10(value))


def log10_offset(value, offset: float) -> Column:
    """``log10(value + offset)``; the offset keeps zeros finite."""
    return log10(as_col(value) + F.lit(offset))


def nitrogen_phosphorus(tn_mg, tp_ug) -> Column:
    """Molar TN:TP with nitrogen in mg/L and phosphorus in µg/L."""
    return divide(as_col(tn_mg) / NITROGEN_MASS, as_col(tp_ug) / 1000.0 / PHOSPHORUS_MASS)


def carbon_nitrogen(toc_mg, tn_mg) -> Column:
    """Molar TC:TN, both in mg/L."""
    return divide(as_col(toc_mg) / CARBON_MASS, as_col(tn_mg) / NITROGEN_MASS)


def carbon_phosphorus(toc_mg, tp_ug) -> Column:
    """Molar TC:TP with carbon in mg/L and phosphorus in µg/L."""
    return divide(as_col(toc_mg) / CARBON_MASS, as_col(tp_ug) / 1000.0 / PHOSPHORUS_MASS)


def gene_copies(concentration, elution_volume, filtered_volume) -> Column:
    """Gene copies per mL of sample from an assay concentration; apply to the assay limit as well."""
    return divide(as_col(concentration) * as_col(elution_volume), filtered_volume)
