"""Sentences on results, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def categorical(mode: str, pct: str, k: str, herfindahl: str) -> Column:
    """The commonest value, the number of values and how concentrated they are (from 0.5 and 0.25 on)."""
    spread = F.when(F.col(herfindahl) >= 0.5, "distribution très concentrée").when(F.col(herfindahl) >= 0.25, "concentration modérée").otherwise("distribution équilibrée")
    return F.format_string("Mode : « %s » (%.1f%% des observations valides) · %d modalité%s — %s.", mode, pct, k, F.when(F.col(k) > 1, "s").otherwise(""), spread)


def continuous(mean: str, std: str, median: str, cv: str) -> Column:
    """``cv`` is in percent; the bounds are 15 and 35 percent."""
    spread = F.when(F.coalesce(F.col(cv), F.lit(0.0)) == 0, "dispersion non calculable").when(F.col(cv) < 15, "faible dispersion").when(F.col(cv) < 35, "dispersion modérée").otherwise("forte dispersion")
    skew = F.when(F.abs(F.col(mean) - F.col(median)) / F.greatest(F.abs(F.col(median)), F.lit(1.0)) > 0.15, " · distribution asymétrique").otherwise("")
    return F.format_string("Moyenne %.2f (écart-type %.2f) · Médiane %.2f · %s%s.", mean, std, median, spread, skew)


def crosstab(strength: str, v: str, significance: str) -> Column:
    return F.format_string("Association %s (V de Cramér = %.3f) · %s.", strength, v, significance)


def binary_group(label: str, pct: str, k: str) -> Column:
    """The most named choice of a group."""
    return F.format_string("%d modalités proposées · Modalité la plus citée : « %s » (%.1f%%).", k, label, pct)
