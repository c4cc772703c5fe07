"""Column expressions of the survey operators. All stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that Unicode decomposes to a letter and marks (U+0300 to U+036F), and that letter.
_split = [(chr(c), d[0]) for c in range(0xC0, 0xD800) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all("\u0300" <= m <= "\u036f" for m in d[1:])]
MARKED, PLAIN = ("".join(x) for x in zip(*_split, strict=True))
# The type suffixes of coded names.
SUFFIXES = "B|X|1Y|1M|1W|1D|1H|1U|1|2K|2T|2L|2S|2|Z|A|SRC"
Z95 = 1.959963984540054


def quoted(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def number(c: Column) -> Column:
    """The value as a double, null where it is none or NaN."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole; null where whole is null or 0."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval in percent, unrounded; null where n is 0."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p, z2 = k / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.greatest(F.lit(0.0), (centre - half) / scale) * 100, F.least(F.lit(1.0), (centre + half) / scale) * 100


def status(received: Column, target: Column, floor: Column | bool = False) -> Column:
    """zero, suivi, en_cours, cible or verifier. A floor form is ``cible`` for any submission, even below its floor."""
    floor = F.lit(floor) if isinstance(floor, bool) else floor
    none = F.coalesce(received, F.lit(0)) == 0
    return (
        F.when(none, "zero").when(F.coalesce(target, F.lit(0)) == 0, "suivi").when(floor, "cible")
        .when(received >= 2 * target, "verifier").when(received >= target, "cible").otherwise("en_cours")
    )


def tracker_status(count: Column, target: Column) -> Column:
    return F.when(count.isNull(), "inconnu").when(F.coalesce(target, F.lit(0)) == 0, "suivi").when(count <= 0, "zero").when(count >= target, "cible").otherwise("en_cours")


def reached_band(share: Column) -> Column:
    """The band of a share of districts that reached their target."""
    return F.when(share.isNull(), None).when(share >= 100, "cible").when(share >= 50, "en-cours").otherwise("verifier")


def risk(share: Column) -> Column:
    return F.when(share >= 95, "faible").when(share >= 80, "moyen").otherwise("élevé")


def normality(skew: Column, kurt: Column) -> Column:
    return (
        F.when((F.abs(skew) <= 0.5) & (F.abs(kurt) <= 1.0), "Normale").when(skew > 1.0, "Asymétrie positive forte")
        .when(skew < -1.0, "Asymétrie négative forte").when(F.abs(skew) <= 1.0, "Légèrement asymétrique").otherwise("Distribution non normale")
    )


def adjusted_skewness(c: Column) -> Column:
    """Sample skewness with the small-sample correction; null under 3 values."""
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))


def adjusted_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction; null under 4 values."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def label_from_code(c: Column) -> Column:
    """The readable part of a coded name: before ``__``, after the last ``/``, underscores as spaces."""
    return F.trim(F.replace(F.substring_index(F.substring_index(c, "__", 1), "/", -1), F.lit("_"), F.lit(" ")))


def radical(c: Column) -> Column:
    """The radical of a coded name; the name itself where it has no known suffix."""
    return F.when(c.rlike(rf"^.+?__({SUFFIXES})"), F.regexp_extract(c, rf"^(.+?)__({SUFFIXES})(.*)$", 1)).otherwise(c)


def code_type(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, rf"^(.+?)__({SUFFIXES})(.*)$", 2), F.lit(""))


def unmarked(c: Column) -> Column:
    """Letters without their marks, composed or decomposed."""
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), "[\u0300-\u036f]", "")


def sanitized(c: Column) -> Column:
    """A form field's name: marks stripped, other characters as one underscore, 63 characters, ``field`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(unmarked(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9_]", "_"), "_+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 63)
    return F.when(s == "", "field").otherwise(s)


def form_name(c: Column) -> Column:
    """The form field's name of a coded name; a leading digit gets ``q_``."""
    s = F.regexp_replace(F.replace(c, F.lit("__"), F.lit("_")), "[^a-zA-Z0-9_]", "")
    return F.when(s.rlike("^[a-zA-Z]"), F.substring(s, 1, 63)).otherwise(F.concat(F.lit("q_"), F.substring(s, 1, 61)))


def normal_name(c: Column) -> Column:
    """A unit's name without its type in brackets (one level of nesting), single spaces, upper case."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s*\([^()]*(\([^()]*\))?[^()]*\)\s*$", "")), r"\s+", " "))


def unit_type(label: Column) -> Column:
    u = F.upper(label)
    return F.when(u.contains("CSR-DM"), "CSR-DM").when(u.contains("CSR-D") | u.rlike(r"\bCSR\b"), "CSR-D").when(u.contains("EPH"), "EPH").when(u.contains("CSU"), "CSU")


def unit_type_target(label: Column) -> Column:
    kind = unit_type(label)
    return F.when(kind == "CSR-DM", 2).when(kind == "CSR-D", 1).when(kind.isin("EPH", "CSU"), 3).otherwise(1)


def gps(c: Column) -> Column:
    """struct(lat, lon) of ``lat lon alt prec``, ``lat,lon`` or ``[lat, lon]``, 6 digits; null where it is none or out of range."""
    parts = F.filter(F.split(F.regexp_replace(F.trim(c), r"[\[\],;]", " "), r"\s+"), lambda x: x != "")
    lat, lon = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")))


def duration_text(seconds: Column) -> Column:
    """``7 min 05 s``, from an hour on ``1 h 05 min``; null unless positive."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds > 0, F.when(minutes < 60, F.format_string("%d min %02d s", minutes, F.floor(seconds) % 60)).otherwise(F.format_string("%d h %02d min", F.floor(minutes / 60), minutes % 60)))


def moments(c: Column) -> list[Column]:
    """n, mean, standard deviation and adjusted shape of a numeric column."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), adjusted_skewness(c).alias("skew"), adjusted_kurtosis(c).alias("kurt")]
