"""Column functions for sound levels: decibels are added and averaged as energy, and missing is never silence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NODATA = -96.0
BREAKS = (40, 45, 50, 55, 60, 65, 70)
WORDS = ("Very quiet", "Quiet", "Fairly quiet", "Moderate", "Noticeable", "Loud", "Very loud", "Extremely loud")
WHO_LIMITS = {("road", "Lden"): 53, ("road", "Lnight"): 45, ("rail", "Lden"): 54, ("rail", "Lnight"): 44, ("aircraft", "Lden"): 45, ("aircraft", "Lnight"): 40}
CLASS_OUTSIDE, CLASS_NODATA, CLASS_BELOW, CLASS_FIRST = 0, 1, 2, 3
CODE_NODATA, CODE_BELOW, CODE_VALUE0 = 1, 2, 3


def db_to_energy(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 10.0)


def energy_to_db(energy: Column) -> Column:
    """Null for energies that are not positive."""
    return F.when(energy > 0, 10.0 * F.log10(energy))


def db_sum(*levels: Column) -> Column:
    """Levels added as energy; unknown ones are left out, and all unknown is unknown."""
    total = sum((F.coalesce(db_to_energy(x), F.lit(0.0)) for x in levels[1:]), F.coalesce(db_to_energy(levels[0]), F.lit(0.0)))
    return F.when(F.coalesce(*levels).isNotNull(), energy_to_db(total))


def zero_cutoff(source: Column, metric: Column) -> Column:
    """The level that a zero code stays below: known for road and rail only."""
    return F.when(source.isin("road", "rail"), F.when(metric == "Lnight", 35.0).otherwise(40.0))


def status(raw: Column, cutoff: Column) -> Column:
    """Reading of one raster value: nodata, a value, below a known cutoff, or unknown; other codes are an error."""
    return (
        F.when(raw.isNull(), "outside_extract")
        .when(raw == NODATA, "unreported_unknown")
        .when((raw == 0) & cutoff.isNotNull(), "verified_below_cutoff")
        .when(raw == 0, "unreported_unknown")
        .when((raw > 0) & (raw <= 160), "reported_model_value")
        .otherwise(F.raise_error(F.concat(F.lit("unrecognised noise code "), raw.cast("string"))))
    )


def interpret(raw: Column, cutoff: Column) -> Column:
    """Evidence struct of one value: status, raw encoding, value and bounds with their strictness."""
    said = status(raw, cutoff)
    encoding = F.when(raw.isNull(), "not_sampled").when(raw == NODATA, "tiff_nodata").when(raw == 0, "zero_code").otherwise("numeric")
    value = F.when(said == "reported_model_value", raw)
    upper = F.when(said == "reported_model_value", raw).when(said == "verified_below_cutoff", cutoff)
    exact = said == "reported_model_value"
    bounds = F.struct(value.alias("lower_db"), upper.alias("upper_db"), exact.alias("lower_inclusive"), exact.alias("upper_inclusive"))
    return F.struct(said.alias("status"), encoding.alias("raw_encoding"), value.alias("value_db"), F.when(upper.isNotNull(), bounds).alias("bounds"))


def difference_bounds(first: Column, other: Column) -> Column:
    """Other minus first of two evidence structs; null where neither end is bounded."""
    a, b = first["bounds"], other["bounds"]
    lower, upper = b["lower_db"] - a["upper_db"], b["upper_db"] - a["lower_db"]
    made = F.struct(
        lower.alias("lower_db"), upper.alias("upper_db"),
        (lower.isNotNull() & b["lower_inclusive"] & a["upper_inclusive"]).alias("lower_inclusive"),
        (upper.isNotNull() & b["upper_inclusive"] & a["lower_inclusive"]).alias("upper_inclusive"),
    )
    return F.when(lower.isNotNull() | upper.isNotNull(), made)


def encode(raw: Column, cutoff: Column) -> Column:
    """Compact code: 1 no data, 2 below the cutoff, 3 + value in hundredths of a dB."""
    value = CODE_VALUE0 + F.rint(raw * 100).cast("int")
    return F.when(raw.isNull(), 0).when(raw == NODATA, CODE_NODATA).when(raw == 0, F.when(cutoff.isNotNull(), CODE_BELOW).otherwise(CODE_NODATA)).otherwise(value)


def decode(code: Column) -> Column:
    return F.when(code >= CODE_VALUE0, (code - CODE_VALUE0) / 100.0)


def band(level: Column) -> Column:
    """0 below 40 dB, then one for each 5 dB reached, 7 from 70 dB on."""
    return sum(((level >= x).cast("int") for x in BREAKS[1:]), (level >= BREAKS[0]).cast("int"))


def display_class(raw: Column, cutoff: Column) -> Column:
    value = F.when(raw > 0, CLASS_FIRST + band(raw))
    return F.when(raw.isNull(), CLASS_OUTSIDE).when(raw == NODATA, CLASS_NODATA).when(raw == 0, F.when(cutoff.isNotNull(), CLASS_BELOW).otherwise(CLASS_NODATA)).otherwise(value)


def display_class_of_average(energy: Column, land: Column, nodata: Column, limit: Column) -> Column:
    """Class of an averaged pixel from its energy sum and cell counts; below the limit is one class."""
    level = energy_to_db(energy / land)
    of_level = F.when(level.isNull(), CLASS_FIRST).otherwise(CLASS_FIRST + band(level))
    return (
        F.when((land > 0) & limit.isNotNull() & (F.coalesce(level, F.lit(-1e9)) < limit), CLASS_BELOW)
        .when(land > 0, of_level)
        .when(nodata > 0, CLASS_NODATA)
        .otherwise(CLASS_OUTSIDE)
    )


def band_word(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WORDS]), band(level) + 1)


def band_label(level: Column, below: Column, land: Column, withheld: Column) -> Column:
    """What a place is said to have: outside and withheld come before any value, and what lies below the cutoff is not silence."""
    return F.when(~land, "outside").when(withheld, "withheld").when(level.isNotNull(), band_word(level)).when(below, "below reporting, not silence").otherwise("no data")


def who_limit(source: Column, metric: Column) -> Column:
    out = None
    for (s, m), limit in WHO_LIMITS.items():
        when = (source == s) & (metric == m)
        out = F.when(when, limit) if out is None else out.when(when, limit)
    return out.cast("double")


def relative_humidity(t: Column, td: Column) -> Column:
    """Magnus formula over water, per cent; unknown outside its domain."""
    known = t.between(-20, 50) & (td >= -80) & (td <= t)
    return F.when(known, 100.0 * F.exp(17.67 * td / (td + 243.5) - 17.67 * t / (t + 243.5)))


def absorption_db_per_km(frequency: Column, t: Column, rh: Column, p: Column) -> Column:
    """Pure-tone atmospheric absorption after ISO 9613-1; unknown outside 50-10000 Hz, -20-50 C, 10-100 %, 50-120 kPa."""
    kelvin = t + 273.15
    ratio, pressure = kelvin / 293.15, p / 101.325
    saturation = 101.325 * F.pow(F.lit(10.0), -6.8346 * F.pow(273.16 / kelvin, F.lit(1.261)) + 4.6151)
    h = rh * saturation / p
    oxygen = pressure * (24 + 40400 * h * (0.02 + h) / (0.391 + h))
    nitrogen = pressure * F.pow(ratio, F.lit(-0.5)) * (9 + 280 * h * F.exp(-4.17 * (F.pow(ratio, F.lit(-1 / 3)) - 1)))
    relax = 0.01275 * F.exp(-2239.1 / kelvin) / (oxygen + frequency * frequency / oxygen) + 0.1068 * F.exp(-3352 / kelvin) / (nitrogen + frequency * frequency / nitrogen)
    alpha = 8.686 * frequency * frequency * (1.84e-11 / pressure * F.sqrt(ratio) + F.pow(ratio, F.lit(-2.5)) * relax)
    known = frequency.between(50, 10000) & t.between(-20, 50) & rh.between(10, 100) & p.between(50, 120)
    return F.when(known, 1000.0 * alpha)
