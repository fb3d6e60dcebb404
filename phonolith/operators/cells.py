"""Operators over the table of cells: row_i, col_i (north first), source, raw (value, 0 or the nodata code)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac

SOURCES = ("road", "rail", "aircraft")
KEY = ("row_i", "col_i")


def read(cells: DataFrame, metric: str = "Lden") -> DataFrame:
    """Cells with their cutoff, status, level (null unless reported), code and display class."""
    cutoff = ac.zero_cutoff(F.col("source"), F.lit(metric))
    out = cells.withColumn("cutoff", cutoff).withColumn("status", ac.status(F.col("raw"), F.col("cutoff")))
    out = out.withColumn("level", F.when(F.col("status") == "reported_model_value", F.col("raw")))
    return out.withColumn("code", ac.encode(F.col("raw"), F.col("cutoff"))).withColumn("class", ac.display_class(F.col("raw"), F.col("cutoff")))


def diagnostics(cells: DataFrame) -> DataFrame:
    """Counts of nodata, zero and reported codes of each source, with the least and largest reported value."""
    value = F.when(F.col("raw") > 0, F.col("raw"))
    return cells.groupBy("source").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("raw") == ac.NODATA).alias("nodata"), F.count_if(F.col("raw") == 0).alias("zeros"),
        F.count(value).alias("reported"), F.min(value).alias("min_db"), F.max(value).alias("max_db"),
    )


def wide(cells: DataFrame) -> DataFrame:
    """One row per cell with a level for each source; null where none is reported."""
    of = [F.max(F.when((F.col("source") == s) & (F.col("raw") > 0), F.col("raw"))).alias(s) for s in SOURCES]
    return cells.groupBy(*KEY).agg(*of)


def combine_censored(levels: DataFrame, sources: Sequence[str], thresholds: dict[str, float]) -> DataFrame:
    """Energy bounds of a cell over sources: reported ones only, and with thresholds in place of the missing.

    Adds lower_energy, upper_energy, lower_db, upper_db, uncertainty_db and dominant (first of equals, by the order of
    sources).
    """
    zero = F.lit(0.0)
    lower, upper, top = zero, zero, F.lit(float("-inf"))
    for s in sources:
        energy = ac.db_to_energy(F.col(s))
        lower = lower + F.coalesce(energy, zero)
        upper = upper + F.coalesce(energy, F.lit(10.0 ** (thresholds[s] / 10)))
        top = F.greatest(top, F.coalesce(F.col(s), F.lit(float("-inf"))))
    any_reported = F.coalesce(*[F.col(s) for s in sources]).isNotNull()
    dominant = F.when(~any_reported, "none-reported")
    for s in sources:
        dominant = dominant.when(F.col(s) == top, s)
    out = levels.withColumns({"lower_energy": lower, "upper_energy": upper, "dominant": dominant})
    out = out.withColumns({"lower_db": F.when(any_reported, ac.energy_to_db(F.col("lower_energy"))), "upper_db": ac.energy_to_db(F.col("upper_energy"))})
    return out.withColumn("uncertainty_db", F.col("upper_db") - F.col("lower_db"))


def energy_blocks(bounds: DataFrame, factor: int = 10) -> DataFrame:
    """Mean energy bounds of blocks of factor x factor cells; cells without a report stay in the denominator.

    Blocks that the grid cuts off are left out, as their cells do not fill them.
    """
    block = [F.floor(F.col(k) / factor).cast("long").alias(k.replace("_i", "_b")) for k in KEY]
    out = bounds.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.avg("lower_energy").alias("lower_energy"), F.avg("upper_energy").alias("upper_energy"), F.avg(F.col("lower_db").isNotNull().cast("double")).alias("reported"))
    out = out.where(F.col("n") == factor * factor)
    return out.withColumns({"lower_db": ac.energy_to_db(F.col("lower_energy")), "upper_db": ac.energy_to_db(F.col("upper_energy"))})


def energy_sums(cells: DataFrame, keys: Sequence[str | Column], metric: str = "Lden") -> DataFrame:
    """Per group and source: energy of reported cells, calculated cells (reported or below) and nodata cells.

    Codes are counted first: 10^(L/10) is worked out once for each code, and sums do not depend on the cells' order.
    """
    coded = read(cells, metric).groupBy(*keys, "source", "code").agg(F.count(F.lit(1)).alias("n"))
    names = [k if isinstance(k, str) else None for k in keys]
    level = ac.decode(F.col("code"))
    out = coded.groupBy(*[n for n in names if n], "source").agg(
        F.sum(F.coalesce(ac.db_to_energy(level), F.lit(0.0)) * F.col("n")).alias("energy"),
        F.sum(F.when(F.col("code") >= ac.CODE_BELOW, F.col("n")).otherwise(0)).alias("land"),
        F.sum(F.when(F.col("code") == ac.CODE_NODATA, F.col("n")).otherwise(0)).alias("nodata"),
    )
    return out


def pyramid(cells: DataFrame, levels: int = 4, metric: str = "Lden") -> DataFrame:
    """Averaged pixels at every halving of the grid, with display classes; level 0 is the cells themselves.

    Sums are taken once at level 0 and halved from level to level, so each level reads a quarter of the last.
    """
    at = energy_sums(cells, KEY, metric).withColumn("zoom_out", F.lit(0))
    out = at
    for i in range(1, levels + 1):
        at = at.groupBy(F.shiftright("row_i", 1).alias("row_i"), F.shiftright("col_i", 1).alias("col_i"), "source").agg(
            F.sum("energy").alias("energy"), F.sum("land").alias("land"), F.sum("nodata").alias("nodata")
        )
        out = out.unionByName(at.withColumn("zoom_out", F.lit(i)))
    limit = ac.zero_cutoff(F.col("source"), F.lit(metric))
    return out.withColumn("class", ac.display_class_of_average(F.col("energy"), F.col("land"), F.col("nodata"), limit))


def sampled_pyramid(cells: DataFrame, levels: int = 4) -> DataFrame:
    """The class of the cell under each pixel's centre, at every halving."""
    classed = read(cells).select(*KEY, "source", "class")
    zooms = classed.withColumn("zoom_out", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    step = F.pow(F.lit(2.0), F.col("zoom_out")).cast("long")
    centre = F.floor(step / 2).cast("long")
    hit = (F.pmod(F.col("row_i"), step) == centre) & (F.pmod(F.col("col_i"), step) == centre)
    return zooms.where(hit).select("zoom_out", F.floor(F.col("row_i") / step).cast("long").alias("row_p"), F.floor(F.col("col_i") / step).cast("long").alias("col_p"), "source", "class")


def hexagons(cells: DataFrame, q: Column, r: Column, metric: str = "Lden") -> DataFrame:
    """Six counters of each hexagon and source, with shares and mean level."""
    who = ac.who_limit(F.col("source"), F.lit(metric))
    own = read(cells, metric).withColumns({"q": q, "r": r})
    out = own.groupBy("q", "r", "source").agg(
        F.count("level").alias("value_cells"), F.count_if(F.col("status") == "verified_below_cutoff").alias("below_cells"),
        F.count_if(F.col("status") == "unreported_unknown").alias("nodata_cells"), F.sum(ac.db_to_energy(F.col("level"))).alias("energy_sum"),
        F.count_if(F.col("level") >= 55).alias("cells_ge_55"), F.count_if(F.col("level") >= who).alias("cells_ge_who"),
    )
    calculated = F.col("value_cells") + F.col("below_cells")
    return out.withColumns({"share_ge_55": F.when(calculated > 0, F.col("cells_ge_55") / calculated), "mean_db": F.when(calculated > 0, ac.energy_to_db(F.col("energy_sum") / calculated))})


def area_summary(cells: DataFrame, by: Sequence[str] = ("source",), metric: str = "Lden", share_level: float = 55.0) -> DataFrame:
    """How an area's noise divides: status counts, eight bands, shares of calculated cells, and the energy average as a range.

    The lower end takes cells below the cutoff as silent, the upper end as loud as the cutoff.
    """
    who = ac.who_limit(F.col("source"), F.lit(metric))
    own = read(cells, metric).withColumn("band", ac.band(F.col("level"))).withColumn("who", who)
    below = F.col("status") == "verified_below_cutoff"
    calculated = F.count("level") + F.count_if(below)
    energy, cut = F.sum(ac.db_to_energy(F.col("level"))), F.sum(F.when(below, ac.db_to_energy(F.col("cutoff"))))
    return own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.count("level").alias("value_cells"), F.count_if(below).alias("below_cells"), F.count_if(F.col("status") == "unreported_unknown").alias("unknown_cells"),
        *[F.count_if(F.col("band") == i).alias(f"band_{i}") for i in range(8)],
        F.when(calculated > 0, F.count_if(F.col("level") >= share_level) / calculated).alias("share_ge_level"),
        F.when(calculated > 0, F.count_if(F.col("level") >= F.col("who")) / calculated).alias("share_ge_who"),
        ac.energy_to_db(F.coalesce(energy, F.lit(0.0)) / calculated).alias("average_lower_db"),
        ac.energy_to_db((F.coalesce(energy, F.lit(0.0)) + F.coalesce(cut, F.lit(0.0))) / calculated).alias("average_upper_db"),
    )


def censored_median(cells: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """The ceil(n / 2)-th of the calculated cells, those below the cutoff first (median_db null when it is one of them)."""
    own = read(cells).where("status in ('reported_model_value', 'verified_below_cutoff')").groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*by).orderBy("code")
    run = own.withColumns({"upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(W.partitionBy(*by))})
    mid = run.where((F.col("upto") >= F.ceil(F.col("all") / 2)) & (F.col("upto") - F.col("n") < F.ceil(F.col("all") / 2)))
    return mid.select(*by, F.col("all").alias("calculated"), ac.decode(F.col("code")).alias("median_db"), (F.col("code") == ac.CODE_BELOW).alias("below_cutoff"))


def level_statistics(cells: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Least, largest and mean reported level and percentiles with linear interpolation."""
    own = cells.where("raw > 0")
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("min_db"), F.max("raw").alias("max_db"), F.avg("raw").alias("mean_db"), *[F.percentile("raw", F.lit(p)).alias(f"p{round(p * 100)}") for p in shares])


def histogram(cells: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Reported cells between edges (low <= level < high; the last bin includes its end) and their share of a source."""
    own = cells.where((F.col("raw") > 0) & (F.col("raw") >= edges[0]) & (F.col("raw") <= edges[-1]))
    at = sum(((F.col("raw") >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    counts = own.groupBy("source", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    low = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    return counts.withColumns({"low": low, "share": F.col("n") / F.sum("n").over(W.partitionBy("source"))})


def semantic_checks(bounds: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Counts of cells that break a rule of the four-band product; all but cells must be 0."""
    lower, upper = F.col("lower_db"), F.col("upper_db")
    return bounds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(upper.isNull()).alias("upper_missing"), F.count_if(lower > upper + 1e-9).alias("lower_above_upper"),
        F.count_if((F.col("dominant") == "none-reported") & lower.isNotNull()).alias("value_without_source"),
        F.count_if((F.col("dominant") != "none-reported") & lower.isNull()).alias("source_without_value"), F.count_if((lower < 0) | (upper > 160)).alias("out_of_range"),
    )


def tile_columns(side: int = 10) -> list[Column]:
    """Row and column of the tile that a cell lies in."""
    return [F.floor(F.col("row_i") / side).cast("long").alias("tile_row"), F.floor(F.col("col_i") / side).cast("long").alias("tile_col")]


#: Value that stands for no data in the bands of the coarse product, and the range in which a level is possible.
BAND_NODATA, POSSIBLE_DB = -9999.0, (0.0, 150.0)


def band_checks(bands: DataFrame, by: list[Column], cutoffs: tuple[float, float], tolerance: float = 1e-5) -> DataFrame:
    """Sixteen counts of what should not be in the coarse bands, per group, and whether the group is sound.

    bands: land, combined_lower, road_rail_upper, airport_lower, airport_fraction, combined_upper. cutoffs: reporting
    thresholds of road and rail, whose energy sum no upper bound may lie below. Missing data on land is counted and allowed.
    """
    levels, whole = ("combined_lower", "road_rail_upper", "airport_lower", "combined_upper"), ("combined_lower", "road_rail_upper", "airport_lower", "airport_fraction", "combined_upper")
    land, infinite = F.col("land"), float("inf")
    finite = {c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != infinite), F.lit(False)) for c in whole}
    known = {c: land & finite[c] & (F.col(c) != BAND_NODATA) for c in whole}
    lower, upper, airport, part, top = (F.col(c) for c in whole)
    floor = 10 * math.log10(sum(10 ** (x / 10) for x in cutoffs))
    count = F.count_if
    total = lambda conditions: sum((count(c) for c in conditions), F.lit(0))
    counts = {
        "outside_values": total(~land & ~F.coalesce(F.col(c) == BAND_NODATA, F.lit(False)) for c in whole), "not_finite": total(~finite[c] for c in whole), "nodata_on_land": total(land & F.coalesce(F.col(c) == BAND_NODATA, F.lit(False)) for c in whole),
        "fraction_missing": count(land & ~known["airport_fraction"]), "fraction_out_of_range": count(known["airport_fraction"] & ((part < -tolerance) | (part > 1 + tolerance))),
        "fraction_zero_with_airport": count(land & (part == 0) & known["airport_lower"]), "fraction_without_airport": count(known["airport_fraction"] & (part > 0) & ~known["airport_lower"]),
        "airport_without_combined": count(known["airport_lower"] & ~known["combined_lower"]), "combined_below_airport": count(known["combined_lower"] & known["airport_lower"] & (lower + tolerance < airport)),
        "upper_missing": count(land & ~known["road_rail_upper"]), "upper_below_floor": count(known["road_rail_upper"] & (upper + tolerance < floor)),
        "impossible": total(known[c] & ~F.col(c).between(*POSSIBLE_DB) for c in levels), "zeros": total(known[c] & (F.col(c) == 0) for c in levels),
        "combined_upper_missing": count(land & ~known["combined_upper"]), "combined_upper_below_lower": count(known["combined_upper"] & known["combined_lower"] & (top + tolerance < lower)),
        "combined_upper_below_road_rail": count(known["combined_upper"] & known["road_rail_upper"] & (top + tolerance < upper)),
    }
    out = bands.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), *[c.cast("long").alias(k) for k, c in counts.items()])
    faults = sum((F.col(k) for k in counts if k != "nodata_on_land"), F.lit(0))
    return out.withColumn("sound", faults == 0)


def require_sound(checks: DataFrame) -> DataFrame:
    """checks as they are; reading them fails at the first group that is not sound."""
    return checks.withColumn("sound", F.when(F.col("sound"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bands are not sound: "), F.to_json(F.struct(*checks.columns)))).cast("boolean")))


def availability(cells: DataFrame, qualification: DataFrame) -> DataFrame:
    """Cells by source, qualification of their tile and availability, with subtotals (null: all)."""
    own = read(cells).select("*", *tile_columns()).join(qualification, ["tile_row", "tile_col", "source"], "left").withColumn("qualification", F.coalesce("qualification", F.lit("not_assessed")))
    kind = F.when(F.col("status") == "reported_model_value", "value").when(F.col("status") == "verified_below_cutoff", "below").otherwise("missing")
    return own.withColumn("availability", kind).rollup("source", "qualification", "availability").agg(F.count(F.lit(1)).alias("n"))


def reconciled(table: DataFrame, expected: DataFrame, by: Sequence[str], group: str, n: str = "n") -> DataFrame:
    """A rolled-up table whose totals are proved: every subtotal is the sum of its parts, and each group's total is the expected one.

    table: columns `by` in the order of the rollup (null: all), n; expected: group, cells. A total that fails raises an error
    when the row is read. Values of `by` must not be null themselves.
    """
    out = table
    for i in range(len(by)):
        above, here = list(by[:i]), by[i]
        rest = F.lit(True)
        for c in by[i + 1 :]:
            rest = rest & F.col(c).isNull()
        parts = table.where(F.col(here).isNotNull() & rest).groupBy(*above).agg(F.sum(n).alias("_parts"))
        is_total = F.col(here).isNull() & rest
        for c in above:
            is_total = is_total & F.col(c).isNotNull()
        joined = out.join(parts, above, "left") if above else out.crossJoin(F.broadcast(parts))  # one row: the sum of all
        wrong = is_total & ~F.col(n).eqNullSafe(F.col("_parts"))
        out = joined.withColumn(n, F.when(wrong, F.raise_error(F.concat(F.lit("a total is not the sum of its parts at "), F.lit(here))).cast("long")).otherwise(F.col(n))).drop("_parts")
    whole = F.col(group).isNotNull()
    for c in by:
        whole = whole & (F.lit(True) if c == group else F.col(c).isNull())
    out = out.join(expected.select(F.col(group).alias("_group"), F.col("cells").alias("_cells")), F.col(group) == F.col("_group"), "left")
    failed = F.raise_error(F.concat(F.lit("cells do not add up in "), F.col(group))).cast("long")
    return out.withColumn(n, F.when(whole & ~F.col(n).eqNullSafe(F.col("_cells")), failed).otherwise(F.col(n))).select(*by, n)


def band_qualification(states: DataFrame, depends: DataFrame) -> DataFrame:
    """Qualification of a derived band from its sources' states: rejected withholds it, outside limits it."""
    severity = F.when(F.col("state") == "rejected", 2).when(F.col("state") == "outside", 1).otherwise(0)
    worst = states.join(F.broadcast(depends), "source").groupBy("tile_row", "tile_col", "band").agg(F.max(severity).alias("worst"))
    return worst.select("tile_row", "tile_col", "band", F.when(F.col("worst") == 2, "withheld").when(F.col("worst") == 1, "limited").otherwise("qualified").alias("qualification"))


def joint_support(cells: DataFrame) -> DataFrame:
    """Cells by the set of sources that report there (bit i: SOURCES[i]), and their share."""
    bit = sum((F.when(F.col("source") == s, 1 << i).otherwise(0) for i, s in enumerate(SOURCES)), F.lit(0))
    masks = cells.groupBy(*KEY).agg(F.sum(F.when(F.col("raw") > 0, bit).otherwise(0)).cast("int").alias("mask"))
    counts = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def extremes(cells: DataFrame, k: int = 20) -> DataFrame:
    """The k loudest and k quietest reported cells of each source; rows of a tile are cut to k before the final ranking."""
    own = cells.where("raw > 0").select("*", *tile_columns())
    own = own.withColumn("direction", F.explode(F.array(F.lit("high"), F.lit("low")))).withColumn("order", F.when(F.col("direction") == "high", -F.col("raw")).otherwise(F.col("raw")))
    first = F.row_number().over(W.partitionBy("source", "direction", "tile_row", "tile_col").orderBy("order", *KEY))
    last = F.row_number().over(W.partitionBy("source", "direction").orderBy("order", *KEY))
    return own.withColumn("n", first).where(F.col("n") <= k).withColumn("rank", last).where(F.col("rank") <= k).select("source", "direction", "rank", *KEY, "raw")


def loudest(cells: DataFrame) -> DataFrame:
    """The loudest cell of each source, first in reading order of equals, and how many are equal."""
    top = cells.groupBy("source").agg(F.max("raw").alias("raw")).where("raw > 0")
    ties = cells.join(top, ["source", "raw"]).groupBy("source", "raw").agg(F.min(F.struct(*KEY)).alias("at"), F.count(F.lit(1)).alias("ties"))
    return ties.select("source", "raw", "at.row_i", "at.col_i", "ties")


def repeated_values(cells: DataFrame, k: int = 12) -> DataFrame:
    """The k most repeated reported values of each source, lower first of equals."""
    counts = cells.where("raw > 0").groupBy("source", "raw").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "raw"))).where(F.col("rank") <= k)


#: Cells along one side of the tiles that are folded in one go; a tile is bounded whatever the input.
SIDE = 128


def _tiled(cells: DataFrame, reach: int, work: Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict[str, np.ndarray]], more: str) -> DataFrame:
    """KEY, source and what `work` gives for each cell: a tile's cells and those within reach of it are laid out as rasters.

    work takes the rows and their places in a raster of SIDE + 2 x reach cells each way and gives rasters of SIDE cells, by
    name. A cell goes to its own tile and to those whose edge it is near; places without a cell hold nothing, so ragged
    grids lose nothing.
    """
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / SIDE).cast("long"), F.floor((F.col(c) + reach) / SIDE).cast("long")))
    held = cells.withColumn("_r", tiles("row_i")).withColumn("_c", tiles("col_i"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf.row_i - key[1] * SIDE).to_numpy(), (pdf.col_i - key[2] * SIDE).to_numpy()
        own = (r >= 0) & (r < SIDE) & (c >= 0) & (c < SIDE)
        out = work(pdf, r + reach, c + reach)
        return pd.DataFrame({"row_i": pdf.row_i[own], "col_i": pdf.col_i[own]} | {n: v[r[own], c[own]] for n, v in out.items()}).assign(source=key[0])

    return held.groupBy("source", "_r", "_c").applyInPandas(fold, f"row_i long, col_i long, {more}, source string").select(*KEY, "source", *[m.split()[0] for m in more.split(", ")])


def _raster(reach: int, start: float, dtype: type = float) -> np.ndarray:
    return np.full((SIDE + 2 * reach,) * 2, start, dtype)


def _folded(raster: np.ndarray, reach: int, how: np.ufunc) -> np.ndarray:
    """how over the square of places within reach, along rows, then along columns."""
    rows = reduce(how, [raster[:, i : i + SIDE] for i in range(2 * reach + 1)])
    return reduce(how, [rows[i : i + SIDE] for i in range(2 * reach + 1)])


def moving_means(cells: DataFrame, reach: int = 2) -> DataFrame:
    """Mean level over the square of cells within reach, missing cells left out, in exact hundredths."""
    own = cells.select(*KEY, "source", F.when(F.col("raw") > 0, F.rint(F.col("raw") * 100).cast("long")).otherwise(0).alias("v"), F.coalesce(F.col("raw") > 0, F.lit(False)).cast("long").alias("n"))

    def work(pdf: pd.DataFrame, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        sums = {n: _raster(reach, 0, np.int64) for n in ("v", "n")}
        for n, raster in sums.items():
            np.add.at(raster, (r, c), pdf[n].to_numpy())
        return {n: _folded(raster, reach, np.add) for n, raster in sums.items()}

    out = _tiled(own, reach, work, "v long, n long")
    return out.select(*KEY, "source", "n", F.when(F.col("n") > 0, F.col("v").cast("double") / 100.0 / F.col("n")).alias("mean_db"))


def square_range(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Least and largest reported level in the square of cells within reach."""

    def work(pdf: pd.DataFrame, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        known, ends = (pdf.raw > 0).to_numpy(), {}
        for n, how, start in (("low", np.minimum, np.inf), ("high", np.maximum, -np.inf)):
            raster = _raster(reach, start)
            how.at(raster, (r[known], c[known]), pdf.raw.to_numpy()[known])
            ends[n] = _folded(raster, reach, how)
        return ends

    known = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)
    return _tiled(cells.select(*KEY, "source", "raw"), reach, work, "low double, high double").select(*KEY, "source", known("low"), known("high"))


def row_clearance(cells: DataFrame, blocked: Column) -> DataFrame:
    """Cells to the nearest blocked cell of the same row and source; null if the row has none."""
    own = cells.withColumn("at", F.when(blocked, F.col("col_i")))
    line = W.partitionBy("source", "row_i").orderBy("col_i")
    out = own.withColumns({"left": F.last("at", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0)), "right": F.first("at", ignorenulls=True).over(line.rowsBetween(0, W.unboundedFollowing))})
    return out.select(*KEY, "source", F.least(F.col("col_i") - F.col("left"), F.col("right") - F.col("col_i")).alias("clearance"))


def clearance(cells: DataFrame, blocked: Column, reach: int, of: Column | None = None) -> DataFrame:
    """Squared distance in cells to the nearest blocked cell, exact within reach, else null; of all cells, or of those that `of` names."""

    def work(pdf: pd.DataFrame, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        far = 4 * reach * reach + 4
        at = _raster(reach, far, np.int64)
        hit = pdf.hit.to_numpy(bool)
        at[r[hit], c[hit]] = 0
        steps = [(i, (i - reach) ** 2) for i in range(2 * reach + 1)]
        rows = reduce(np.minimum, [at[:, i : i + SIDE] + d for i, d in steps])
        asked = _raster(reach, False, bool)
        asked[r, c] = pdf.asked.to_numpy(bool)
        return {"d2": reduce(np.minimum, [rows[i : i + SIDE] + d for i, d in steps]), "asked": asked[reach : reach + SIDE, reach : reach + SIDE]}

    flags = [F.coalesce(f, F.lit(False)).alias(n) for n, f in (("hit", blocked), ("asked", F.lit(True) if of is None else of))]
    out = _tiled(cells.select(*KEY, "source", *flags), reach, work, "d2 long, asked boolean").where("asked").drop("asked")
    return out.withColumn("d2", F.when(F.col("d2") <= reach * reach, F.col("d2")))


def quietest(cells: DataFrame, reach: int, candidate: Column, blocked: Column) -> DataFrame:
    """For each source the candidate cell furthest from a blocked one; `exact` is false when only a bound is known."""
    far = clearance(cells, blocked, reach, candidate)
    far = far.withColumns({"exact": F.col("d2").isNotNull(), "d2": F.coalesce("d2", F.lit(reach * reach))})
    best = far.groupBy("source").agg(F.min(F.struct("exact", (-F.col("d2")).alias("near"), *KEY)).alias("b"))
    return best.select(*[F.col(f"b.{k}").alias(k) for k in KEY], "source", (-F.col("b.near")).alias("d2"), F.col("b.exact").alias("exact"))


def seam_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per source: cells on both sides with equal or different values or masks, and cells on one side only."""
    a = left.select(*KEY, "source", F.col("raw").alias("a"), F.lit(1).alias("in_a"))
    b = right.select(*KEY, "source", F.col("raw").alias("b"), F.lit(1).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    masked = (F.col("a") == ac.NODATA) != (F.col("b") == ac.NODATA)
    return a.join(b, [*KEY, "source"], "full_outer").groupBy("source").agg(
        F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("equal"), F.count_if(both & masked).alias("mask_differs"),
        F.count_if(both & ~masked & ~F.col("a").eqNullSafe(F.col("b"))).alias("value_differs"), F.count_if(F.col("in_b").isNull()).alias("only_left"),
        F.count_if(F.col("in_a").isNull()).alias("only_right"), F.max(F.when(both & ~masked, F.abs(F.col("a") - F.col("b")))).alias("max_difference"),
    )


def mosaic(parts: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells of a mosaic that are missing or covered more than once, per source; an empty result is a sound mosaic."""
    seen = parts.groupBy(*KEY, "source").agg(F.count(F.lit(1)).alias("times"))
    whole = parts.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row_i"), F.pmod("id", F.lit(cols)).alias("col_i"))
    whole = whole.withColumn("source", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
    return whole.join(seen, [*KEY, "source"], "left").withColumn("times", F.coalesce("times", F.lit(0)).cast("long")).where("times <> 1")


def coarse_bounds(bounds: DataFrame, quality: Column, factor: int = 4) -> DataFrame:
    """Coarser display: mean of energies, and the worst quality code, so that a small withheld area stays seen."""
    return bounds.groupBy(*[F.floor(F.col(k) / factor).cast("long").alias(k) for k in KEY]).agg(
        ac.energy_to_db(F.avg("lower_energy")).alias("lower_db"), ac.energy_to_db(F.avg("upper_energy")).alias("upper_db"), F.max(quality).alias("quality")
    )


def place_differences(places: DataFrame, cells: DataFrame) -> DataFrame:
    """Saved places side by side: each place's reading and its bounds less the first place's, per source.

    places: place (0 is the first), row_i, col_i.
    """
    at = places.join(cells, [*KEY]).withColumn("e", ac.interpret(F.col("raw"), ac.zero_cutoff(F.col("source"), F.lit("Lden"))))
    first = at.where("place = 0").select("source", F.col("e").alias("e0"))
    out = at.join(first, "source").withColumn("d", ac.difference_bounds(F.col("e0"), F.col("e")))
    return out.select("place", "source", F.col("e.status").alias("status"), F.col("e.value_db").alias("value_db"), F.col("d.lower_db").alias("lower_db"), F.col("d.upper_db").alias("upper_db"), F.col("d.lower_inclusive").alias("lower_inclusive"), F.col("d.upper_inclusive").alias("upper_inclusive"))
