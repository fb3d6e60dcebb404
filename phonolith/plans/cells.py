"""Queries over the derived table of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac
from phonolith.functions import geometry as geo
from phonolith.operators import cells as op
from phonolith.plans.registry import query
from phonolith.sources.fixtures import CELLS

THRESHOLDS = {"road": 40.0, "rail": 40.0, "aircraft": 45.0}


def centre():
    """Easting and northing of a cell; a function, as columns need a session."""
    return 530005.0 + F.col("col_i") * 100.0, 179995.0 - F.col("row_i") * 100.0


READ = """c as (select *, case when source <> 'aircraft' then 40.0::double end cutoff,
  case when raw = -96 then 'unreported_unknown' when raw = 0 and source <> 'aircraft' then 'verified_below_cutoff'
    when raw = 0 then 'unreported_unknown' else 'reported_model_value' end status,
  case when raw > 0 then raw end lv,
  case when raw = -96 then 1 when raw = 0 and source <> 'aircraft' then 2 when raw = 0 then 1 else 3 + round_even(raw * 100, 0)::int end code,
  case when raw > 0 then (raw >= 40)::int + (raw >= 45)::int + (raw >= 50)::int + (raw >= 55)::int + (raw >= 60)::int + (raw >= 65)::int + (raw >= 70)::int end band
  from {t} x)"""
BOUNDS = """w as (select row_i, col_i, max(case when source = 'road' and raw > 0 then raw end) road, max(case when source = 'rail' and raw > 0 then raw end) rail,
  max(case when source = 'aircraft' and raw > 0 then raw end) aircraft from {t} x group by 1, 2),
b as (select *, coalesce(pow(10, road / 10), 0) + coalesce(pow(10, rail / 10), 0) + coalesce(pow(10, aircraft / 10), 0) lower_energy,
  coalesce(pow(10, road / 10), 10000) + coalesce(pow(10, rail / 10), 10000) + coalesce(pow(10, aircraft / 10), pow(10, 4.5)) upper_energy from w),
d as (select *, case when lower_energy > 0 then 10 * log10(lower_energy) end lower_db, 10 * log10(upper_energy) upper_db from b)"""


def r4(*names: str) -> dict:
    return {n: F.round(n, 4) for n in names}


@query("prj3_decode_diagnostics", CELLS, """
select source, count(*) cells, count(*) filter (raw = -96) nodata, count(*) filter (raw = 0) zeros, count(*) filter (raw > 0) reported,
  min(raw) filter (raw > 0) min_db, max(raw) filter (raw > 0) max_db from {t} x group by 1""")
def _(cells: DataFrame) -> DataFrame:
    return op.diagnostics(cells)


@query("prj4_prj6_prj7_interpret", CELLS, "with " + READ + """
select row_i, col_i, source, status, lv value_db, case when status = 'reported_model_value' then lv when status = 'verified_below_cutoff' then cutoff end upper_db,
  coalesce(lv is not null, false) inclusive, code, case when raw = -96 then 1 when raw = 0 then case when cutoff is not null then 2 else 1 end else 3 + band end class
from c""")
def _(cells: DataFrame) -> DataFrame:
    own = op.read(cells).withColumn("e", ac.interpret(F.col("raw"), F.col("cutoff")))
    upper = F.col("e.bounds.upper_db")
    return own.select("row_i", "col_i", "source", "status", F.col("e.value_db").alias("value_db"), upper.alias("upper_db"), F.coalesce("e.bounds.lower_inclusive", F.lit(False)).alias("inclusive"), "code", "class")


@query("prj1_prj2_level_sums", CELLS, "with " + BOUNDS + """
select row_i, col_i, round(case when coalesce(road, rail, aircraft) is not null then 10 * log10(lower_energy) end, 4) total_db, round(pow(10, road / 10) / 1000, 4) road_energy
from d""")
def _(cells: DataFrame) -> DataFrame:
    w = op.wide(cells)
    return w.select("row_i", "col_i", F.round(ac.db_sum(F.col("road"), F.col("rail"), F.col("aircraft")), 4).alias("total_db"), F.round(ac.db_to_energy(F.col("road")) / 1000, 4).alias("road_energy"))


@query("prj5_prj23_layer_rules", CELLS, """
select distinct source, m.metric, case when source = 'aircraft' then null when m.metric = 'Lnight' then 35.0 else 40.0 end::double cutoff,
  case source || m.metric when 'roadLden' then 53 when 'roadLnight' then 45 when 'railLden' then 54 when 'railLnight' then 44 when 'aircraftLden' then 45 when 'aircraftLnight' then 40 end::double who
from {t} x, (values ('Lden'), ('Lday'), ('Lnight')) m(metric)""")
def _(cells: DataFrame) -> DataFrame:
    layers = cells.select("source").distinct().withColumn("metric", F.explode(F.array(F.lit("Lden"), F.lit("Lday"), F.lit("Lnight"))))
    return layers.select("source", "metric", ac.zero_cutoff(F.col("source"), F.col("metric")).alias("cutoff"), ac.who_limit(F.col("source"), F.col("metric")).alias("who"))


@query("prj22_source_differences", CELLS, """
with p as (select row_i, col_i, max(raw) filter (source = 'road') a, max(raw) filter (source = 'rail') b from {t} x group by 1, 2)
select row_i, col_i, round(case when a > 0 and b > 0 then b - a when b > 0 and a = 0 then b - 40 end, 4) lower_db,
  round(case when a > 0 and b > 0 then b - a when a > 0 and b = 0 then 40 - a end, 4) upper_db, (a > 0 and b > 0) inclusive
from p where (a > 0 and b >= 0) or (a = 0 and b > 0)""")
def _(cells: DataFrame) -> DataFrame:
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("raw")))
    p = cells.groupBy("row_i", "col_i").agg(of("road").alias("a"), of("rail").alias("b"))
    cut = F.lit(40.0)
    d = p.withColumn("d", ac.difference_bounds(ac.interpret(F.col("a"), cut), ac.interpret(F.col("b"), cut))).where("d is not null")
    return d.select("row_i", "col_i", F.round("d.lower_db", 4).alias("lower_db"), F.round("d.upper_db", 4).alias("upper_db"), (F.col("d.lower_inclusive") & F.col("d.upper_inclusive")).alias("inclusive"))


@query("prj26_band_words", CELLS, "with " + READ + """
select source, case when raw > 0 then ['Very quiet', 'Quiet', 'Fairly quiet', 'Moderate', 'Noticeable', 'Loud', 'Very loud', 'Extremely loud'][band + 1]
  when status = 'verified_below_cutoff' then 'Under 40 dB' else 'Not published' end word, count(*) n from c group by 1, 2""")
def _(cells: DataFrame) -> DataFrame:
    word = F.when(F.col("level").isNotNull(), ac.band_word(F.col("level"))).when(F.col("status") == "verified_below_cutoff", F.lit("Under 40 dB")).otherwise("Not published")
    return op.read(cells).groupBy("source", word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("prj26_band_labels", CELLS, "with " + READ + """
select source, case when row_i % 9 = 4 then 'outside' when col_i % 13 = 0 then 'withheld' when raw > 0 then ['Very quiet', 'Quiet', 'Fairly quiet', 'Moderate', 'Noticeable', 'Loud', 'Very loud', 'Extremely loud'][band + 1]
  when status = 'verified_below_cutoff' then 'below reporting, not silence' else 'no data' end "label", count(*) n from c group by 1, 2""")
def _(cells: DataFrame) -> DataFrame:
    label = ac.band_label(F.col("level"), F.col("status") == "verified_below_cutoff", F.col("row_i") % 9 != 4, F.col("col_i") % 13 == 0)
    return op.read(cells).groupBy("source", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("prj8_owner_tiles", CELLS, """
select 'E' || (5005 + 10000 * i) || 'N' || (5005 + 10000 * j) tile, count(*) cells from (
  select floor((530005.0 + col_i * 100.0 - 5005) / 10000)::bigint i, (ceil((179995.0 - row_i * 100.0 - 5005) / 10000) - 1)::bigint j from {t} x) group by 1""")
def _(cells: DataFrame) -> DataFrame:
    i, j = geo.owner(*centre())
    return cells.groupBy(geo.tile_id(i, j).alias("tile")).agg(F.count(F.lit(1)).alias("cells"))


@query("prj11_web_mercator", CELLS, """
with p as (select row_i, col_i, -1.0 + col_i / 1000.0 lon, 51.0 + row_i / 1000.0 lat from {t} x where source = 'road'),
m as (select *, radians(lon) * 6378137.0 mx, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) my from p),
z as (select *, floor((mx + pi() * 6378137.0) / (2 * pi() * 6378137.0 / (256 * 1024)))::bigint px, floor((pi() * 6378137.0 - my) / (2 * pi() * 6378137.0 / (256 * 1024)))::bigint py from m)
select row_i, col_i, round(mx, 3) mx, round(my, 3) my, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 6) lat_back, px >> 8 tile_x, py >> 8 tile_y, px >> 9 parent_x from z""")
def _(cells: DataFrame) -> DataFrame:
    p = cells.where("source = 'road'").select("row_i", "col_i", (F.lit(-1.0) + F.col("col_i") / F.lit(1000.0)).alias("lon"), (F.lit(51.0) + F.col("row_i") / F.lit(1000.0)).alias("lat"))
    mx, my = geo.to_mercator(F.col("lon"), F.col("lat"))
    p = p.withColumns({"mx": mx, "my": my})
    px, py = geo.pixel(F.col("mx"), F.col("my"), 10)
    _, lat = geo.from_mercator(F.col("mx"), F.col("my"))
    return p.select("row_i", "col_i", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(lat, 6).alias("lat_back"), F.shiftright(px, 8).alias("tile_x"), F.shiftright(py, 8).alias("tile_y"), F.shiftright(px, 9).alias("parent_x"))


@query("ag1_censored_combination", CELLS, "with " + BOUNDS + """
select row_i, col_i, round(lower_db, 4) lower_db, round(upper_db, 4) upper_db, round(upper_db - lower_db, 4) uncertainty_db,
  case when coalesce(road, rail, aircraft) is null then 'none-reported' when road = greatest(road, rail, aircraft) then 'road' when rail = greatest(road, rail, aircraft) then 'rail' else 'aircraft' end dominant
from d""")
def _(cells: DataFrame) -> DataFrame:
    return op.combine_censored(op.wide(cells), op.SOURCES, THRESHOLDS).select("row_i", "col_i", "dominant", *[F.round(c, 4).alias(c) for c in ("lower_db", "upper_db", "uncertainty_db")])


def bounds_of(cells: DataFrame) -> DataFrame:
    return op.combine_censored(op.wide(cells), op.SOURCES, THRESHOLDS)


@query("ag2_ag3_energy_blocks", CELLS, "with " + BOUNDS + """
select row_i // 10 row_b, col_i // 10 col_b, count(*) n, round(avg((lower_db is not null)::int), 4) reported,
  round(case when avg(lower_energy) > 0 then 10 * log10(avg(lower_energy)) end, 4) lower_db, round(10 * log10(avg(upper_energy)), 4) upper_db
from d group by 1, 2 having count(*) = 100""")
def _(cells: DataFrame) -> DataFrame:
    return op.energy_blocks(bounds_of(cells)).select("row_b", "col_b", "n", *[F.round(c, 4).alias(c) for c in ("reported", "lower_db", "upper_db")])


@query("ag4_averaged_pyramid", CELLS, "with " + READ + """,
z as (select unnest(range(0, 5)) zoom_out),
p as (select zoom_out, row_i >> zoom_out row_i, col_i >> zoom_out col_i, source, sum(coalesce(pow(10, lv / 10), 0)) energy, count(*) filter (code >= 2) land, count(*) filter (code = 1) nodata
  from c, z group by 1, 2, 3, 4),
l as (select *, case when energy > 0 and land > 0 then 10 * log10(energy / land) end lv from p)
select zoom_out::int zoom_out, row_i, col_i, source, land, nodata, round(lv, 4) mean_db,
  case when land > 0 and source <> 'aircraft' and coalesce(lv, -1e9) < 40 then 2 when land > 0 and lv is null then 3
    when land > 0 then 3 + (lv >= 40)::int + (lv >= 45)::int + (lv >= 50)::int + (lv >= 55)::int + (lv >= 60)::int + (lv >= 65)::int + (lv >= 70)::int
    when nodata > 0 then 1 else 0 end class from l""")
def _(cells: DataFrame) -> DataFrame:
    mean = F.when(F.col("land") > 0, ac.energy_to_db(F.col("energy") / F.col("land")))
    return op.pyramid(cells).select("zoom_out", "row_i", "col_i", "source", "land", "nodata", F.round(mean, 4).alias("mean_db"), "class")


@query("ag5_sampled_pyramid", CELLS, "with " + READ + """, z as (select unnest(range(0, 5)) zoom_out)
select zoom_out::int zoom_out, row_i >> zoom_out row_p, col_i >> zoom_out col_p, source, case when raw = -96 then 1 when raw = 0 then case when cutoff is not null then 2 else 1 end else 3 + band end class
from c, z where row_i % (1 << zoom_out) = (1 << zoom_out) // 2 and col_i % (1 << zoom_out) = (1 << zoom_out) // 2""")
def _(cells: DataFrame) -> DataFrame:
    return op.sampled_pyramid(cells)


HEX = """h as (select *, (sqrt(3) / 3 * e - n / 3) / 3000 x, (2.0::double / 3 * n) / 3000 zz from (select *, 530005.0::double + col_i * 100.0 e, 179995.0::double - row_i * 100.0 n from c)),
k as (select *, round_even(x, 0) rx, round_even(-x - zz, 0) ry, round_even(zz, 0) rz, abs(round_even(x, 0) - x) dx, abs(round_even(-x - zz, 0) + x + zz) dy, abs(round_even(zz, 0) - zz) dz from h),
g as (select *, (case when dx > dy and dx > dz then -ry - rz else rx end)::bigint q, (case when not (dx > dy and dx > dz) and not dy > dz then -rx - ry else rz end)::bigint r from k)"""


@query("ag6_prj9_hexagons", CELLS, "with " + READ + ", " + HEX + """
select q, r, source, count(lv) value_cells, count(*) filter (status = 'verified_below_cutoff') below_cells, count(*) filter (status = 'unreported_unknown') nodata_cells,
  count(*) filter (lv >= 55) cells_ge_55, count(*) filter (lv >= case source when 'road' then 53 when 'rail' then 54 else 45 end) cells_ge_who,
  round(case when count(lv) > 0 then 10 * log10(sum(pow(10, lv / 10)) / count(*) filter (status <> 'unreported_unknown')) end, 4) mean_db,
  round(count(*) filter (lv >= 55) / nullif(count(*) filter (status <> 'unreported_unknown'), 0), 4) share_ge_55
from g group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    q, r = geo.hex_key(*centre())
    return op.hexagons(cells, q, r).drop("energy_sum").withColumns(r4("mean_db", "share_ge_55"))


@query("prj10_hexagon_corners", CELLS, "with " + READ + ", " + HEX + """
select q, r, i::int corner, round(3000 * sqrt(3) * (q + r / 2) + 3000 * cos(radians(60 * i - 30)), 3) x, round(4500.0 * r + 3000 * sin(radians(60 * i - 30)), 3) y
from (select distinct q, r from g), (select unnest(range(0, 6)) i)""")
def _(cells: DataFrame) -> DataFrame:
    q, r = geo.hex_key(*centre())
    hexes = cells.select(q.alias("q"), r.alias("r")).distinct()
    out = hexes.select("q", "r", F.posexplode(geo.hex_corners(F.col("q"), F.col("r"))).alias("corner", "p"))
    return out.select("q", "r", "corner", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("ag7_area_summary", CELLS, "with " + READ + """
select source, count(*) cells, count(lv) value_cells, count(*) filter (status = 'verified_below_cutoff') below_cells, count(*) filter (status = 'unreported_unknown') unknown_cells,
  """ + ", ".join(f"count(*) filter (band = {i}) band_{i}" for i in range(8)) + """,
  round(count(*) filter (lv >= 55) / count(*) filter (status <> 'unreported_unknown'), 4) share_ge_level,
  round(count(*) filter (lv >= case source when 'road' then 53 when 'rail' then 54 else 45 end) / count(*) filter (status <> 'unreported_unknown'), 4) share_ge_who,
  round(10 * log10(sum(pow(10, lv / 10)) / count(*) filter (status <> 'unreported_unknown')), 4) average_lower_db,
  round(10 * log10((sum(pow(10, lv / 10)) + coalesce(sum(pow(10, cutoff / 10)) filter (status = 'verified_below_cutoff'), 0)) / count(*) filter (status <> 'unreported_unknown')), 4) average_upper_db
from c group by 1""")
def _(cells: DataFrame) -> DataFrame:
    return op.area_summary(cells).withColumns(r4("share_ge_level", "share_ge_who", "average_lower_db", "average_upper_db"))


@query("ag8_censored_median", CELLS, "with " + READ + """,
o as (select source, code, row_number() over (partition by source order by code) i, count(*) over (partition by source) n from c where code > 1)
select source, n calculated, case when code >= 3 then (code - 3) / 100.0::double end median_db, code = 2 below_cutoff from o where i = ceil(n / 2)""")
def _(cells: DataFrame) -> DataFrame:
    return op.censored_median(cells)


@query("ag9_level_percentiles", CELLS, """
select source, count(*) n, min(raw) min_db, max(raw) max_db, round(avg(raw), 4) mean_db, """ + ", ".join(f"round(quantile_cont(raw, {p}), 4) p{round(p * 100)}" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + """
from {t} x where raw > 0 group by 1""")
def _(cells: DataFrame) -> DataFrame:
    shares = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    return op.level_statistics(cells, ["source"], shares).withColumns(r4("mean_db", *[f"p{round(p * 100)}" for p in shares]))


@query("ag10_histogram", CELLS, """
with b as (select source, ((raw >= 50)::int + (raw >= 60)::int + (raw >= 70)::int)::int bin, count(*) n from {t} x where raw between 40 and 80 group by 1, 2)
select source, bin, n, (40 + 10 * bin)::double low, round(n / sum(n) over (partition by source), 6) share from b""")
def _(cells: DataFrame) -> DataFrame:
    return op.histogram(cells, (40, 50, 60, 70, 80)).withColumn("share", F.round("share", 6))


@query("ag11_semantic_checks", CELLS, "with " + BOUNDS + """
select row_i // 10 tile_row, count(*) cells, count(*) filter (upper_db is null) upper_missing, count(*) filter (lower_db > upper_db + 1e-9) lower_above_upper,
  0::bigint value_without_source, 0::bigint source_without_value, count(*) filter (lower_db < 0 or upper_db > 160) out_of_range from d group by 1""")
def _(cells: DataFrame) -> DataFrame:
    return op.semantic_checks(bounds_of(cells), [F.floor(F.col("row_i") / 10).cast("long").alias("tile_row")])


#: The coarse product's bands, with every kind of fault in some places.
BANDS = """
select cast(floor(k / 120.0) as bigint) row_i, mod(k, 120) col_i, mod(k, 10) <> 0 land,
  case when mod(k, 31) = 0 then cast(-9999 as double) when mod(k, 211) = 0 then cast('NaN' as double) when mod(k, 227) = 0 then cast(151 as double) when mod(k, 223) = 0 then cast(0 as double) when mod(k, 10) = 0 and mod(k, 3) <> 0 then cast(-9999 as double) else cast(50 + mod(v, 30) as double) end combined_lower,
  case when mod(k, 229) = 0 or (mod(k, 10) = 0 and mod(k, 3) <> 0) then cast(-9999 as double) when mod(k, 233) = 0 then cast(42 as double) else cast(45 + mod(v, 35) as double) end road_rail_upper,
  case when mod(k, 10) = 0 or mod(v, 4) <> 0 then cast(-9999 as double) else cast(50 + mod(v, 33) as double) end airport_lower,
  case when mod(k, 10) = 0 or mod(k, 239) = 0 then cast(-9999 as double) when mod(k, 241) = 0 then cast(1.5 as double) when mod(v, 4) = 0 and mod(k, 37) <> 0 then cast(mod(v, 8) + 1 as double) / 16 when mod(k, 41) = 0 then cast(0.25 as double) else cast(0 as double) end airport_fraction,
  case when mod(k, 10) = 0 or mod(k, 251) = 0 then cast(-9999 as double) else cast(60 + mod(v, 40) as double) end combined_upper
from (select o_orderkey k, cast(round(o_totalprice * 100) as bigint) v from {orders}) q
"""


@query("ag11_band_checks", BANDS, """
with k as (select *, isfinite(combined_lower) f0, isfinite(road_rail_upper) f1, isfinite(airport_lower) f2, isfinite(airport_fraction) f3, isfinite(combined_upper) f4 from {t} x),
v as (select *, land and f0 and combined_lower <> -9999 v0, land and f1 and road_rail_upper <> -9999 v1, land and f2 and airport_lower <> -9999 v2, land and f3 and airport_fraction <> -9999 v3, land and f4 and combined_upper <> -9999 v4 from k),
c as (select row_i // 10 tile_row, count(*) cells,
  count(*) filter (not land and combined_lower <> -9999) + count(*) filter (not land and road_rail_upper <> -9999) + count(*) filter (not land and airport_lower <> -9999) + count(*) filter (not land and airport_fraction <> -9999) + count(*) filter (not land and combined_upper <> -9999) outside_values,
  count(*) filter (not f0) + count(*) filter (not f1) + count(*) filter (not f2) + count(*) filter (not f3) + count(*) filter (not f4) not_finite,
  count(*) filter (land and combined_lower = -9999) + count(*) filter (land and road_rail_upper = -9999) + count(*) filter (land and airport_lower = -9999) + count(*) filter (land and airport_fraction = -9999) + count(*) filter (land and combined_upper = -9999) nodata_on_land,
  count(*) filter (land and not v3) fraction_missing, count(*) filter (v3 and (airport_fraction < -1e-5 or airport_fraction > 1 + 1e-5)) fraction_out_of_range, count(*) filter (land and airport_fraction = 0 and v2) fraction_zero_with_airport,
  count(*) filter (v3 and airport_fraction > 0 and not v2) fraction_without_airport, count(*) filter (v2 and not v0) airport_without_combined, count(*) filter (v0 and v2 and combined_lower + 1e-5 < airport_lower) combined_below_airport,
  count(*) filter (land and not v1) upper_missing, count(*) filter (v1 and road_rail_upper + 1e-5 < 10 * log10(2e4)) upper_below_floor,
  count(*) filter (v0 and combined_lower not between 0 and 150) + count(*) filter (v1 and road_rail_upper not between 0 and 150) + count(*) filter (v2 and airport_lower not between 0 and 150) + count(*) filter (v4 and combined_upper not between 0 and 150) impossible,
  count(*) filter (v0 and combined_lower = 0) + count(*) filter (v1 and road_rail_upper = 0) + count(*) filter (v2 and airport_lower = 0) + count(*) filter (v4 and combined_upper = 0) zeros,
  count(*) filter (land and not v4) combined_upper_missing, count(*) filter (v4 and v0 and combined_upper + 1e-5 < combined_lower) combined_upper_below_lower, count(*) filter (v4 and v1 and combined_upper + 1e-5 < road_rail_upper) combined_upper_below_road_rail from v group by 1)
select *, outside_values + not_finite + fraction_missing + fraction_out_of_range + fraction_zero_with_airport + fraction_without_airport + airport_without_combined + combined_below_airport + upper_missing + upper_below_floor + impossible + zeros + combined_upper_missing + combined_upper_below_lower + combined_upper_below_road_rail = 0 sound from c""")
def _(bands: DataFrame) -> DataFrame:
    return op.band_checks(bands, [F.floor(F.col("row_i") / 10).cast("long").alias("tile_row")], (40.0, 40.0))


def states_of(cells: DataFrame) -> DataFrame:
    """A state for each tile and source, made from the tile's number."""
    own = cells.select(*op.tile_columns(), "source").distinct()
    n = F.col("tile_row") * 1000 + F.col("tile_col") + F.length("source")
    return own.withColumn("state", F.when(n % 7 == 0, "rejected").when(n % 5 == 0, "outside").otherwise("accepted"))


STATES = """s as (select distinct row_i // 10 tile_row, col_i // 10 tile_col, source from {t} x),
st as (select *, case when (tile_row * 1000 + tile_col + length(source)) % 7 = 0 then 'rejected' when (tile_row * 1000 + tile_col + length(source)) % 5 = 0 then 'outside' else 'accepted' end state from s)"""


@query("ag12_availability_rollup", CELLS, "with " + READ + ", " + STATES + """
select source, state qualification, case status when 'reported_model_value' then 'value' when 'verified_below_cutoff' then 'below' else 'missing' end availability, count(*) n
from c join st using (source) where st.tile_row = row_i // 10 and st.tile_col = col_i // 10 group by rollup (source, qualification, availability)""")
def _(cells: DataFrame) -> DataFrame:
    return op.availability(cells, states_of(cells).select("tile_row", "tile_col", "source", F.col("state").alias("qualification")))


@query("ag12_reconciled_availability", CELLS, "with " + READ + ", " + STATES + """
select source, state qualification, case status when 'reported_model_value' then 'value' when 'verified_below_cutoff' then 'below' else 'missing' end availability, count(*) n
from c join st using (source) where st.tile_row = row_i // 10 and st.tile_col = col_i // 10 group by rollup (source, qualification, availability)""")
def _(cells: DataFrame) -> DataFrame:
    """The cross-table with its subtotals held against the cells of each source."""
    table = op.availability(cells, states_of(cells).select("tile_row", "tile_col", "source", F.col("state").alias("qualification")))
    expected = cells.groupBy("source").agg(F.count(F.lit(1)).alias("cells"))
    return op.reconciled(table, expected, ["source", "qualification", "availability"], "source")


@query("ag13_band_qualification", CELLS, "with " + STATES + """, d(source, band) as (values ('road', 'road_rail_upper'), ('rail', 'road_rail_upper'), ('aircraft', 'airport_lower'), ('road', 'combined_lower'), ('rail', 'combined_lower'), ('aircraft', 'combined_lower'))
select tile_row, tile_col, band, case max(case state when 'rejected' then 2 when 'outside' then 1 else 0 end) when 2 then 'withheld' when 1 then 'limited' else 'qualified' end qualification
from st join d using (source) group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    depends = [("road", "road_rail_upper"), ("rail", "road_rail_upper"), ("aircraft", "airport_lower"), *[(s, "combined_lower") for s in op.SOURCES]]
    return op.band_qualification(states_of(cells), cells.sparkSession.createDataFrame(depends, "source string, band string"))


@query("ag14_joint_support", CELLS, """
with m as (select row_i, col_i, sum(case when raw > 0 then case source when 'road' then 1 when 'rail' then 2 else 4 end else 0 end)::int mask from {t} x group by 1, 2)
select mask, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from m group by 1""")
def _(cells: DataFrame) -> DataFrame:
    return op.joint_support(cells).withColumn("share", F.round("share", 6))


@query("tk1_extremes", CELLS, """
with e as (select source, d.direction, case d.direction when 'high' then -raw else raw end o, row_i, col_i, raw from {t} x, (values ('high'), ('low')) d(direction) where raw > 0),
r as (select *, row_number() over (partition by source, direction order by o, row_i, col_i)::int rank from e)
select source, direction, rank, row_i, col_i, raw from r where rank <= 20""")
def _(cells: DataFrame) -> DataFrame:
    return op.extremes(cells)


@query("tk2_loudest_cell", CELLS, """
with t as (select source, max(raw) raw from {t} x group by 1)
select source, raw, first(row_i order by row_i, col_i) row_i, first(col_i order by row_i, col_i) col_i, count(*) ties from {t} x join t using (source, raw) group by 1, 2""")
def _(cells: DataFrame) -> DataFrame:
    return op.loudest(cells)


@query("tk8_repeated_values", CELLS, """
select source, raw, n, rank from (select source, raw, count(*) n, row_number() over (partition by source order by count(*) desc, raw)::int rank from {t} x where raw > 0 group by 1, 2) where rank <= 12""")
def _(cells: DataFrame) -> DataFrame:
    return op.repeated_values(cells)


@query("wn12_moving_means", CELLS, """
select a.row_i, a.col_i, a.source, count(*) filter (b.raw > 0) n, sum(round(b.raw * 100)::bigint) filter (b.raw > 0)::double / 100 / count(*) filter (b.raw > 0) mean_db
from {t} a join {t} b on a.source = b.source and b.row_i between a.row_i - 2 and a.row_i + 2 and b.col_i between a.col_i - 2 and a.col_i + 2 group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    return op.moving_means(cells)


@query("wn13_square_range", CELLS, """
select a.row_i, a.col_i, a.source, min(b.raw) filter (b.raw > 0) low, max(b.raw) filter (b.raw > 0) high
from {t} a join {t} b on a.source = b.source and b.row_i between a.row_i - 1 and a.row_i + 1 and b.col_i between a.col_i - 1 and a.col_i + 1 group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    return op.square_range(cells)


@query("wn14_row_clearance", CELLS, """
select a.row_i, a.col_i, a.source, min(abs(b.col_i - a.col_i)) clearance
from {t} a left join {t} b on a.source = b.source and a.row_i = b.row_i and b.raw >= 75 group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    return op.row_clearance(cells, F.col("raw") >= 75)


@query("rs2_clearance", CELLS, """
select a.row_i, a.col_i, a.source, min((b.col_i - a.col_i) ** 2 + (b.row_i - a.row_i) ** 2)::bigint d2
from {t} a left join {t} b on a.source = b.source and b.raw >= 75 and b.row_i between a.row_i - 4 and a.row_i + 4 and (b.col_i - a.col_i) ** 2 + (b.row_i - a.row_i) ** 2 <= 16 group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    return op.clearance(cells, F.col("raw") >= 75, 4)


@query("tk3_quietest_place", CELLS, """
with d as (select a.row_i, a.col_i, a.source, min((b.col_i - a.col_i) ** 2 + (b.row_i - a.row_i) ** 2)::bigint d2
  from {t} a left join {t} b on a.source = b.source and b.raw >= 75 and b.row_i between a.row_i - 6 and a.row_i + 6 and (b.col_i - a.col_i) ** 2 + (b.row_i - a.row_i) ** 2 <= 36 where a.raw > 0 and a.raw < 50 group by 1, 2, 3),
o as (select *, row_number() over (partition by source order by d2 is not null, coalesce(d2, 36) desc, row_i, col_i) n from d)
select row_i, col_i, source, coalesce(d2, 36) d2, d2 is not null exact from o where n = 1""")
def _(cells: DataFrame) -> DataFrame:
    return op.quietest(cells, 6, (F.col("raw") > 0) & (F.col("raw") < 50), F.col("raw") >= 75)


def other_release(cells: DataFrame) -> DataFrame:
    """A second release: some cells changed, masked or gone."""
    n = F.col("row_i") * 120 + F.col("col_i")
    raw = F.when(n % 97 == 0, F.lit(ac.NODATA)).when((n % 41 == 0) & (F.col("raw") > 0), F.col("raw") + 0.5).otherwise(F.col("raw"))
    return cells.where(n % 53 != 0).withColumn("raw", raw)


@query("jn13_rs8_seam_differences", CELLS, """
with a as (select * from {t} x where (row_i * 120 + col_i) % 59 <> 0),
b as (select row_i, col_i, source, case when (row_i * 120 + col_i) % 97 = 0 then -96 when (row_i * 120 + col_i) % 41 = 0 and raw > 0 then raw + 0.5 else raw end raw from {t} x where (row_i * 120 + col_i) % 53 <> 0),
j as (select coalesce(a.source, b.source) source, a.raw ra, b.raw rb from a full join b using (row_i, col_i, source))
select source, count(*) filter (ra = rb) equal, count(*) filter ((ra = -96) <> (rb = -96)) mask_differs, count(*) filter (ra <> rb and (ra = -96) = (rb = -96)) value_differs,
  count(*) filter (rb is null) only_left, count(*) filter (ra is null) only_right, round(max(abs(ra - rb)) filter ((ra = -96) = (rb = -96)), 4) max_difference from j group by 1""")
def _(cells: DataFrame) -> DataFrame:
    return op.seam_differences(cells.where("(row_i * 120 + col_i) % 59 <> 0"), other_release(cells)).withColumn("max_difference", F.round("max_difference", 4))


@query("rs7_rs9_mosaic_faults", CELLS, """
with p as (select * from {t} x where (row_i * 120 + col_i) % 211 <> 0 union all select * from {t} x where (row_i * 120 + col_i) % 307 = 0),
w as (select r.range row_i, c.range col_i, s.source from range(0, (select max(row_i) + 1 from {t} x)) r, range(0, 120) c, (values ('road'), ('rail'), ('aircraft')) s(source))
select w.row_i, w.col_i, w.source, count(p.raw) times from w left join p using (row_i, col_i, source) group by 1, 2, 3 having count(p.raw) <> 1""")
def _(cells: DataFrame) -> DataFrame:
    n = F.col("row_i") * 120 + F.col("col_i")
    parts = cells.where(n % 211 != 0).union(cells.where(n % 307 == 0))
    return op.mosaic(parts, cells.agg(F.max("row_i")).first()[0] + 1, 120)


@query("ag42_coarse_bounds", CELLS, "with " + BOUNDS + """
select row_i // 4 row_i, col_i // 4 col_i, round(case when avg(lower_energy) > 0 then 10 * log10(avg(lower_energy)) end, 4) lower_db, round(10 * log10(avg(upper_energy)), 4) upper_db,
  max(case when lower_db is null then 2 when lower_db < 50 then 1 else 0 end)::int quality from d group by 1, 2""")
def _(cells: DataFrame) -> DataFrame:
    quality = F.when(F.col("lower_db").isNull(), 2).when(F.col("lower_db") < 50, 1).otherwise(0)
    return op.coarse_bounds(bounds_of(cells), quality).withColumns(r4("lower_db", "upper_db"))


@query("jn1_jn25_places_compared", CELLS, "with " + READ + """,
p as (select row_i, col_i, dense_rank() over (order by row_i, col_i) - 1 place from (select distinct row_i, col_i from c where (row_i * 120 + col_i) % 50 = 0)),
a as (select place, source, status, lv, case when lv is not null then lv when status = 'verified_below_cutoff' then cutoff end up from p join c using (row_i, col_i)),
j as (select a.*, f.lv lv0, f.up up0 from a join a f on a.source = f.source and f.place = 0)
select place, source, status, lv value_db, round(lv - up0, 4) lower_db, round(up - lv0, 4) upper_db,
  coalesce(lv is not null and lv0 is not null, false) lower_inclusive from j""")
def _(cells: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    places = cells.select("row_i", "col_i").where((F.col("row_i") * 120 + F.col("col_i")) % 50 == 0).distinct()
    first = W.partitionBy("row_i").orderBy("col_i")
    before = F.sum("n").over(W.orderBy("row_i")) - F.col("n")  # a row per row of cells
    rows = places.groupBy("row_i").agg(F.count(F.lit(1)).alias("n")).select("row_i", before.alias("before"))
    places = places.withColumn("nth", F.row_number().over(first)).join(rows, "row_i").select("row_i", "col_i", (F.col("before") + F.col("nth") - 1).alias("place"))
    out = op.place_differences(places, cells).drop("upper_inclusive")
    return out.withColumns({**r4("lower_db", "upper_db"), "lower_inclusive": F.coalesce("lower_inclusive", F.lit(False)), "place": F.col("place").cast("long")})


@query("ag43_tile_quality", CELLS, """
select row_i // 10 tile_row, col_i // 10 tile_col, source, count(*) filter (raw > 0) reported, count(*) filter (raw = 0) zeros, count(*) filter (raw = -96) nodata,
  min(raw) filter (raw > 0) min_db, max(raw) filter (raw > 0) max_db from {t} x group by 1, 2, 3""")
def _(cells: DataFrame) -> DataFrame:
    tiles = cells.withColumns({"tile_row": F.floor(F.col("row_i") / 10).cast("long"), "tile_col": F.floor(F.col("col_i") / 10).cast("long")})
    value = F.when(F.col("raw") > 0, F.col("raw"))
    return tiles.groupBy("tile_row", "tile_col", "source").agg(
        F.count(value).alias("reported"), F.count_if(F.col("raw") == 0).alias("zeros"), F.count_if(F.col("raw") == ac.NODATA).alias("nodata"), F.min(value).alias("min_db"), F.max(value).alias("max_db")
    )
