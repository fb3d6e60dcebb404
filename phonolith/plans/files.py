"""Readers and sinks over files that are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.plans.registry import query
from phonolith.plans.temporal import CURVES
from phonolith.sources import fixtures as fx
from phonolith.sources import readers, sinks
from phonolith.sources.scratch import folder

#: Count points as text, some with a fault.
FLOWS = """
select cast(case when mod(p_partkey, 41) = 0 then ' ' else concat('P', p_partkey) end as string) count_point_id, case when mod(p_partkey, 13) = 0 then '2020' when mod(p_partkey, 37) = 0 then 'x' else '2021' end as year, 'Minor' road_type, p_brand road_name,
  case when mod(p_partkey, 17) = 0 then '' else cast(530000 + mod(p_partkey * 7919, 20000) as string) end easting, cast(170000 + mod(p_partkey, 20000) as string) northing,
  case when mod(p_partkey, 11) = 0 then '0' when mod(p_partkey, 19) = 0 then 'nan' else cast(mod(p_partkey * 7, 900) + 1 as string) end all_motor_vehicles, case when mod(p_partkey, 3) = 0 then '' else cast(mod(p_partkey, 50) as string) end pedal_cycles,
  '1' two_wheeled_motor_vehicles, '2' cars_and_taxis, '3' buses_and_coaches, '4' lgvs, '5' all_hgvs from {part}
"""
COLUMNS = ["count_point_id", "year", "road_type", "road_name", "easting", "northing", "all_motor_vehicles", *readers.CATEGORIES]
F_SQL = f"({fx.plain(FLOWS)})"
REASON = """case when try_cast("year" as int) <> 2021 then 'other_year' when try_cast("year" as int) is null then 'no_year' when trim(count_point_id) = '' then 'no_identity'
  when all_motor_vehicles = 'nan' or try_cast(all_motor_vehicles as double) <= 0 then 'no_flow' when easting = '' then 'no_position' end"""


def flows(spark, d):
    path = folder(spark)
    fx.derived(spark, d, FLOWS).select(COLUMNS).write.csv(path, header=True)
    return readers.annual_flows(readers.csv(spark, path, COLUMNS), 2021)


@query("src2_annual_flows", sql=f"""
select count_point_id, road_name, all_motor_vehicles::double flow, easting::double x, northing::double y, nullif(pedal_cycles, '')::double pedal_cycles from {F_SQL} q where {REASON} is null""")
def _(spark, d):
    return flows(spark, d)[0].select("count_point_id", "road_name", "flow", "x", "y", F.col("categories")["pedal_cycles"].alias("pedal_cycles"))


@query("src2_rejected_flows", sql=f"""select {REASON} reason, count(*) "rows" from {F_SQL} q where {REASON} is not null group by 1""")
def _(spark, d):
    return flows(spark, d)[1]


@query("src4_hour_index", fx.COUNTS, "with " + CURVES.replace("{one}", "1").replace("{days}", "(select range n from range(1, 8))").replace("{hours}", "(select range n from range(0, 24))") + """
select vehicle_group, ['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday'][weekday] weekday, hr::int "hour", idx "index" from p""")
def _(x):
    spark, path = x.sparkSession, folder(x.sparkSession)
    curves = CURVES.replace("{one}", "0").replace("{days}", "(select explode(sequence(1, 7)) n)").replace("{hours}", "(select explode(sequence(0, 23)) n)").replace("{t} x", "{t}")
    wide = spark.sql("with " + curves + " select vehicle_group, hr as hour, weekday, idx from p", t=x).groupBy("vehicle_group", "hour").pivot("weekday", list(range(1, 8))).agg(F.first("idx"))
    names = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
    wide.select("vehicle_group", "hour", *[F.col(str(i + 1)).alias(n) for i, n in enumerate(names)]).write.csv(path, header=True)
    return readers.hour_index(readers.csv(spark, path, ["vehicle_group", "hour", *names]))


@query("src5_manifests", sql="""
select 'T' || s_suppkey tile, b.band, case when s_suppkey % 3 = 0 then 'missing' else 'ready' end status, sha256(s_suppkey || b.band) sha256, count(*) over (partition by s_nationkey) tiles from supplier, (values ('lden'), ('lnight')) b(band)""")
def _(spark, d):
    """A manifest for each nation, keys in any order, read strictly; tiles of a manifest are counted by its digest."""
    path, s = folder(spark), spark.read.parquet(f"{d}/supplier.parquet")
    band = lambda b: F.struct(F.sha2(F.concat(F.col("s_suppkey").cast("string"), F.lit(b)), 256).alias("sha256"), F.when(F.col("s_suppkey") % 3 == 0, "missing").otherwise("ready").alias("status"))
    tile = F.struct(F.concat(F.lit("T"), "s_suppkey").alias("key"), F.struct(F.create_map(F.lit("lnight"), band("lnight"), F.lit("lden"), band("lden")).alias("bands")).alias("value"))
    whole = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(tile)).alias("tiles"))).alias("value"))
    whole.select("value").write.text(path)
    read = readers.identified_manifests(spark, path, lines=True)
    sizes = read.groupBy("digest").agg(F.count(F.lit(1)).alias("tiles"))
    return read.join(sizes, "digest").drop("digest")


@query("src11_cells_of_window", fx.CELLS, """
select row_i, col_i, source, raw from {t} x where 530000 + col_i * 10 + 5 >= 530300 and 530000 + col_i * 10 + 5 < 530700 and 180000 - row_i * 10 - 5 > 179600 and 180000 - row_i * 10 - 5 <= 179900""")
def _(cells):
    """Published as files by position, read back by a window."""
    path = folder(cells.sparkSession)
    placed = cells.withColumns({"easting": 530000.0 + F.col("col_i") * 10 + 5, "northing": 180000.0 - F.col("row_i") * 10 - 5})
    sinks.publish(placed.repartitionByRange("northing", "easting").sortWithinPartitions("northing", "easting"), path)
    return readers.in_window(cells.sparkSession.read.parquet(path), 530300.0, 179600.0, 530700.0, 179900.0).select("row_i", "col_i", "source", "raw")


@query("snk3_snk4_field_rows", sql="""
with l as (select n_nationkey "key", case when n_nationkey % 5 = 0 then '=' || n_name when n_nationkey % 5 = 1 then ' @x' else n_name end name, n_regionkey from nation),
s as (select "key", case when regexp_matches(ltrim(name), '^[=+@-]') then '''' || name else name end name, n_regionkey from l)
select "key", 'name' field, name "value" from s union all select "key", 'region', n_regionkey::varchar from s""")
def _(spark, d):
    n, path = spark.read.parquet(f"{d}/nation.parquet"), folder(spark)
    name = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("="), "n_name")).when(F.col("n_nationkey") % 5 == 1, " @x").otherwise(F.col("n_name"))
    rows = sinks.field_rows(n.select(F.col("n_nationkey").alias("key"), sinks.safe_label(name).alias("name"), F.col("n_regionkey").alias("region")), "key")
    sinks.publish(rows, path)
    return spark.read.parquet(path)
