"""Readers, sinks, intervals, streams, joins and models on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.functions import geometry as geo
from phonolith.operators import models, quality, spatial, temporal
from phonolith.sources import readers, sinks
from phonolith.streaming import intervals as streams

LINE = "0204037720999992021010100004+51483-000450FM-12+002599999V0203601N001010012019N005000199+00051-00051100931ADDAA106000091MA1999999100621REMSYN003MA1"
INTERVAL = "receiver_id long, start_s long, end_s long, level_db double"


def test_long_quiet_and_short_loud(spark):
    x = spark.createDataFrame([(1, 0, 86390, 30.0), (1, 86390, 86400, 120.0), (2, 0, 100, 20.0), (2, 200, 400, 20.0), (3, 0, 8640, 20.0), (3, 8640, 86400, 60.0)], INTERVAL)
    got = {r.receiver_id: r for r in temporal.summary(x).collect()}
    assert abs(got[1].laeq_db - 80.6349000937493) < 1e-9 and got[1].laeq_full_db == got[1].laeq_db and got[1].quiet_s == 86390
    assert got[2].laeq_full_db is None and got[2].gaps == 1 and got[2].coverage == 0.75
    assert {r.receiver_id: r.longest_quiet_s for r in temporal.quiet_runs(x).collect()} == {1: 86390, 2: 200, 3: 8640}
    la = {r.receiver_id: (r.la90, r.la50) for r in temporal.exceedance(x, {"la90": 0.1, "la50": 0.5}).collect()}
    assert la[1] == (30.0, 30.0) and la[3] == (20.0, 60.0)


def run_stream(spark, tmp_path, batches, build, mode):
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, INTERVAL).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(INTERVAL).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    q = build(stream).writeStream.format("memory").queryName("heard").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("heard").collect()


def test_stream_windows_equal_the_table(spark, tmp_path):
    rows = [(r, s * 700, s * 700 + 500, 40.0 + s % 7) for r in (1, 2) for s in range(60)]
    got = run_stream(spark, tmp_path, [rows[:60], rows[60:], [(1, 10**6, 10**6 + 10, 50.0)]], lambda x: streams.windowed_levels(x, 3600), "append")
    want = {(r.receiver_id, r.from_ts): r for r in streams.windowed_levels(spark.createDataFrame(rows, INTERVAL), 3600).collect()}
    assert len(got) == len(want) and all(abs(want[r.receiver_id, r.from_ts].laeq_db - r.laeq_db) < 1e-9 for r in got)


def test_stream_keeps_runs_over_batches(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[(1, 0, 100, 30.0), (1, 100, 200, 30.0)], [(1, 200, 300, 30.0), (1, 50, 60, 30.0)], [(1, 300, 310, 90.0), (1, 400, 900, 30.0)]], streams.quiet_runs, "update")
    assert max(r.longest_quiet_s for r in got) == 500 and sorted(r.longest_quiet_s for r in got)[:2] == [200, 300]


def test_weather_line(spark):
    r = readers.weather(spark.createDataFrame([(LINE,), ("short",)], "value string")).collect()
    assert len(r) == 1 and (r[0].station, r[0].report_type) == ("03772099999", "FM-12") and str(r[0].ts) == "2021-01-01 00:00:00"
    assert abs(r[0].temperature_c - 0.5) < 1e-9 and abs(r[0].dewpoint_c + 0.5) < 1e-9 and abs(r[0].sea_level_kpa - 100.93) < 1e-9 and abs(r[0].station_kpa - 100.62) < 1e-9 and r[0].wind_m_s == 1.0


def test_flows_count_rejects_and_refuse_duplicates(spark, tmp_path):
    columns = ["count_point_id", "year", "road_type", "road_name", "easting", "northing", "all_motor_vehicles", *readers.CATEGORIES]
    rows = [["1", "2021", "Minor", "C", "1", "2", "100", "5", "", "80", "1", "x", "3"], ["2", "2020", "Minor", "U", "1", "2", "5", *["1"] * 6], ["3", "2021", "Minor", "U", "", "2", "5", *["1"] * 6], ["4", "2021", "Minor", "U", "1", "2", "nan", *["1"] * 6]]
    path = tmp_path / "f.csv"
    path.write_text("\n".join(",".join(r) for r in [columns, *rows]))
    kept, rejects = readers.annual_flows(readers.csv(spark, str(path), columns), 2021)
    got = kept.collect()
    assert len(got) == 1 and got[0].categories["two_wheeled_motor_vehicles"] is None and got[0].categories["lgvs"] is None and got[0].categories["cars_and_taxis"] == 80.0
    assert {r.reason: r.rows for r in rejects.collect()} == {"other_year": 1, "no_position": 1, "no_flow": 1}
    path.write_text("\n".join(",".join(r) for r in [columns, rows[0], rows[0]]))
    with pytest.raises(Exception, match="duplicate count point"):
        readers.annual_flows(readers.csv(spark, str(path), columns), 2021)[0].collect()
    path.write_text("\n".join(",".join(r) for r in [columns[::-1], rows[0]]))
    with pytest.raises(Exception):
        readers.csv(spark, str(path), columns).collect()


def test_profile_manifest_tiles_and_grid(spark, tmp_path):
    rows = [("cars", str(h), *[str(h + d) for d in range(7)]) for h in range(24)]
    schema = "vehicle_group string, hour string, " + ", ".join(f"{d} string" for d in readers.DAYS)
    assert readers.hour_index(spark.createDataFrame(rows, schema)).count() == 168
    with pytest.raises(Exception, match="incomplete profile"):
        readers.hour_index(spark.createDataFrame(rows[1:], schema)).collect()
    (tmp_path / "m.json").write_text(json.dumps({"tiles": {"a": {"bands": {"x": {"status": "ok", "sha256": "1"}, "y": {"status": "bad", "sha256": "2"}}}}}))
    assert sorted(map(tuple, readers.manifest(spark, str(tmp_path / "m.json")).collect())) == [("a", "x", "ok", "1"), ("a", "y", "bad", "2")]
    tile = spark.createDataFrame([("t", "road", 100, 200, 2, [50.0, 0.0, 60.0, 70.0], [True, True, False, True])], "tile string, source string, west int, top int, n_cols int, values array<float>, valid array<boolean>")
    got = [(r.row_i, r.col_i, r.easting, r.northing, r.raw) for r in readers.cells(tile).collect()]
    assert got == [(0, 0, 105.0, 195.0, 50.0), (0, 1, 115.0, 195.0, 0.0), (1, 0, 105.0, 185.0, -96.0), (1, 1, 115.0, 185.0, 70.0)]
    assert readers.in_window(readers.cells(tile), 105, 185, 115, 195).count() == 1
    grid = readers.grid(spark, (150, 150, 2450, 1950), 1000).collect()
    assert len(grid) == 6 and min(r.minx for r in grid) == 100 and max(r.maxx for r in grid) == 2500 and sum((r.maxx - r.minx) * (r.maxy - r.miny) for r in grid) == 2400 * 1900


def test_sinks(spark, tmp_path):
    labels = spark.createDataFrame([("=1+1",), (" @x",), ("plain",)], "s string").select(sinks.safe_label(F.col("s"))).collect()
    assert [r[0] for r in labels] == ["'=1+1", "' @x", "plain"]
    feature = json.loads(spark.range(1).select(sinks.hex_feature(geo.hex_corners(F.lit(0), F.lit(0)), F.struct(F.lit(1).alias("n")))).first()[0])
    assert feature["properties"] == {"n": 1} and len(feature["geometry"]["coordinates"][0]) == 7 and feature["geometry"]["coordinates"][0][0] == feature["geometry"]["coordinates"][0][-1]
    path = str(tmp_path / "out")
    sinks.publish(spark.range(3).toDF("x"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(5).toDF("x"), path)


LINKS = "link_id long, road_class string, x1 double, y1 double, x2 double, y2 double"


def test_count_linkage_accepts_only_the_clear_case(spark):
    point = spark.createDataFrame([(1, 100.0, 2.0, 900.0)], "point_id long, x double, y double, flow double")
    road = [(1, "minor", 0.0, 0.0, 200.0, 0.0)]
    got = spatial.link_counts(point, spark.createDataFrame(road, LINKS)).first()
    assert (got.accepted_link_id, got.dist, got.clearance, got.reason) == (1, 2.0, 100.0, "unique_local_geometric_support")
    got = spatial.link_counts(point, spark.createDataFrame([*road, (2, "minor", 0.0, 8.0, 200.0, 8.0)], LINKS)).first()
    assert got.accepted_link_id is None and got.margin == 4.0 and got.reason == "competing_road_ambiguous"
    two = point.union(spark.createDataFrame([(2, 90.0, 1.0, 900.0)], point.schema))
    assert {r.reason for r in spatial.link_counts(two, spark.createDataFrame(road, LINKS)).collect()} == {"multiple_count_points_on_one_link"}


def test_matching_ignores_order(spark):
    rng = np.random.default_rng(1)
    links = [(i, int(rng.integers(0, 3)), "minor", *map(float, rng.integers(0, 500, 4))) for i in range(40)]
    points = [(i, int(rng.integers(0, 3)), "minor", float(rng.integers(0, 180)), *map(float, rng.integers(0, 500, 2)), 10.0) for i in range(60)]
    schemas = "link_id long, road_no int, road_class string, x1 double, y1 double, x2 double, y2 double", "point_id long, s_no int, s_class string, s_angle double, x double, y double, flow double"
    seen = set()
    for seed in range(3):
        order = np.random.default_rng(seed)
        a, b = ([rows[i] for i in order.permutation(len(rows))] for rows in (links, points))
        out = spatial.named_match(spark.createDataFrame(a, schemas[0]).repartition(5), spark.createDataFrame(b, schemas[1]).repartition(3))
        seen.add(str(sorted(map(tuple, out.collect()))))
    assert len(seen) == 1


def test_layout_gap(spark):
    tiles = spark.createDataFrame([(0, 0, 0.0, 0.0, 1000.0, 1000.0), (0, 1, 1100.0, 0.0, 2100.0, 1000.0)], "row_i long, col_i long, minx double, miny double, maxx double, maxy double")
    assert tuple(quality.layout(tiles).first()) == ("horizontal", 1, 0, 1, 0)


def test_censored_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    y = 45 + 4 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=3000) * 3
    rows = [(float(a), float(b), float(max(v, 42)), bool(v < 42), 1.0) for (a, b), v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, level double, below boolean, weight double")
    beta, sd = models.censored_regression(df, ["a", "b"], "level", "below", "weight")
    assert np.allclose(beta, [45, 4, -2], atol=0.25) and abs(sd - 3) < 0.2
    out = models.predict(df.limit(1), ["a", "b"], beta, sd, F.lit(42.0)).first()
    assert out.low_db < out.mean_db < out.high_db and 0 <= out.p_below <= 1


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    a, b = (sorted(map(tuple, quality.fingerprint(x, "g", ["v"]).collect())) for x in (df, df.orderBy(F.desc("v")).repartition(7)))
    c = sorted(map(tuple, quality.fingerprint(df.withColumn("v", F.when(F.col("v") == 5, 6).otherwise(F.col("v"))), "g", ["v"]).collect()))
    assert a == b and a != c
