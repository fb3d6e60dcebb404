"""Traffic, carriageways, air and ground along roads: what is known, what is filled in, and on what basis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.functions import acoustics as ac
from phonolith.operators.spatial import ENDS, back, near_pairs, nearest_of_kind

# Reference air where a station says nothing, and the ranges within which its values count.
REFERENCE_AIR = {"temperature_c": 10.0, "humidity": 70.0, "pressure_kpa": 101.325}
AIR_RANGES = {"temperature_c": (-20, 50), "humidity": (10, 100), "pressure_kpa": (50, 120)}
# Land-cover classes whose ground is taken as porous or as hard.
POROUS, HARD = (30, 40), (50, 80)
COVER_CLASSES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)


def tile_of(points: DataFrame, tiles: DataFrame, size: float, key: str = "point_id") -> DataFrame:
    """Each point with the one tile that owns it, west edge in and east edge out, south edge out and north edge in.

    tiles: tile_id, minx, miny, maxx, maxy. A point that several tiles own is ambiguous and gets none of them.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))
    held = tiles.withColumn("bx", F.explode(span("minx", "maxx"))).withColumn("by", F.explode(span("miny", "maxy")))
    own = points.select(key, "x", "y", F.floor(F.col("x") / size).cast("long").alias("bx"), F.floor(F.col("y") / size).cast("long").alias("by"))
    inside = (F.col("x") >= F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") > F.col("miny")) & (F.col("y") <= F.col("maxy"))
    owners = own.join(held, ["bx", "by"]).where(inside).groupBy(key).agg(F.count(F.lit(1)).alias("owners"), F.min("tile_id").alias("tile_id"))
    out = points.select(key).join(owners, key, "left")
    state = F.when(F.col("owners").isNull(), "no_tile").when(F.col("owners") == 1, "owned").otherwise("ambiguous")
    return out.select(key, F.when(F.col("owners") == 1, F.col("tile_id")).alias("tile_id"), state.alias("state"))


def known_traffic(rows: DataFrame) -> DataFrame:
    """Traffic rows with a flow, and the share of heavy vehicles held between 0 and 1 (0 where it is not known)."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("hgv_flow") / F.col("flow"), F.lit(0.0))))
    return rows.where("flow > 0").withColumn("hgv_share", share)


def imputed_traffic(links: DataFrame, direct: DataFrame, sources: DataFrame, reach: float = 5000.0, donors: int = 25) -> DataFrame:
    """Flow of every link with the method that gave it and the number of values behind it.

    links: link_id, road_no, road_class, area, x1..y2; direct: link_id, flow (accepted matches); sources: s_class, flow.
    In turn: its own match; the median of matched links of its number; of the `donors` nearest matched links of its class
    within reach; of its class and area; of its class; of all sources of its class; of all sources.
    """
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    known = links.join(direct, "link_id")
    middle = F.median("flow")
    by_no = known.where("road_no is not null").groupBy("road_no").agg(middle.alias("no_flow"), F.count(F.lit(1)).alias("no_n"))
    open_links = links.join(direct.select("link_id"), "link_id", "left_anti").join(by_no.select("road_no"), "road_no", "left_anti")
    points = open_links.select("link_id", "road_class", mid("x1", "x2").alias("x"), mid("y1", "y2").alias("y"))
    rings = [r for r in (reach / 4, reach / 2, reach)]
    near = nearest_of_kind(points, known.select(F.struct(F.col("link_id"), F.col("flow")).alias("donor"), "road_class", *ENDS), "link_id", "donor", "road_class", donors, rings)
    near = near.select("link_id", F.explode("near.donor.flow").alias("flow")).groupBy("link_id").agg(middle.alias("near_flow"), F.count(F.lit(1)).alias("near_n"))
    grouped = lambda rows, by, name: F.broadcast(rows.groupBy(*by).agg(middle.alias(f"{name}_flow"), F.count(F.lit(1)).alias(f"{name}_n")))  # noqa: E731  a row per class, or class and area
    everywhere = sources.agg(middle.alias("all_flow"), F.count(F.lit(1)).alias("all_n"))
    out = links.join(direct.withColumnRenamed("flow", "own_flow"), "link_id", "left").withColumn("own_n", F.lit(1).cast("long")).join(by_no, "road_no", "left").join(near, "link_id", "left")
    out = out.join(grouped(known, ["road_class", "area"], "area"), ["road_class", "area"], "left").join(grouped(known, ["road_class"], "class"), "road_class", "left")
    out = out.join(grouped(sources.withColumnRenamed("s_class", "road_class"), ["road_class"], "source"), "road_class", "left").crossJoin(F.broadcast(everywhere))
    steps = {"own": "direct", "no": "same_number", "near": "near_same_class", "area": "class_and_area", "class": "class", "source": "class_of_all_sources", "all": "all_sources"}
    method, n = None, None
    for step, name in steps.items():
        here = F.col(f"{step}_flow").isNotNull()
        method, n = (F.when(here, name), F.when(here, F.col(f"{step}_n"))) if method is None else (method.when(here, name), n.when(here, F.col(f"{step}_n")))
    return out.select("link_id", F.coalesce(*[F.col(f"{s}_flow") for s in steps]).alias("flow"), method.alias("method"), n.alias("support"))


def one_way_signs(links: DataFrame, evidence: DataFrame, corridor: float = 10.0, turn: float = 25.0, probes: int = 7, cover: float = 0.95, fine: int = 41, slack: float = 2.0) -> DataFrame:
    """Direction in which a link is driven, by one-way lines of the same road beside it, or the first reason to leave it open.

    evidence: e_id, e_no, e_sign (1 along its own line, -1 against), x1..y2. Lines within the corridor must cover the link
    (by `fine` places along it), each of the probes needs a line, headings must agree, and all signs must be one.
    """
    at = lambda t, a, b: F.col(a) + (F.col(b) - F.col(a)) * t
    like, own = [*ENDS, "road_no"], [f"l_{c}" for c in ENDS]
    places = links.select(*like).distinct().withColumns({f"l_{c}": F.col(c) for c in ENDS} | {"lx": F.col("x2") - F.col("x1"), "ly": F.col("y2") - F.col("y1")})

    def spread(count: int, first: float, width: float) -> DataFrame:
        t = first + width * F.col("i") / (count - 1)
        return places.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(*own, "road_no", "lx", "ly", "i", at(t, "x1", "x2").alias("x"), at(t, "y1", "y2").alias("y"))

    lines, link = evidence.select("e_no", "e_sign", *ENDS).distinct(), [*[F.col(f"l_{c}").alias(c) for c in ENDS], "road_no"]
    covered = near_pairs(spread(fine, 0.0, 1.0), lines, corridor).where("road_no = e_no").groupBy(*link).agg((F.countDistinct("i") / fine).alias("covered"))
    pairs = near_pairs(spread(probes, 0.05, 0.9), lines, corridor).where("road_no = e_no")
    pairs = pairs.withColumn("least", F.min("dist").over(W.partitionBy(*own, "road_no", "i"))).where(F.col("dist") <= F.col("least") + slack)
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    both = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly")) * F.sqrt(ex * ex + ey * ey)
    cos = (F.col("lx") * ex + F.col("ly") * ey) / F.nullif(both, F.lit(0.0))  # a link or line without length has no heading
    signs = pairs.withColumn("cos", cos).groupBy(*link).agg(
        F.countDistinct("i").alias("probes"), F.count_if(F.abs("cos") < F.cos(F.radians(F.lit(turn)))).alias("turned"),
        F.min(F.signum("cos") * F.col("e_sign")).alias("low"), F.max(F.signum("cos") * F.col("e_sign")).alias("high"),
    )
    # a probe that meets a line lies on a cover place's road, but not always within reach of one: both sides are kept
    out = back(back(links.select("link_id", *like), covered, like, "left"), signs, like, "left")
    reason = (
        F.when(F.col("covered").isNull(), "no_line").when(F.col("covered") < cover, "not_covered").when(F.coalesce("probes", F.lit(0)) < probes, "probe_without_line")
        .when((F.col("turned") > 0) | F.col("low").isNull(), "headings_differ").when(F.col("low") != F.col("high"), "signs_differ").otherwise("supported")
    )
    return out.select("link_id", F.coalesce("covered", F.lit(0.0)).alias("covered"), reason.alias("status"), F.when(reason == "supported", F.col("low").cast("int")).alias("sign"))


def carriageways(links: DataFrame, budgets: DataFrame, beside: DataFrame, least: float = 3.0, most: float = 80.0) -> DataFrame:
    """What part of a count each link carries, or the first reason to give it none; no count is given out twice.

    links: link_id, road_no, donor, form (single, collapsed, dual, other), structure, fictitious, sign (of one_way_signs);
    budgets: donor, status (paired, combined, single), forward, backward (flows by sign 1 and -1); beside: link_id,
    o_link_id, off (parallel links). A link drawn once takes the whole count unless another of the same road runs beside
    it. Dual carriageways take one direction each, and only as a pair of two with opposite signs, 3 to 80 m apart.
    """
    own = links.join(budgets, "donor", "left")
    twins = beside.join(links.select("link_id", F.col("road_no").alias("a_no")), "link_id").join(links.select(F.col("link_id").alias("o_link_id"), F.col("road_no").alias("b_no"), F.col("form").alias("o_form"), F.col("donor").alias("o_donor")), "o_link_id").where("a_no = b_no and o_form <> 'other'")
    own = own.join(twins.groupBy("link_id").agg(F.count(F.lit(1)).alias("twins")), "link_id", "left").withColumn("twins", F.coalesce("twins", F.lit(0)))
    first = (
        F.when(F.col("donor").isNull() | F.col("status").isNull(), "no_count").when(F.col("fictitious"), "not_a_real_line").when(F.col("structure"), "structure").when(F.col("form") == "other", "special_form")
        .when(~F.col("status").isin("paired", "combined", "single"), "count_not_usable").when((F.col("form") == "dual") & (F.col("status") != "paired"), "dual_needs_both_directions").when((F.col("form") == "dual") & F.col("sign").isNull(), "dual_without_one_way_evidence")
        .when(F.col("form") == "dual", "dual").when(F.col("status") == "single", "one_direction_is_not_one_way").when((F.col("form") == "single") & F.col("sign").isNotNull() & (F.col("status") == "paired"), "counts_contradict_one_way").when(F.col("twins") > 0, "another_line_beside")
        .otherwise("centreline")
    )
    own = own.withColumn("reason", first)
    duals = own.where("reason = 'dual'").groupBy("donor").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("sign").alias("signs"), F.min("link_id").alias("a"), F.max("link_id").alias("b"), F.max("twins").alias("most_twins"))
    gap = beside.select(F.col("link_id").alias("a"), F.col("o_link_id").alias("b"), "off")
    pairs = duals.join(gap, ["a", "b"], "left")
    pair = F.when((F.col("members") != 2) | (F.col("signs") != 2), "dual_not_a_pair").when(F.col("off").isNull() | ~F.col("off").between(least, most) | (F.col("most_twins") > 1), "dual_pair_ambiguous").otherwise("dual_pair")
    out = own.join(pairs.select("donor", pair.alias("pair")), "donor", "left").withColumn("reason", F.when(F.col("reason") == "dual", F.col("pair")).otherwise(F.col("reason")))
    flow = F.when(F.col("reason") == "centreline", F.coalesce("forward", F.lit(0)) + F.coalesce("backward", F.lit(0))).when(F.col("reason") == "dual_pair", F.when(F.col("sign") > 0, F.col("forward")).otherwise(F.col("backward")))
    return out.select("link_id", "reason", flow.alias("flow"))


def chosen_air(t: Column, rh: Column, p: Column) -> Column:
    """Air of an hour field by field: the station's value where it counts, else the reference, each with its basis."""
    good = {k: F.coalesce(c.between(*AIR_RANGES[k]), F.lit(False)) for k, c in zip(AIR_RANGES, (t, rh, p), strict=True)}
    good["humidity"] = good["humidity"] & good["temperature_c"]
    fields = []
    for (k, ok), c in zip(good.items(), (t, rh, p), strict=True):
        fields += [F.when(ok, c).otherwise(REFERENCE_AIR[k]).alias(k), F.when(ok, "station").otherwise("reference").alias(f"{k}_basis")]
    whole = good["temperature_c"] & good["humidity"] & good["pressure_kpa"]
    return F.struct(*fields, F.when(t.isNull() & rh.isNull() & p.isNull(), "reference").when(whole, "station").otherwise("in_part").alias("status"))


def air_coverage(hours: DataFrame, frequency: float = 1000.0) -> DataFrame:
    """Per period: hours, hours with a report, hours with station air only, gaps by field, and the traffic-weighted loss over 1 km.

    hours: period, weight, reported, air (chosen_air). Transmission, not decibels, is averaged.
    """
    alpha = ac.absorption_db_per_km(F.lit(frequency), F.col("air.temperature_c"), F.col("air.humidity"), F.col("air.pressure_kpa"))
    gaps = [F.count_if(F.col(f"air.{k}_basis") == "reference").alias(f"{k}_gaps") for k in REFERENCE_AIR]
    left = F.sum(F.col("weight") * ac.db_to_energy(-alpha)) / F.sum("weight")
    return hours.groupBy("period").agg(F.count(F.lit(1)).alias("hours"), F.count_if("reported").alias("reported"), F.count_if(F.col("air.status") == "station").alias("station_hours"), *gaps, (-ac.energy_to_db(left)).alias("loss_db"))


def ground_cases(parts: DataFrame, cases: DataFrame) -> DataFrame:
    """Mean ground factor of each path under each case, with the length of each basis; unknown classes leave no mean.

    parts: path, code (null: missing), length; cases: case_id, uniform, g. A uniform case gives g to every known class; else
    porous classes get 1, hard ones 0, and classes that do not say get g.
    """
    own = parts.crossJoin(F.broadcast(cases))
    known = F.coalesce(F.col("code").isin(*COVER_CLASSES), F.lit(False))
    basis = F.when(~known, "missing").when(F.col("uniform"), "uniform").when(F.col("code").isin(*POROUS), "porous").when(F.col("code").isin(*HARD), "hard").otherwise("unstated")
    own = own.withColumn("basis", basis).withColumn("factor", F.when(F.col("basis") == "porous", 1.0).when(F.col("basis") == "hard", 0.0).when(F.col("basis") != "missing", F.col("g")))
    of = lambda b: F.coalesce(F.sum(F.when(F.col("basis") == b, F.col("length"))), F.lit(0.0))
    mean = F.when(F.count_if(F.col("basis") == "missing") == 0, F.sum(F.col("factor") * F.col("length")) / F.sum("length"))
    return own.groupBy("path", "case_id").agg(F.sum("length").alias("length"), *[of(b).alias(f"{b}_m") for b in ("porous", "hard", "unstated", "missing")], mean.alias("ground"))


def road_context(links: DataFrame, ways: DataFrame, corridor: float = 3.0, count: int = 21) -> DataFrame:
    """Ways within a corridor of each link: how many, their surfaces, and whether a bridge or tunnel among them withholds the link.

    ways: way_id, structure (no, bridge, tunnel; null: not tagged), surface, x1..y2. The link is looked at in `count` places.
    """
    t = F.col("i") / (count - 1)
    places = links.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    places = places.select("link_id", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))
    near = near_pairs(places, ways.select("way_id", "structure", "surface", *ENDS), corridor).groupBy("link_id", "way_id").agg(F.first("structure").alias("structure"), F.first("surface").alias("surface"))
    by = near.groupBy("link_id").agg(F.count(F.lit(1)).alias("ways"), F.sort_array(F.collect_set("surface")).alias("surfaces"), F.bool_or(F.coalesce(F.col("structure") != "no", F.lit(False))).alias("structure"))
    out = links.select("link_id").join(by, "link_id", "left")
    return out.select("link_id", F.coalesce("ways", F.lit(0)).alias("ways"), F.coalesce(F.array_join("surfaces", ","), F.lit("")).alias("surfaces"), F.when(F.col("structure"), "withheld").otherwise("at_grade_assumed").alias("status"))


def speed_rows(sheet: DataFrame, vehicles: Sequence[str], year: int, unit: str) -> DataFrame:
    """(road_type, vehicle, mph) of a published speed sheet: one year and unit only, a row per vehicle column."""
    return sheet.where((F.col("year") == year) & (F.col("units") == unit)).unpivot("road_type", list(vehicles), "vehicle", "mph")


def with_box(links: DataFrame, size: float = 10_000.0) -> DataFrame:
    """links with their bounding box and the square of its middle, to be written clustered by square."""
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / size).cast("long")
    return links.withColumns({"minx": F.least("x1", "x2"), "miny": F.least("y1", "y2"), "maxx": F.greatest("x1", "x2"), "maxy": F.greatest("y1", "y2"), "square_x": middle("x1", "x2"), "square_y": middle("y1", "y2")})


def in_box(boxed: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Links whose box meets a window; plain comparisons of columns, which files clustered by square are pruned by."""
    return boxed.where((F.col("maxx") >= west) & (F.col("minx") <= east) & (F.col("maxy") >= south) & (F.col("miny") <= north))


def grid_audit(grids: DataFrame) -> DataFrame:
    """Recorded grids against the grids asked for: the first fault, what it looks like, and how many target centres have support.

    grids: tile, source, t_cols, t_rows, t_west, t_north, t_res and the same with r_ for the response, same_crs. Rows run south.
    """
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6
    same_shape, same_res, same_origin = (F.col("r_cols") == F.col("t_cols")) & (F.col("r_rows") == F.col("t_rows")), close("r_res", "t_res"), close("r_west", "t_west") & close("r_north", "t_north")
    fault = F.when(~F.col("same_crs"), "crs").when(~same_res, "resolution").when(~same_shape, "dimensions").when(~same_origin, "bounds")
    more = (F.col("r_cols") == F.col("t_cols") + 1) & (F.col("r_rows") == F.col("t_rows") + 1)
    fewer = (F.col("r_cols") <= F.col("t_cols")) & (F.col("r_rows") <= F.col("t_rows"))
    pattern = (
        F.when(~F.col("same_crs"), "another_crs").when(same_shape & same_res & same_origin, "as_asked").when(~same_res & more, "stretched_by_one").when(same_res & same_shape, "shifted")
        .when(same_res & fewer & same_origin, "clipped_at_far_edges").when(same_res & fewer, "clipped").otherwise("other")
    )

    def centres(low: Column, high: Column, start: Column, n: Column) -> Column:
        """Centres start + (i + 1/2) res, 0 <= i < n, from low to high."""
        first = F.greatest(F.lit(0), F.ceil((low - start) / F.col("t_res") - 0.5 - 1e-9))
        last = F.least(n - 1, F.floor((high - start) / F.col("t_res") - 0.5 + 1e-9))
        return F.greatest(F.lit(0), last - first + 1)

    across = centres(F.col("r_west"), F.col("r_west") + F.col("r_cols") * F.col("r_res"), F.col("t_west"), F.col("t_cols"))
    down = centres(-F.col("r_north"), -F.col("r_north") + F.col("r_rows") * F.col("r_res"), -F.col("t_north"), F.col("t_rows"))
    support = F.when(F.col("same_crs"), (across * down).cast("long"))
    return grids.select("tile", "source", F.coalesce(fault, F.lit("none")).alias("fault"), pattern.alias("pattern"), support.alias("supported"), (F.col("t_cols") * F.col("t_rows") - support).alias("unsupported"))


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key with the side it is on: both, left or right."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))

