"""Counts of minor roads put on the one link they can belong to, or refused with the first reason that holds.

Rules stand in a list of (condition, reason), read in order; every fact that a rule needs is a column, so a decision can be
traced. Every physical link near a point is a rival, whatever its class or form; only the nearest can be accepted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.functions import geometry as geo
from phonolith.operators import polylines
from phonolith.operators.spatial import ENDS, near_pairs
from phonolith.sources.scratch import written

# Reasons of decisions.
BAD_TRAFFIC, BAD_ROAD, BAD_METHOD, BAD_MARGIN = "invalid_or_wrong_year_traffic", "unsupported_minor_road_identity", "unqualified_traffic_quality_flag", "insufficient_network_margin"
NO_ROAD, BAD_CLASS, BAD_FORM, OCCUPIED = "no_road_within_distance_limit", "nearest_road_class_incompatible", "carriageway_or_structure_unqualified", "existing_direct_evidence_protected"
NEAR_END, RIVAL, ACCEPTED, SHARED = "near_link_endpoint_or_junction", "competing_road_ambiguous", "unique_local_geometric_support", "multiple_count_points_on_one_link"


def _finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        c = F.col(n).cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def _repeats(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 or {key} is null").isEmpty()


def fine(c: Column) -> Column:
    """round(c, 6) to the last bit. Only what lies close to a half, or is large, goes through the decimal arithmetic that makes it slow."""
    c = F.col(c) if isinstance(c, str) else c
    millionths = c * 1e6
    plain = (F.abs(c) < 1e6) & (F.abs(millionths - F.floor(millionths) - 0.5) > 1e-3)
    return F.when(plain, F.floor(millionths + 0.5) / F.lit(1e6)).otherwise(F.round(c, 6))


def closed_or_crossing(lines: DataFrame) -> DataFrame:
    """link_id and `bent`: the line ends where it begins, or two of its edges meet other than one after the other.

    Edges of a line are compared with one another, so the work on a line grows with the square of its own edges.
    """
    e = polylines.edges(lines).select("link_id", F.struct("chainage", *ENDS).alias("e"))
    own = e.groupBy("link_id").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    side = lambda o, x, y: (o["x2"] - o["x1"]) * (y - o["y1"]) - (o["y2"] - o["y1"]) * (x - o["x1"])
    boxes = lambda a, b, u, v: (F.greatest(a[u], a[v]) >= F.least(b[u], b[v])) & (F.greatest(b[u], b[v]) >= F.least(a[u], a[v]))
    meet = lambda a, b: (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) <= 0) & (side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) <= 0) & boxes(a, b, "x1", "x2") & boxes(a, b, "y1", "y2")
    back = lambda a, b: (side(a, b["x2"], b["y2"]) == 0) & ((a["x2"] - a["x1"]) * (b["x2"] - b["x1"]) + (a["y2"] - a["y1"]) * (b["y2"] - b["y1"]) < 0)
    later = lambda i: F.slice("edges", i + 3, F.size("edges"))
    crossing = F.exists(F.transform("edges", lambda a, i: F.exists(later(i), lambda b: meet(a, b)) | F.coalesce(back(a, F.get("edges", i + 1)), F.lit(False))), lambda x: x)
    first, last = F.get("edges", F.lit(0)), F.element_at("edges", -1)
    ring = (first["x1"] == last["x2"]) & (first["y1"] == last["y2"])
    return own.select("link_id", (ring | crossing).alias("bent"))


def link_counts(
    points: DataFrame, lines: DataFrame, occupied: DataFrame | None = None, year: int = 2021, bounds: Sequence[float] | None = None,
    limit: float = 10.0, margin: float = 15.0, clear: float = 20.0, search: float = 25.0, form: str = "Single Carriageway", kind: str = "minor",
) -> DataFrame:
    """One decision a point: status, reason, accepted_link_id, proposed_link_id, dist, clearance, margin, candidates.

    points: point_id, x, y, year, flow, hgv_flow, road_type, road_name, method; lines: link_id, parts (one part), road_class,
    form_of_way, structure, fictitious; occupied: link_id of links with a count of their own. bounds (west, south, east,
    north) of an extract: a point nearer to them than the search is refused, as its rivals may lie outside. Limits
    are held against values to the micrometre, so one met exactly counts as kept whatever the last bit. Several points on one link refuse each other. Repeated or null ids, and occupied links that the
    network lacks, raise ValueError. Points in the same place are measured once; a link's distance is rounded after its
    edges are one row, as the condition of the join would repeat its formula.
    """
    points, lines = written(points), written(lines)
    if _repeats(points, "point_id") or _repeats(lines, "link_id"):
        raise ValueError("missing or repeated identity")
    if occupied is not None and not occupied.join(lines, "link_id", "left_anti").isEmpty():
        raise ValueError("occupied links must belong to the network")
    if bounds is not None and not (bounds[0] < bounds[2] and bounds[1] < bounds[3]):
        raise ValueError("invalid bounds of the network")
    sound = _finite("flow", "hgv_flow", "x", "y")
    physical = lines.where(~F.coalesce("fictitious", F.lit(False)))
    edge = polylines.edges(physical)
    place = F.col("chainage") + F.col("length") * geo.along(F.col("x"), F.col("y"), *[F.col(c) for c in ENDS])
    here = ["x", "y"]
    pairs = near_pairs(points.where(sound).select(*here).distinct(), edge, search + 1e-6)
    each = pairs.groupBy(*here, "link_id").agg(F.min(F.struct("dist", place.alias("at"))).alias("best")).select(*here, "link_id", "best.*")
    each = each.withColumn("rounded", fine("dist")).where(F.col("rounded") <= search)
    order = W.partitionBy(*here).orderBy("rounded", "link_id")
    ranked = each.withColumns({"n": F.row_number().over(order), "next": F.lead("dist").over(order), "candidates": F.count(F.lit(1)).over(W.partitionBy(*here))}).where("n = 1")
    near = written(ranked.select(*here, F.col("link_id").alias("near_id"), "dist", "at", (F.col("next") - F.col("dist")).alias("margin"), "candidates"))
    chosen = physical.join(near.select(F.col("near_id").alias("link_id")).distinct(), "link_id", "left_semi")
    facts = chosen.select("link_id", "road_class", "form_of_way", "structure", "fictitious").join(closed_or_crossing(chosen), "link_id")
    facts = facts.join(polylines.orientations(chosen).select("link_id", "length"), "link_id")
    if occupied is not None:
        facts = facts.join(occupied.select("link_id", F.lit(True).alias("taken")).distinct(), "link_id", "left")
    else:
        facts = facts.withColumn("taken", F.lit(False))
    edge_margin = F.least(F.col("x") - bounds[0], F.lit(bounds[2]) - F.col("x"), F.col("y") - bounds[1], F.lit(bounds[3]) - F.col("y")) if bounds is not None else F.lit(None).cast("double")
    out = points.join(near, here, "left").join(facts.withColumnRenamed("link_id", "near_id"), "near_id", "left")
    proposed = fine(F.col("dist")) <= limit
    clearance = F.least(F.col("at"), F.col("length") - F.col("at"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        (no((F.col("year") == year) & sound & (F.col("flow") > 0) & F.col("hgv_flow").between(0, F.col("flow"))), BAD_TRAFFIC),
        (no((F.col("road_type") == "Minor") & F.upper(F.trim("road_name")).isin("C", "U")), BAD_ROAD),
        (no(F.col("method").isin("Counted", "Estimated")), BAD_METHOD), (edge_margin < search, BAD_MARGIN), (no(proposed), NO_ROAD), (no(F.col("road_class") == kind), BAD_CLASS),
        (no((~F.col("fictitious")) & (F.col("form_of_way") == form) & (F.col("structure") == "") & ~F.col("bent")), BAD_FORM), (F.coalesce("taken", F.lit(False)), OCCUPIED), (fine(clearance) < clear, NEAR_END), (fine(F.col("margin")) < margin, RIVAL),
    ]
    reason = F.coalesce(*(F.when(condition, F.lit(said)) for condition, said in rules), F.lit(ACCEPTED))
    out = out.withColumns({"reason": reason, "clearance": clearance, "network_margin": edge_margin})
    good = F.col("reason") == ACCEPTED
    searched = ~F.col("reason").isin(BAD_TRAFFIC, BAD_ROAD, BAD_METHOD, BAD_MARGIN)
    # refused points are counted by their own number, so they do not pile up
    same = F.count(F.lit(1)).over(W.partitionBy(F.when(good, F.col("near_id")), F.when(~good, F.col("point_id"))))
    out = out.withColumn("reason", F.when(good & (same > 1), SHARED).otherwise(F.col("reason")))
    shown = searched & proposed
    return out.select(
        "point_id", F.when(good, "accepted_provisional").otherwise("rejected").alias("status"), "reason", F.when(good, F.col("near_id")).alias("accepted_link_id"), F.when(shown, F.col("near_id")).alias("proposed_link_id"),
        F.when(shown, F.col("dist")).alias("dist"), F.when(shown, F.col("clearance")).alias("clearance"), F.when(shown, F.col("margin")).alias("margin"), F.when(searched, F.coalesce("candidates", F.lit(0))).alias("candidates"),
    )
