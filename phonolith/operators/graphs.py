"""Connected cells: components across tiles, their summaries and outlines, enclosed holes, and hold-out patches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.sources.scratch import folder, removed, written

#: Cells along one side of the tiles that are labelled in one go; a tile is bounded whatever the input.
TILE = 256


def _label_tile(pdf: pd.DataFrame, eight: bool) -> pd.DataFrame:
    """Local labels of one tile's cells by union-find; a label is the smallest cell number of the tile's piece."""
    order = np.argsort(pdf["cell"].to_numpy(), kind="stable")
    rows, cols, cells = (pdf[c].to_numpy()[order] for c in ("row_i", "col_i", "cell"))
    at = {(int(r), int(c)): i for i, (r, c) in enumerate(zip(rows, cols, strict=True))}
    up = list(range(len(cells)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (r, c), i in at.items():
        for step in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ())):
            j = at.get((r + step[0], c + step[1]))
            if j is not None:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return pd.DataFrame({"group": pdf["group"].iloc[0], "row_i": rows, "col_i": cols, "local": [cells[top(i)] for i in range(len(cells))]})


def components(cells: DataFrame, width: int, eight: bool = False) -> DataFrame:
    """(group, row_i, col_i, component) of cells(group, row_i, col_i): 4- or 8-neighbour components within a group.

    A component is named by its smallest cell number (row x width + col). Tiles are labelled in one task each; labels
    of touching tiles are then joined: see contracted.
    """
    cell = F.col("row_i") * width + F.col("col_i")
    tile = [F.floor(F.col(c) / TILE).cast("long").alias(f"t_{c}") for c in ("row_i", "col_i")]
    own = cells.select("group", "row_i", "col_i", cell.alias("cell"))
    local = own.groupBy("group", *tile).applyInPandas(lambda pdf: _label_tile(pdf, eight), "group string, row_i long, col_i long, local long")
    local = written(local)
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    there = F.explode(F.array(*[F.struct((F.col("row_i") + r).alias("row_i"), (F.col("col_i") + c).alias("col_i")) for r, c in steps]))
    border = local.where((F.col("row_i") % TILE == TILE - 1) | (F.col("col_i") % TILE == TILE - 1) | (F.col("col_i") % TILE == 0))
    look = border.select("group", F.col("local").alias("a"), there.alias("at")).select("group", "a", F.col("at.row_i").alias("row_i"), F.col("at.col_i").alias("col_i"))
    touch = look.join(local.select("group", "row_i", "col_i", F.col("local").alias("b")), ["group", "row_i", "col_i"]).where("a <> b").select("group", "a", "b").distinct()
    both = written(touch.union(touch.select("group", "b", "a")).distinct())
    # labels that touch no other tile's are their own roots; only the others go through the rounds
    label = contracted(both, both.select("group", "a").distinct())
    return local.join(label.withColumnRenamed("a", "local"), ["group", "local"], "left").select("group", "row_i", "col_i", F.coalesce("root", "local").alias("component"))


def contracted(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, a, root) for every node of nodes(group, a): the smallest node it reaches over both(group, a, b), edges either way.

    Each round hooks every label under the smallest label that its members see, then halves the way to the top by taking
    labels of labels twice; chains of any length need rounds by their logarithm, not by their length. Only labels that an
    edge still parts are looked at, and a round's table is removed when the next one stands.
    """
    spark, home = both.sparkSession, folder(both.sparkSession)
    label = written(nodes.withColumn("root", F.col("a")), f"{home}/0")
    for i in count(1):
        of = lambda a, root: label.select("group", F.col("a").alias(a), F.col("root").alias(root))  # noqa: B023, E731
        apart = both.join(of("a", "ra"), ["group", "a"]).join(of("b", "rb"), ["group", "b"]).where("ra <> rb")
        hooks = written(apart.groupBy("group", F.greatest("ra", "rb").alias("top")).agg(F.min(F.least("ra", "rb")).alias("under")), f"{home}/hooks-{i}")
        if hooks.isEmpty():
            return label
        for _ in range(2):
            hooks = hooks.alias("h").join(hooks.select("group", F.col("top").alias("under"), F.col("under").alias("further")), ["group", "under"], "left").select("group", "top", F.coalesce("further", "under").alias("under"))
        moved = label.join(hooks.select("group", F.col("top").alias("root"), "under"), ["group", "root"], "left").select("group", "a", F.coalesce("under", "root").alias("root"))
        label = written(moved, f"{home}/{i}")
        removed(spark, f"{home}/{i - 1}")
        removed(spark, f"{home}/hooks-{i}")


def summary(labelled: DataFrame, least: int, side: int = 10) -> DataFrame:
    """Size, bounds, range of levels, tiles touched and id of components of at least `least` cells, ordered by size, then position.

    labelled: group, component, row_i, col_i, raw.
    """
    tile = F.struct(F.floor(F.col("row_i") / side), F.floor(F.col("col_i") / side))
    out = labelled.groupBy("group", "component").agg(
        F.count(F.lit(1)).alias("cells"), F.min("raw").alias("min_db"), F.max("raw").alias("max_db"), F.countDistinct(tile).alias("tiles"), F.min("row_i").alias("top"), F.max("row_i").alias("bottom"), F.min("col_i").alias("left"), F.max("col_i").alias("right")
    ).where(F.col("cells") >= least)
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("cells"), "top", "left", "component"))
    ident = F.substring(F.sha2(F.concat_ws(":", "group", "component", "cells"), 256), 1, 16)
    return out.withColumns({"rank": rank, "component_id": ident})


def edges(labelled: DataFrame) -> DataFrame:
    """Outline edges of components: sides of a cell whose neighbour is not of the component, and their number.

    A side is (r1, c1) to (r2, c2) in grid corners, with the component on its right.
    """
    r, c = F.col("row_i"), F.col("col_i")
    sides = F.array(*[
        F.struct(F.least(a, x).alias("ka"), F.least(b, y).alias("kb"), F.greatest(a, x).alias("kc"), F.greatest(b, y).alias("kd"), a.alias("r1"), b.alias("c1"), x.alias("r2"), y.alias("c2"))
        for a, b, x, y in ((r, c, r, c + 1), (r, c + 1, r + 1, c + 1), (r + 1, c + 1, r + 1, c), (r + 1, c, r, c))
    ])
    out = labelled.select("group", "component", F.explode(sides).alias("s")).select("group", "component", "s.*")
    key = ["group", "component", "ka", "kb", "kc", "kd"]
    return out.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in ("r1", "c1", "r2", "c2")]).where("n = 1").select("group", "component", "r1", "c1", "r2", "c2")


_EDGE = "group string, component long, edge long, next long, r1 long, c1 long, r2 long, c2 long"


def followed(sides: DataFrame) -> DataFrame:
    """Outline edges with their number and that of the edge after them; at a corner that two cells share the ring turns right.

    Numbers come from an edge's start and heading, so they are the same in every run.
    """
    heading = F.when(F.col("c2") > F.col("c1"), 0).when(F.col("r2") > F.col("r1"), 1).when(F.col("c2") < F.col("c1"), 2).otherwise(3)
    own = sides.withColumn("heading", heading).withColumn("edge", F.shiftleft(F.shiftleft("r1", 30) + F.col("c1"), 2) + F.col("heading"))
    then = own.select("group", "component", F.col("r1").alias("r2"), F.col("c1").alias("c2"), F.col("edge").alias("next"), F.col("heading").alias("turned"))
    met = own.join(then, ["group", "component", "r2", "c2"])
    right = F.when(F.pmod(F.col("turned") - F.col("heading"), F.lit(4)) == 1, 0).otherwise(1)
    key = ["group", "component", "edge", "r1", "c1", "r2", "c2"]
    return met.groupBy(*key).agg(F.min_by("next", right).alias("next")).select("group", "component", "edge", "next", "r1", "c1", "r2", "c2")


def _runs_of_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of one tile with the run they are in and their place in it; a run begins where the ring comes in, or at the ring's least edge.

    A directed edge has one cell on its right, so its number tells components apart as well.
    """
    follow = dict(zip(pdf.edge.tolist(), pdf["next"].tolist(), strict=True))
    reached = set(follow.values())
    heads = [e for e in follow if e not in reached]
    run, place, after = {}, {}, {}
    for start in [*heads, *sorted(follow)]:
        if start in run:
            continue
        at, k = start, 0
        while at in follow and at not in run:
            run[at], place[at] = start, k
            at, k = follow[at], k + 1
        after[start] = at
    return pdf.assign(run=[run[e] for e in pdf.edge], place=[place[e] for e in pdf.edge], after=[after[run[e]] for e in pdf.edge])


def ring_points(labelled: DataFrame) -> DataFrame:
    """group, component, ring, nth, r, c: the corners of every ring in order, from the least edge of the ring on.

    Edges become runs in bounded tiles; runs of a ring are joined by pointer jumping, which finds the ring's least run and
    then every run's place, each in rounds by the logarithm of the tiles that the ring passes. No task sees a component.
    """
    tile = [F.floor(F.col(c) / TILE).cast("long").alias(f"t_{c}") for c in ("r1", "c1")]
    edge = followed(edges(labelled))
    placed = written(edge.groupBy("group", *tile).applyInPandas(_runs_of_tile, _EDGE + ", run long, place long, after long"))
    key = ["group", "component"]
    runs = placed.groupBy(*key, "run").agg(F.first("after").alias("after"), F.count(F.lit(1)).alias("n"))
    spark, home = labelled.sparkSession, folder(labelled.sparkSession)
    ring = written(runs.withColumns({"next": F.col("after"), "low": F.col("run")}), f"{home}/low-0")
    for i in count(1):
        there = ring.select(*key, F.col("run").alias("next"), F.col("next").alias("over"), F.col("low").alias("lower"))
        step = ring.join(there, [*key, "next"]).select(*key, "run", "after", "n", F.col("over").alias("next"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("changed"))
        ring = written(step, f"{home}/low-{i}")
        removed(spark, f"{home}/low-{i - 1}")
        if ring.where("changed").isEmpty():
            break
    # the ring is cut before its least run; what is left of it from each run on
    rest = written(ring.select(*key, "run", "low", F.when(F.col("after") != F.col("low"), F.col("after")).alias("next"), F.col("n").alias("left")), f"{home}/left-0")
    for i in count(1):
        there = rest.select(*key, F.col("run").alias("next"), F.col("next").alias("over"), F.col("left").alias("more"))
        step = rest.join(there, [*key, "next"], "left").select(*key, "run", "low", F.col("over").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        rest = written(step, f"{home}/left-{i}")
        removed(spark, f"{home}/left-{i - 1}")
        if rest.where("next is not null").isEmpty():
            break
    whole = rest.where("run = low").select(*key, "low", F.col("left").alias("all"))
    begins = rest.join(whole, [*key, "low"]).select(*key, "run", F.col("low").alias("ring"), (F.col("all") - F.col("left")).alias("begin"))
    return placed.join(begins, [*key, "run"]).select(*key, "ring", (F.col("begin") + F.col("place")).alias("nth"), F.col("r1").alias("r"), F.col("c1").alias("c"), "r2", "c2")


def ring_sums(points: DataFrame) -> DataFrame:
    """group, component, ring, sides, area and hole of every ring of ring_points: sums over its edges, so that no ring is put together."""
    each = (F.col("c") * F.col("r2") - F.col("c2") * F.col("r")) / 2
    rings = points.groupBy("group", "component", "ring").agg(F.count(F.lit(1)).alias("sides"), F.sum(each).alias("signed"))
    return rings.select("group", "component", "ring", "sides", F.abs("signed").alias("area"), (F.col("signed") < 0).alias("hole"))


def outlines(labelled: DataFrame) -> DataFrame:
    """ring_sums and the points of every ring as one array, for what is to be exported; ring_points has them as rows."""
    points = ring_points(labelled)
    gathered = points.groupBy("group", "component", "ring").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "r", "c"))), lambda p: F.array(p["r"], p["c"])).alias("points"))
    return ring_sums(points).join(gathered, ["group", "component", "ring"])


def geojson(points: DataFrame, cell: float = 10.0, west: float = 0.0, north: float = 0.0) -> DataFrame:
    """group, component and its outline as a GeoJSON polygon: the outer ring, then holes by number; x grows with columns, y falls with rows.

    Corners on straight sides are left out first. A component becomes one row here: for what is to be exported.
    """
    order = W.partitionBy("group", "component", "ring").orderBy("nth")
    back = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    turns = points.withColumns({"pr": back("r"), "pc": back("c")}).where((F.col("r") - F.col("pr") != F.col("r2") - F.col("r")) | (F.col("c") - F.col("pc") != F.col("c2") - F.col("c")))
    xy = F.array(F.lit(west) + F.col("c") * cell, F.lit(north) - F.col("r") * cell)
    area = F.sum((F.col("c") * F.col("r2") - F.col("c2") * F.col("r")) / 2)
    hole = points.groupBy("group", "component", "ring").agg((area < 0).alias("hole"))
    rings = turns.groupBy("group", "component", "ring").agg(F.sort_array(F.collect_list(F.struct("nth", xy.alias("xy")))).alias("p")).join(hole, ["group", "component", "ring"])
    closed = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda p: p["xy"])
    whole = rings.groupBy("group", "component").agg(F.sort_array(F.collect_list(F.struct("hole", "ring", closed.alias("points")))).alias("rings"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: r["points"]).alias("coordinates"))
    return whole.select("group", "component", F.to_json(shape).alias("geometry"))


def enclosed(cells: DataFrame, width: int, height: int, unknown: str = "raw = -96", cutoff: float = 40.0) -> DataFrame:
    """Unknown components (8 neighbours) that do not touch the grid's border, with the range of levels around them.

    `size` and `ring` are their classes: cells, and whether every level around lies within 5 dB of the reporting cutoff.
    """
    own = cells.where(unknown).select(F.col("source").alias("group"), "row_i", "col_i")
    labelled = components(own, width, eight=True)
    inner = labelled.groupBy("group", "component").agg(F.count(F.lit(1)).alias("cells"), F.min(F.least("row_i", "col_i")).alias("low"), F.max("row_i").alias("bottom"), F.max("col_i").alias("right"))
    inner = inner.where((F.col("low") > 0) & (F.col("bottom") < height - 1) & (F.col("right") < width - 1)).select("group", "component", "cells")
    around = F.explode(F.array(*[F.struct((F.col("row_i") + r).alias("row_i"), (F.col("col_i") + c).alias("col_i")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]))
    ring = labelled.join(inner, ["group", "component"]).select("group", "component", "cells", around.alias("at")).select("group", "component", "cells", "at.*").distinct()
    level = cells.where("raw > 0").select(F.col("source").alias("group"), "row_i", "col_i", "raw")
    out = ring.join(level, ["group", "row_i", "col_i"], "left").groupBy("group", "component", "cells").agg(F.count("raw").alias("ring_cells"), F.min("raw").alias("ring_min"), F.max("raw").alias("ring_max"))
    return out.withColumns({"size": size_class(F.col("cells")), "ring": ring_class(F.col("ring_max"), cutoff)})


# Classes of sizes and rings.
def size_class(cells: Column) -> Column:
    return F.when(cells <= 4, "1-4").when(cells <= 25, "5-25").when(cells <= 100, "26-100").when(cells <= 1000, "101-1000").otherwise("over-1000")


def ring_class(highest: Column, cutoff: float) -> Column:
    return F.when(highest <= cutoff + 5, "lowest_5db_band").otherwise("higher_reported_ring")


def inventory(inner: DataFrame) -> DataFrame:
    """Components of each group, size and ring, with their cells."""
    return inner.groupBy("group", "size", "ring").agg(F.count(F.lit(1)).alias("components"), F.sum("cells").alias("cells"))


def patches(cells: DataFrame, side: int, every: int) -> DataFrame:
    """Hold-out squares: of each block of `every` x `every` cells the one that the hash order puts first, fully reported.

    Blocks keep a border of one cell, so squares never touch. Returns source, patch and its cells' rows.
    """
    own = cells.withColumns({"br": F.floor(F.col("row_i") / every).cast("long"), "bc": F.floor(F.col("col_i") / every).cast("long")})
    span = every - 1 - side
    draw = lambda axis: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(axis), "br", "bc").cast("binary")), 1, 8), 16, 10).cast("long") % max(1, span)
    off_r, off_c = 1 + draw("row"), 1 + draw("col")
    r, c = F.col("row_i") - F.col("br") * every - off_r, F.col("col_i") - F.col("bc") * every - off_c
    held = own.where(r.between(0, side - 1) & c.between(0, side - 1)).withColumn("patch", F.concat_ws(":", "br", "bc"))
    whole = held.where("raw > 0").groupBy("source", "patch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side * side)
    return held.join(whole.select("source", "patch"), ["source", "patch"]).select("source", "patch", "row_i", "col_i", "raw")


def _in_tiles(rows: DataFrame, halo: int) -> DataFrame:
    """rows with (t_r, t_c) of their tile, and again for each tile that they lie at most `halo` cells off; rows and columns count from 0."""
    near = lambda c: F.sequence(F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / TILE).cast("long"), F.floor((F.col(c) + halo) / TILE).cast("long"))
    return rows.withColumn("t_r", F.explode(near("row_i"))).withColumn("t_c", F.explode(near("col_i")))


def _swept(values: np.ndarray, reach: int, fill, how: np.ufunc) -> np.ndarray:
    """how of a raster over the square of cells at most `reach` away, rows and columns in turn."""
    for axis in (0, 1):
        wide = np.pad(values, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], constant_values=fill)
        n = values.shape[axis]
        values = how.reduce([np.take(wide, range(k, k + n), axis) for k in range(2 * reach + 1)])
    return values


def _candidates_of_tile(key: tuple, pdf: pd.DataFrame, side: int, half: int) -> pd.DataFrame:
    """Middles of full squares in one tile, whose cells come with a border of `half`, and the highest level on their rings."""
    source, t_r, t_c = key
    level = np.full((side + 2 * half, side + 2 * half), -np.inf)
    there = np.zeros(level.shape, bool)
    at = pdf.row_i.to_numpy() - t_r * side + half, pdf.col_i.to_numpy() - t_c * side + half
    level[at], there[at] = pdf.raw.to_numpy(), True
    inner, steps = slice(half, half + side), range(2 * half + 1)
    full = _swept(there, half, False, np.logical_and)[inner, inner]
    along = np.maximum.reduce([level[:, k : k + side] for k in steps])
    tall = np.maximum.reduce([level[k : k + side] for k in steps])
    ring = np.maximum.reduce([along[:side], along[2 * half :], tall[:, :side], tall[:, 2 * half :]])
    r, c = np.nonzero(full)
    return pd.DataFrame({"source": source, "row_i": r + t_r * side, "col_i": c + t_c * side, "ring_max": ring[r, c]})


def candidate_squares(cells: DataFrame, size: int, cutoff: float = 40.0) -> DataFrame:
    """Middles of squares of size x size cells whose cells and one-cell ring are all reported (raw > 0), with their stratum.

    The stratum comes from the ring alone: near_reporting_floor if its highest level is within 5 dB of the cutoff. size is
    odd. Squares are looked for in bounded tiles, so only cells at a tile's border are copied.
    """
    half, side = size // 2 + 1, TILE
    own = _in_tiles(cells.where("raw > 0").select("source", "row_i", "col_i", "raw"), half)
    ring = own.groupBy("source", "t_r", "t_c").applyInPandas(lambda key, pdf: _candidates_of_tile(key, pdf, side, half), "source string, row_i long, col_i long, ring_max double")
    return ring.withColumn("stratum", F.when(F.col("ring_max") <= cutoff + 5, "near_reporting_floor").otherwise("higher_reported"))


#: Cells around a tile that are looked at to decide about its squares.
HALO = 32


def _settled_in_tile(key: tuple, pdf: pd.DataFrame, side: int, reach: int, halo: int) -> pd.DataFrame:
    """Squares of one tile that are taken for sure, and those still open; what is overlapped by a taken one is left out.

    A square is taken for sure if it comes first of all open ones that it overlaps and all of these are in sight.
    """
    source, t_r, t_c = key
    rows, cols = pdf.row_i.to_numpy(), pdf.col_i.to_numpy()
    r0, c0 = rows.min(), cols.min()
    at = rows - r0, cols - c0
    shape = at[0].max() + 1, at[1].max() + 1
    none = len(pdf) + 1
    order = np.lexsort((cols, rows, pdf.h.to_numpy(), pdf.s.to_numpy()))
    place = np.empty(len(pdf), np.int64)
    place[order] = np.arange(len(pdf))
    before, taken, sure, turn = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, bool), np.full(shape, none)
    before[at] = pdf.won.to_numpy()
    off = [x - t * side + halo for x, t in ((rows, t_r), (cols, t_c))]
    sure[at] = np.logical_and.reduce([(o >= reach) & (o < side + 2 * halo - reach) for o in off])
    turn[at] = place
    turn[_swept(before, reach, False, np.logical_or)] = none
    while True:
        first = sure & (turn < none) & (turn == _swept(turn, reach, none, np.minimum))
        if not first.any():
            break
        taken |= first
        turn[_swept(first, reach, False, np.logical_or)] = none
    own = np.logical_and.reduce([(o >= halo) & (o < side + halo) for o in off]) & (taken[at] | (turn[at] < none))
    return pd.DataFrame({"source": source, "row_i": rows[own], "col_i": cols[own], "s": pdf.s.to_numpy()[own], "h": pdf.h.to_numpy()[own], "won": taken[at][own]})


def disjoint_squares(candidates: DataFrame, size: int, width: int, height: int, seed: str = "") -> DataFrame:
    """Candidates whose squares, rings included, do not overlap, and to which none could be added; of a raster of width x height cells.

    Candidates draw a number from their place, those of the near_reporting_floor stratum first. Those with the least number
    of all that they overlap are taken and what they overlap goes, again and again, so the set is what taking them one by one
    would give, whatever the partitions. A tile decides all it can from the candidates up to HALO cells around it; what hangs
    on squares further off goes through another pass, with the squares just taken. Chains of falling numbers are short, so
    passes after the first see few candidates.
    """
    home, reach = folder(candidates.sparkSession), size + 1
    halo, side = max(HALO, reach), TILE
    own = written(candidates.where((F.col("row_i") < height) & (F.col("col_i") < width)), f"{home}/candidates")
    key = ["source", "row_i", "col_i"]
    rank = F.when(F.col("stratum") == "near_reporting_floor", 0).otherwise(1).alias("s"), F.xxhash64(F.lit(seed), *key).alias("h")
    left, taken = own.select(*key, *rank, F.lit(False).alias("won")), []
    for i in count(1):
        step = _in_tiles(left, halo).groupBy("source", "t_r", "t_c").applyInPandas(lambda tile, pdf: _settled_in_tile(tile, pdf, side, reach, halo), "source string, row_i long, col_i long, s int, h long, won boolean")
        left = written(step, f"{home}/{i}")
        taken.append(left.where("won").select(*key))
        if left.where("not won").isEmpty():
            break
    return reduce(DataFrame.unionByName, taken).join(own, key)


def hidden_cells(squares: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """source, patch, row_i, col_i, raw of the cells within each square's ring."""
    half = size // 2
    span = lambda c: F.explode(F.sequence(F.col(c) - half, F.col(c) + half))
    inner = squares.select("source", F.concat_ws(":", F.lit(size), "row_i", "col_i").alias("patch"), "row_i", "col_i").withColumn("r", span("row_i")).withColumn("c", span("col_i"))
    return inner.select("source", "patch", F.col("r").alias("row_i"), F.col("c").alias("col_i")).join(cells.select("source", "row_i", "col_i", "raw"), ["source", "row_i", "col_i"])


def patch_summary(estimates: DataFrame, strata: DataFrame) -> DataFrame:
    """Errors by source, size, stratum and method: over cells, and the 90 % of patches' own mean errors.

    strata: source, patch, size, stratum.
    """
    long = estimates.select("source", "patch", F.expr("stack(3, 'nearest', nearest, 'idw8', idw, 'harmonic_db', harmonic) as (method, estimate)"), "raw")
    e = F.col("estimate") - F.col("raw")
    patch = long.withColumn("e", e).groupBy("source", "patch", "method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.sum("e").alias("sum"), F.sum(F.col("e") * F.col("e")).alias("squares"), F.max(F.abs("e")).alias("most"))
    of = patch.join(strata, ["source", "patch"]).groupBy("source", "size", "stratum", "method")
    cells = F.sum("n")
    return of.agg(
        F.count(F.lit(1)).alias("patches"), cells.alias("cells"), (F.sum(F.col("mae") * F.col("n")) / cells).alias("mae"), F.sqrt(F.sum("squares") / cells).alias("rmse"), (F.sum("sum") / cells).alias("bias"),
        F.percentile("mae", F.lit(0.9)).alias("patch_mae_p90"), F.max("most").alias("max_abs"),
    )


def _operators(r: np.ndarray, c: np.ndarray, hidden: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For hidden cells of patches of one shape: the eight nearest known cells, their weights, and the system of the harmonic estimate."""
    hr, hc, kr, kc = r[hidden], c[hidden], r[known], c[known]
    d2 = ((hr[:, None] - kr) ** 2 + (hc[:, None] - kc) ** 2).astype(float)
    order = np.argsort(d2 * 1e6 + kr * 1e3 + kc, axis=1)[:, :8]
    at = {p: i for i, p in enumerate(zip(hr.tolist(), hc.tolist(), strict=True))}
    fixed = {p: i for i, p in enumerate(zip(kr.tolist(), kc.tolist(), strict=True))}
    a, b = np.zeros((len(at), len(at))), np.zeros((len(at), len(fixed)))
    for (row, col), i in at.items():
        for p in ((row - 1, col), (row + 1, col), (row, col - 1), (row, col + 1)):
            if p in at:
                a[i, i] += 1
                a[i, at[p]] -= 1
            elif p in fixed:
                a[i, i] += 1
                b[i, fixed[p]] += 1
    return order, 1 / np.take_along_axis(d2, order, 1), a, b


_ESTIMATES = "source string, patch string, row_i long, col_i long, raw double, nearest double, idw double, harmonic double"


def _solve_patches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nearest, inverse-distance and harmonic estimates of patches' hidden cells from the cells around them.

    A row is a patch with its cells by row and column; patches whose cells lie alike are solved together. A patch without a
    known cell around has no estimates.
    """
    for pdf in pdfs:
        alike: dict[tuple, list[int]] = {}
        cells = []
        for i, (rows, cols, raw, hidden) in enumerate(zip(pdf.rows, pdf.cols, pdf.raws, pdf.hides, strict=True)):
            r, c, v, h = np.asarray(rows), np.asarray(cols), np.asarray(raw, float), np.asarray(hidden, bool)
            known = ~h & (v > 0)
            cells.append((r, c, v))
            if known.any() and h.any():
                alike.setdefault(((r - r[0]).tobytes(), (c - c[0]).tobytes(), h.tobytes(), known.tobytes()), []).append(i)
        for shape, members in alike.items():
            h, known = (np.frombuffer(x, bool) for x in shape[2:])
            r, c, v = (np.stack([cells[i][k] for i in members]) for k in range(3))
            order, weight, a, b = _operators(r[0] - r[0, 0], c[0] - c[0].min(), h, known)
            level = v[:, known]
            near = level[:, order]
            harmonic = np.linalg.lstsq(a, b @ level.T, rcond=None)[0].T
            n = int(h.sum())
            yield pd.DataFrame({
                "source": np.repeat(pdf.source.to_numpy()[members], n), "patch": np.repeat(pdf.patch.to_numpy()[members], n), "row_i": r[:, h].ravel(), "col_i": c[:, h].ravel(), "raw": v[:, h].ravel(),
                "nearest": near[:, :, 0].ravel(), "idw": ((near * weight).sum(2) / weight.sum(1)).ravel(), "harmonic": harmonic.ravel(),
            })


def interpolated(cells: DataFrame, held: DataFrame, side: int) -> DataFrame:
    """Estimates of held-out patches; a patch is one row with the ring around it, at most (side + 2)^2 cells."""
    around = F.explode(F.array(*[F.struct((F.col("row_i") + r).alias("row_i"), (F.col("col_i") + c).alias("col_i")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    seen = held.select("source", "patch", around.alias("at"), F.col("row_i").alias("r"), F.col("col_i").alias("c")).select("source", "patch", "at.*", ((F.col("at.row_i") == F.col("r")) & (F.col("at.col_i") == F.col("c"))).alias("hidden"))
    seen = seen.groupBy("source", "patch", "row_i", "col_i").agg(F.max("hidden").alias("hidden")).join(cells.select("source", "row_i", "col_i", "raw"), ["source", "row_i", "col_i"])
    each = seen.groupBy("source", "patch").agg(F.sort_array(F.collect_list(F.struct("row_i", "col_i", "raw", "hidden"))).alias("c"))
    each = each.select("source", "patch", *[F.col(f"c.{c}").alias(n) for c, n in (("row_i", "rows"), ("col_i", "cols"), ("raw", "raws"), ("hidden", "hides"))])
    return each.mapInPandas(_solve_patches, _ESTIMATES)


def patch_errors(estimates: DataFrame) -> DataFrame:
    """RMSE, bias and 90 % absolute error of each method and source over all held-out cells; means to 12 decimals, so that the order of a sum does not show."""
    long = estimates.select("source", F.expr("stack(3, 'nearest', nearest, 'idw', idw, 'harmonic', harmonic) as (method, estimate)"), "raw")
    e = F.col("estimate") - F.col("raw")
    return long.groupBy("source", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(e * e)), 12).alias("rmse"), F.round(F.avg(e), 12).alias("bias"), F.percentile(F.abs(e), F.lit(0.9)).alias("p90"))

