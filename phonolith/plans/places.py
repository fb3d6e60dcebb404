"""Queries over names derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.operators import places as op
from phonolith.operators import spatial
from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx

PLACES = """
select p_partkey id, concat(p_name, ' ', p_type) as name, cast(mod(p_size, 4) as bigint) tier, p_brand district, concat('County ', mod(p_partkey, 7)) county,
  cast(530000+mod(p_partkey*7919,20000) as double) x, cast(170000+mod(p_partkey*104729,20000) as double) y from {part}
"""
P = f"({fx.plain(PLACES)})"
FOLD = "trim(regexp_replace(regexp_replace(lower({}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("wn1_place_ranks", PLACES, "select id, name, tier, row_number() over (order by tier, length(name), name, id) rank from {t} x")
def _(places):
    return op.ranked(places)


def asked(places):
    """Every 50th place as a query: the first word of its name and the start of its last, of its brand or of its county; a house number or a flat before some."""
    words = F.split(op.fold(F.col("name")), " ")
    end = F.when(F.col("id") % 200 == 0, "count").when(F.col("id") % 3 == 0, F.substring(F.element_at(F.split(op.fold(F.col("district")), " "), -1), 1, 2)).otherwise(F.substring(F.element_at(words, -1), 1, 2))
    text = F.concat_ws(" ", F.when(F.col("id") % 100 == 0, F.when(F.col("id") % 200 == 0, "Flat 7").otherwise("12a")), F.when(F.col("id") % 7 != 0, F.element_at(words, 1)), end)
    return places.where("id % 50 = 0").select(F.col("id").alias("query_id"), text.alias("words"), F.lit(540000.0).alias("near_x"), F.lit(180000.0).alias("near_y"))


def with_detail(places):
    return places.withColumnRenamed("district", "detail")


SEARCH = f"""p as (select *, string_split({FOLD.format('name')}, ' ') own, list_filter(string_split({FOLD.format('district')}, ' '), lambda w: w <> '') around, list_filter(string_split({FOLD.format('county')}, ' '), lambda w: w <> '') far_around from {P} x),
a as (select id query_id, list_filter([case when id % 7 <> 0 then own[1] end, case when id % 200 = 0 then 'count' when id % 3 = 0 then left(around[-1], 2) else left(own[-1], 2) end], lambda w: w is not null and w <> '') w from p where id % 50 = 0),
q as (select query_id, case when len(w) > 1 and regexp_matches(w[1], '^[0-9]+[a-z]?$') then w[2:] else w end w from a),
m as (select q.query_id, q.w, p.* exclude (around), p.around from q join p on (len(q.w) = 1 or list_contains(list_concat(p.own, p.around, p.far_around), q.w[1])) and len(list_filter(list_concat(p.own, p.around, p.far_around), lambda x: starts_with(x, q.w[-1]))) > 0),
f as (select *, case when own[1:len(w) - 1] = w[1:len(w) - 1] and len(own) >= len(w) and starts_with(own[len(w)], w[-1]) then 0 when starts_with(own[1], w[1]) then 1 when len(list_filter(own, lambda x: starts_with(x, w[1]))) > 0 then 2 else 3 end fit,
  len(list_filter(w, lambda t: len(list_filter(list_concat(own, around), lambda x: starts_with(x, t))) = 0)) missed, round(sqrt(pow(x - 540000, 2) + pow(y - 180000, 2)) / 100) * 100 far from m),
c as (select *, ((case fit when 3 then 8 else fit end) + tier + 2 * missed)::int cost, min(fit) over (partition by query_id) best_fit from f),
r as (select query_id, row_number() over (partition by query_id order by cost, far, length(name), id)::int rank, id, name, cost from c where len(w) > 1 or best_fit = 3 or fit < 3)"""


@query("jn27_tk4_place_search", PLACES, "with " + SEARCH + " select * from r where rank <= 8")
def _(places):
    return op.search(asked(places), with_detail(places))


@query("wn9_names_at_most_three", PLACES, "with " + SEARCH + """,
g as (select *, row_number() over (partition by query_id, name order by rank) nth, first(name) over (partition by query_id order by rank) top from r),
o as (select query_id, row_number() over (partition by query_id order by nth > 3 and name <> top, rank)::int rank, id, name, cost from g)
select * from o where rank <= 8""")
def _(places):
    return op.search(asked(places), with_detail(places), most=3)


@query("ag34_districts", PLACES, """
with n as (select district, name, count(*) n from {t} x group by 1, 2)
select d.district, count(*) places, sum(x) / count(*) x, sum(y) / count(*) y, (select first(name order by n desc, name) from n where n.district = d.district) name from {t} d group by 1""")
def _(places):
    return op.districts(places)


@query("jn28_code_prefixes", PLACES, """
with c as (select id query_id, left(upper(replace(district, '#', '')) || (id % 40), 2 + (id // 50 % 12)::int) "key" from {t} x where id % 50 = 0), k as (select distinct upper(replace(district, '#', '')) || (id % 40) || 'AB' code from {t} x)
select query_id, code from c, k where starts_with(code, "key") and not (regexp_matches("key", '[0-9]$') and regexp_matches(substr(code, length("key") + 1, 1), '[0-9]'))""")
def _(places):
    code = F.concat(F.upper(F.regexp_replace("district", "#", "")), (F.col("id") % 40).cast("string"))
    queries = places.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.substring(code, F.lit(1), (2 + F.floor(F.col("id") / 50) % 12).cast("int")).alias("key"))
    return op.by_prefix(queries, places.select(F.concat(code, F.lit("AB")).alias("code")).distinct())


@query("jn26_nearest_name", sql=f"""
with r as ({fx.plain(fx.RECEPTORS)}), d as (select r.receptor_id, p.id, p.tier, sqrt(pow(r.x - p.x, 2) + pow(r.y - p.y, 2)) dist from r, {P} p where abs(r.x - p.x) <= 3000 and abs(r.y - p.y) <= 3000),
a as (select receptor_id, first(id order by dist, id) id, min(dist) dist from d where tier = 3 and dist <= 400 group by 1), b as (select receptor_id, first(id order by dist, id) id, min(dist) dist from d where tier < 3 and dist <= 3000 group by 1)
select r.receptor_id, coalesce(a.id, b.id) id, round(coalesce(a.dist, b.dist), 4) dist, case when a.id is not null then 'postcode' when b.id is not null then 'settlement' end basis from r left join a using (receptor_id) left join b using (receptor_id)""")
def _(spark, d):
    points, places = fx.derived(spark, d, fx.RECEPTORS).select("receptor_id", "x", "y"), fx.derived(spark, d, PLACES)
    dots = places.select("id", "tier", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = lambda rows, rings, name: spatial.nearest(points, rows, "receptor_id", "id", rings).select("receptor_id", F.col("id").alias(f"{name}_id"), F.col("dist").alias(f"{name}_dist"))
    out = points.select("receptor_id").join(near(dots.where("tier = 3"), (400.0,), "a"), "receptor_id", "left").join(near(dots.where("tier < 3"), (500.0, 3000.0), "b"), "receptor_id", "left")
    basis = F.when(F.col("a_id").isNotNull(), "postcode").when(F.col("b_id").isNotNull(), "settlement")
    return out.select("receptor_id", F.coalesce("a_id", "b_id").alias("id"), F.round(F.coalesce("a_dist", "b_dist"), 4).alias("dist"), basis.alias("basis"))


@query("prj13_st6_names", PLACES, f"""
with f as (select id, {FOLD.format('name')} f, regexp_replace(upper(district), '[^A-Z0-9]', '', 'g') r from {{t}} x)
select a.id, a.f folded, a.r reference, len(list_intersect(list_distinct(string_split(a.f, ' ')), list_distinct(string_split(b.f, ' ')))) >= 2 same from f a join f b on b.id = a.id + 1""")
def _(places):
    own = places.select("id", op.fold(F.col("name")).alias("folded"), op.reference(F.col("district")).alias("reference"))
    other = own.select((F.col("id") - 1).alias("id"), F.col("folded").alias("o"))
    same = F.size(F.array_intersect(F.split("folded", " "), F.split("o", " "))) >= 2
    return own.join(other, "id").select("id", "folded", "reference", same.alias("same"))
