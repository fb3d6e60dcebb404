"""Noise-shaped tables derived from the driver's tables; one SQL text serves Spark and the comparison engine alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CELLS = """
select cast(floor(k/120.0) as bigint) row_i, cast(mod(k,120) as bigint) col_i, source,
  case when mod(v,11)=0 or (source='aircraft' and mod(v,3)<>0) then cast(-96 as double)
       when source<>'aircraft' and mod(v,4)=0 then cast(0 as double)
       else cast(4000+mod(v,4000) as double)/100 end raw
from (select o_orderkey k, 'road' source, cast(round(o_totalprice*100) as bigint) v from {orders}
      union all select o_orderkey, 'rail', cast(round(o_totalprice*100) as bigint)*31+7*o_orderkey from {orders}
      union all select o_orderkey, 'aircraft', cast(round(o_totalprice*100) as bigint)*17+3*o_orderkey from {orders}) x
"""

LINKS = """
select s_suppkey link_id, s_nationkey road_no,
  case when mod(s_suppkey,5)=0 then 'motorway' when mod(s_suppkey,5)=1 then 'a_road' else 'minor' end road_class,
  cast(530000+mod(s_suppkey*7919,20000) as double) x1, cast(170000+mod(s_suppkey*104729,20000) as double) y1,
  cast(530000+mod(s_suppkey*7919,20000)+mod(s_suppkey*37,400)-200 as double) x2,
  cast(170000+mod(s_suppkey*104729,20000)+mod(s_suppkey*53,400)-200 as double) y2,
  cast(500+mod(s_suppkey*7873,40000) as double) flow, cast(mod(s_suppkey*131,400) as double) hgv_flow
from {supplier}
"""

#: Lines of 2 to 7 points that bend; those of every tenth link end in a part of their own, some points repeat.
VERTICES = """
select s_suppkey link_id, s_nationkey road_no, cast(case when mod(s_suppkey,10)=0 and k>=3 then 1 else 0 end as int) part, k seq,
  case when mod(s_suppkey,5)=0 then 'motorway' when mod(s_suppkey,5)=1 then 'a_road' else 'minor' end road_class,
  cast(530000+mod(s_suppkey*7919,20000)+k*(mod(s_suppkey*37,200)-100)+mod(s_suppkey*(k+3)*31,120) as double) x,
  cast(170000+mod(s_suppkey*104729,20000)+k*(mod(s_suppkey*53,200)-100)+case when mod(s_suppkey,7)=0 then 0 else mod(s_suppkey*(k+5)*17,90) end as double) y,
  cast(500+mod(s_suppkey*7873,40000) as double) flow, cast(mod(s_suppkey*131,400) as double) hgv_flow
from {supplier} cross join (values (0),(1),(2),(3),(4),(5),(6)) v(k) where k < 2+mod(s_suppkey,6)
"""

RECEPTORS = """
select c_custkey receptor_id, c_nationkey region_id,
  cast(530000+mod(c_custkey*15485863,20000) as double) x, cast(170000+mod(c_custkey*32452843,20000) as double) y,
  c_acctbal observed
from {customer}
"""

POINTS = """
select p_partkey point_id, cast(mod(p_partkey,25) as bigint) road_no,
  cast(530000+mod(p_partkey*7919,20000)+mod(p_partkey*11,60) as double) x, cast(170000+mod(p_partkey*104729,20000)+mod(p_partkey*13,60) as double) y,
  cast(100+mod(p_partkey*7,9000) as double) flow, p_size size
from {part}
"""

INTERVALS = """
select receiver_id, start_s, end_s, level_db from (
  select user_id receiver_id, s start_s, lead(s) over (partition by user_id order by s, event_id) end_s,
    cast(3000+mod(cast(round(value*100) as bigint),4000) as double)/100 level_db
  from (select user_id, event_id, value, cast(floor({micros}/1000000.0) as bigint) s from {events}) e) q
where end_s is not null and end_s > start_s
"""

COUNTS = """
select cast(mod(user_id,50) as bigint) count_point_id, cast(ts as date) count_date, cast(hour(ts) as bigint) hr,
  case when mod(event_id,2)=0 then 'N' else 'S' end direction, cast(count(*) as bigint) flow,
  cast(sum(case when event_type='error' then 1 else 0 end) as bigint) hgv
from {events} group by 1,2,3,4
"""

_TABLES = {"orders", "supplier", "customer", "part", "events", "nation"}


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The table that a text above describes, over the driver's files."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{%s}" % t in text}
    return spark.sql(text.replace("{micros}", "unix_micros(cast(ts as timestamp))"), **used)


def plain(text: str) -> str:
    """The same text with the tables' own names, for the comparison engine."""
    for t in _TABLES:
        text = text.replace("{%s}" % t, t)
    return text.replace("{micros}", "epoch_us(ts)")
