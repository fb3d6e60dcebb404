"""Stream operators run over a table as a stream that ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolith.plans.registry import query
from phonolith.sources import fixtures as fx
from phonolith.sources.scratch import streamed, streamed_in_turn, written
from phonolith.streaming import intervals as op


@query("sm1_windowed_levels", fx.INTERVALS, """
with h as (select *, unnest(range(start_s // 7200, (end_s - 1) // 7200 + 1)) w from {t} x), c as (select *, least(end_s, (w + 1) * 7200) - greatest(start_s, w * 7200) s from h)
select receiver_id, w * 7200 from_s, sum(s)::bigint observed_s, round(10 * log10(sum(s * pow(10, level_db / 10)) / sum(s)), 4) laeq_db from c group by 1, 2""")
def _(x):
    return op.windowed_levels(x, 7200).select("receiver_id", F.unix_seconds("from_ts").alias("from_s"), "observed_s", F.round("laeq_db", 4).alias("laeq_db"))


@query("sm1_level_stream", fx.INTERVALS, """
with h as (select *, unnest(range(start_s // 7200, (end_s - 1) // 7200 + 1)) w from {t} x), c as (select *, least(end_s, (w + 1) * 7200) - greatest(start_s, w * 7200) s from h)
select receiver_id, w * 7200 from_s, sum(s)::bigint observed_s, round(10 * log10(sum(s * pow(10, level_db / 10)) / sum(s)), 4) laeq_db from c group by 1, 2""")
def _(x):
    """The whole table as a stream: every window's last state."""
    out = streamed(x, lambda s: op.windowed_levels(s, 7200), "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).select("receiver_id", F.unix_seconds("from_ts").alias("from_s"), "observed_s", F.round("laeq_db", 4).alias("laeq_db"))


@query("sm2_quiet_stream", fx.INTERVALS, """
with i as (select *, lag(end_s) over o prev, lag(level_db) over o prev_level from {t} x window o as (partition by receiver_id order by start_s, end_s)),
b as (select *, sum(case when level_db < 40 and prev_level < 40 and prev = start_s then 0 else 1 end) over (partition by receiver_id order by start_s, end_s rows unbounded preceding) run from i),
l as (select receiver_id, run, sum(end_s - start_s) filter (level_db < 40) s, max(end_s) upto_s from b group by 1, 2)
select receiver_id, coalesce(max(s), 0)::bigint longest_quiet_s, max(upto_s) upto_s from l group by 1""")
def _(x):
    out = streamed(x, op.quiet_runs, "update")
    return out.groupBy("receiver_id").agg(F.max_by("longest_quiet_s", "batch").alias("longest_quiet_s"), F.max_by("upto_s", "batch").alias("upto_s"))


RUNS = 4
#: The run in which an interval arrives: quarters of the time between the first and the last start.
IN_RUNS = """o as (select min(start_s) a, max(start_s) b from {t} q),
t4 as (select x.*, least(3, floor((start_s - a) * 4.0 / (b - a + 1))) run from {t} x, o)"""
PIECES = "with " + IN_RUNS + """,
h as (select *, unnest(range(start_s // 7200, (end_s - 1) // 7200 + 1)) w from t4),
m as (select run, max(w) top from h group by 1),
e as (select run, coalesce(max(top) over (order by run rows between unbounded preceding and 1 preceding), 0) before from m),
c as (select h.*, least(end_s, (w + 1) * 7200) - greatest(start_s, w * 7200) s, (w + 1) * 7200 <= before * 7200 - 7200 late from h join e on e.run = h.run)"""


def in_runs(x):
    """The rows of each run, which lie in each other's past; written once, as every run picks its own from all."""
    x = written(x)
    a, b = x.agg(F.min("start_s"), F.max("start_s")).first()
    run = F.least(F.lit(RUNS - 1), F.floor((F.col("start_s") - a) * 4.0 / (b - a + 1)))
    return [x.where(run == i) for i in range(RUNS)]


@query("sm1_closed_windows", fx.INTERVALS, PIECES + """
select receiver_id, w * 7200 from_s, sum(s)::bigint observed_s, round(10 * log10(sum(s * pow(10, level_db / 10)) / sum(s)), 4) laeq_db from c
where not late and (w + 1) * 7200 <= (select max(w) from c) * 7200 - 7200 group by 1, 2""")
def _(x):
    """Windows that the watermark has closed, each given out once and for good; what arrives after that is left out."""
    out, _ = streamed_in_turn(in_runs(x), lambda s: op.windowed_levels(s, 7200), "append")
    return out.select("receiver_id", F.unix_seconds("from_ts").alias("from_s"), "observed_s", F.round("laeq_db", 4).alias("laeq_db"))


@query("sm1_late_counts", fx.INTERVALS, PIECES + """
select run::bigint batch, count(distinct (receiver_id, w)) filter (late) dropped from c group by 1""")
def _(x):
    """What arrived too late in each run, as the state operator counts it: receivers' windows, whose rows were summed before."""
    _, figures = streamed_in_turn(in_runs(x), lambda s: op.windowed_levels(s, 7200), "append")
    return x.sparkSession.createDataFrame([(f["batch"], f["dropped"]) for f in figures], "batch long, dropped long")


@query("sm2_quiet_timers", fx.INTERVALS, """
with i as (select *, lag(end_s) over o prev, lag(level_db) over o prev_level from {t} x window o as (partition by receiver_id order by start_s, end_s)),
b as (select *, sum(case when level_db < 40 and prev_level < 40 and prev = start_s then 0 else 1 end) over (partition by receiver_id order by start_s, end_s rows unbounded preceding) run from i),
l as (select receiver_id, run, sum(end_s - start_s) filter (level_db < 40) s, max(end_s) upto_s from b group by 1, 2)
select receiver_id, coalesce(max(s), 0)::bigint longest_quiet_s, max(upto_s) upto_s, 0::bigint late from l group by 1""")
def _(x):
    """Longest quiet runs with state that ends a day after a receiver was last heard; a run never goes on over that."""
    out, _ = streamed_in_turn(in_runs(x), op.quiet_time, "update", rocks=True)
    return out.groupBy("receiver_id").agg(F.max("longest_quiet_s").alias("longest_quiet_s"), F.max("end_s").alias("upto_s"), F.count_if(F.col("kind") == "late").alias("late"))
