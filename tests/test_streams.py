"""Streams in several batches, with rows that come too late and receivers that fall silent."""

from phonolith.sources.scratch import streamed_in_turn
from phonolith.streaming import intervals as op

SCHEMA = "receiver_id long, start_s long, end_s long, level_db double"
DAY, HOUR = 86400, 3600


def frames(spark, *batches):
    return [spark.createDataFrame([(r, 100 * DAY + a, 100 * DAY + b, level) for r, a, b, level in rows], SCHEMA) for rows in batches]


def test_closed_windows_are_given_out_once(spark):
    batches = frames(
        spark, [(1, 0, 600, 30.0), (1, 600, 4000, 50.0), (2, 0, 100, 60.0)], [(2, 9 * HOUR, 9 * HOUR + 50, 40.0), (1, 3700, 4100, 50.0)],
        [(1, 100, 200, 90.0), (2, 8 * HOUR, 8 * HOUR + 10, 40.0), (2, 12 * HOUR, 12 * HOUR + 1, 40.0)], [(1, 10, 20, 90.0), (3, 10, 20, 90.0), (3, 20, 30, 90.0), (2, 20 * HOUR, 20 * HOUR + 1, 40.0)],
    )
    out, figures = streamed_in_turn(batches, lambda s: op.windowed_levels(s, HOUR, "2 hours"), "append")
    got = [(r.receiver_id, int(r.from_ts.timestamp()) // HOUR - 2400, r.observed_s, r.batch) for r in out.orderBy("from_ts", "receiver_id").collect()]
    # the third batch's first row and all of the fourth's early ones are late; two of these share a receiver and window
    assert got == [(1, 0, 3600, 1), (2, 0, 100, 1), (1, 1, 800, 1), (2, 8, 10, 2), (2, 9, 50, 2), (2, 12, 1, 3)]
    assert [f["dropped"] for f in figures] == [0, 0, 1, 2] and figures[0]["state"] == 3 and figures[3]["state"] == 1
    whole = op.windowed_levels(batches[0].unionByName(batches[1]), HOUR).where("hour(from_ts) < 2").collect()
    assert {(r.receiver_id, r.observed_s, round(r.laeq_db, 9)) for r in whole} == {(r.receiver_id, r.observed_s, round(r.laeq_db, 9)) for r in out.where("batch = 1").collect()}


def test_state_ends_with_silence(spark):
    batches = frames(
        spark, [(1, 600, 1200, 35.0), (1, 0, 600, 30.0), (2, 0, 100, 50.0)], [(2, 150, 250, 30.0), (2, 90, 140, 30.0), (2, 250, 300, 20.0)],
        [(2, 40 * HOUR, 40 * HOUR + 9, 20.0)], [(2, 40 * HOUR + 9, 40 * HOUR + 100, 20.0), (1, 41 * HOUR, 41 * HOUR + 5, 39.0), (1, 5, 6, 10.0)],
    )
    out, figures = streamed_in_turn(batches, lambda s: op.quiet_time(s, idle_s=DAY), "update", rocks=True)
    got = {(r.batch, r.receiver_id, r.kind, r.start_s and r.start_s - 100 * DAY, r.end_s - 100 * DAY, r.longest_quiet_s) for r in out.collect()}
    assert got == {
        (0, 1, "heard", None, 1200, 1200), (0, 2, "heard", None, 100, 0), (1, 2, "late", 90, 140, 150), (1, 2, "heard", None, 300, 150),
        (2, 2, "heard", None, 40 * HOUR + 9, 150), (2, 1, "ended", None, 1200, 1200), (3, 2, "heard", None, 40 * HOUR + 100, 150), (3, 1, "heard", None, 41 * HOUR + 5, 5),
    }
    assert [f["state"] for f in figures] == [2, 2, 1, 2] and figures[3]["dropped"] == 1


def test_receivers_of_a_block_share_a_group(spark, monkeypatch):
    """Ends of many receivers by one timer, ids that are negative or null, and far fewer groups than receivers."""
    own, groups = op.QuietTime.handleInputRows, spark.sparkContext.accumulator(0)

    class Counted(op.QuietTime):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            groups.add(1)
            return own(self, key, rows, timerValues)

    monkeypatch.setattr(op, "QuietTime", Counted)
    ids = [None, -300, -1, *range(100)]
    first = [(r, 0 if r is None else r % 7, 60, 30.0) for r in ids]
    batches = frames(spark, first, [(5, 30 * HOUR, 30 * HOUR + 10, 30.0)], [(5, 30 * HOUR + 10, 30 * HOUR + 15, 30.0)])
    out, figures = streamed_in_turn(batches, lambda s: op.quiet_time(s, idle_s=DAY), "update", rocks=True)
    rows = out.collect()
    ended = {(r.receiver_id, r.end_s - 100 * DAY, r.longest_quiet_s) for r in rows if r.kind == "ended"}
    assert ended == {(r, 60, 60 - (0 if r is None else r % 7)) for r in ids if r != 5} and len([r for r in rows if r.kind == "ended"]) == len(ids) - 1
    assert [(r.end_s - 100 * DAY - 30 * HOUR, r.longest_quiet_s) for r in rows if r.receiver_id == 5 and r.batch == 2] == [(15, 55)]
    assert figures[0]["state"] == len(ids) and figures[2]["state"] == 1 and 0 < groups.value < 10
