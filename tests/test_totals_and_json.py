"""Totals that must add up, and JSON whose keys must not repeat."""

import pytest
from pyspark.sql import functions as F

from phonolith.operators import cells, models
from phonolith.sources import readers

TABLE = [("a", "x", "u", 2), ("a", "x", "v", 1), ("a", "x", None, 3), ("a", "y", "u", 4), ("a", "y", None, 4), ("a", None, None, 7), ("b", "x", "u", 5), ("b", "x", None, 5), ("b", None, None, 5), (None, None, None, 12)]
SCHEMA = "g string, q string, k string, n long"


def proved(spark, rows, expected=(("a", 7), ("b", 5))):
    return {tuple(r) for r in cells.reconciled(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(expected), "g string, cells long"), ["g", "q", "k"], "g").collect()}


def test_totals_that_add_up_pass(spark):
    assert proved(spark, TABLE) == set(TABLE)


@pytest.mark.parametrize("at, n", [(2, 4), (5, 8), (9, 13), (0, 3)])
def test_a_total_that_fails_raises(spark, at, n):
    rows = [(*r[:3], n) if i == at else r for i, r in enumerate(TABLE)]
    with pytest.raises(Exception, match="sum of its parts"):
        proved(spark, rows)


def test_cells_that_are_missing_raise(spark):
    with pytest.raises(Exception, match="do not add up in b"):
        proved(spark, TABLE, (("a", 7), ("b", 6)))


def test_repeated_keys_are_refused_and_order_does_not_count(spark, tmp_path):
    one, two = '{"tiles": {"t1": {"bands": {"a": {"status": "ready", "sha256": "1"}}}}, "v": 1}', '{"v":1,"tiles":{"t1":{"bands":{"a":{"sha256":"1","status":"ready"}}}}}'
    for name, text in (("one", one), ("two", two), ("three", one.replace('"ready"', '"gone"')), ("twice", one.replace('"sha256": "1"', '"sha256": "1", "sha256": "2"')), ("none", '{"v": 1}'), ("broken", one[:-3])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.json").write_text(text)
    read = lambda name: readers.identified_manifests(spark, str(tmp_path / name)).collect()
    assert read("one") == read("two") and read("one")[0].digest != read("three")[0].digest and read("three")[0].status == "gone"
    for name in ("twice", "none", "broken"):
        with pytest.raises(Exception, match="DUPLICATE|without tiles|MALFORMED|MALFORMED_RECORD"):
            read(name)
    nested = spark.createDataFrame([('{"b": [1, {"d": 1, "c": null}], "a": "x"}',)], "j string")
    assert nested.select(readers.sorted_json(F.col("j"))).first()[0] == '{"a":"x","b":[1,{"c":null,"d":1}]}'


def test_slices_in_one_pass(spark):
    rows = [(None if i % 5 == 0 else i % 3, i % 2 == 0, float(i), float(i + i % 4), 1.0 + i % 2) for i in range(60)]
    got = {(r.slice, r.value): r for r in models.sliced_errors(spark.createDataFrame(rows, "region int, loud boolean, observed double, predicted double, weight double"), ["region", "loud"], "observed", "predicted", "weight").collect()}
    assert set(got) == {("all", None), ("region", None), ("region", "0"), ("region", "1"), ("region", "2"), ("loud", "true"), ("loud", "false")}
    own = [r for r in rows if r[0] is None]
    assert got["region", None].n == len(own) and got["region", None].mae == pytest.approx(sum(r[4] * (r[3] - r[2]) for r in own) / sum(r[4] for r in own)) and got["all", None].n == 60
