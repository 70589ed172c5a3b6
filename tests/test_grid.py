"""Slots, sources, alignment (traps T1-T5) and exact order statistics."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.functions.numbers import ape_floor, ape_official, combine, finite, to_number
from slotwise.functions.slots import slot_of, slot_start
from slotwise.operators.grid import align, collapse, densify, lengthen, outer_align, resample, slot_skeleton
from slotwise.operators.order_stats import INTERPOLATIONS, evenly_spaced, exact_quantiles, weighted_median
from slotwise.sources.tables import (
    FieldSpec, TableSpec, bind_fields, load_original_columns, parse_time, read_frame, read_table, resolve_sources, table_quality, tag_source,
    training_only, write_checked, write_frame, feature_family, forecast_origins, load_aligned,
)
from slotwise.plans.contracts import ContractError, count_rules


def test_right_closed_bins_keep_the_exact_edge(spark):
    times = ["2025-01-01 00:15:00", "2025-01-01 00:15:01", "2025-01-01 00:00:01", "2025-01-01 00:00:00"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in times], "ts timestamp_ntz")
    out = [r[0] for r in df.select(slot_start(slot_of("ts", 900), 900)).collect()]
    assert [o.strftime("%H:%M") for o in out] == ["00:15", "00:30", "00:15", "00:00"]


def test_slots_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 30, 2, 30),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.add(df.select(slot_of("ts", 900), slot_start(slot_of("ts", 900), 900)).first())
        assert len(seen) == 1 and seen.pop()[1] == dt.datetime(2025, 3, 30, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("label,closed", [("left", "left"), ("left", "right"), ("right", "left"), ("right", "right")])
def test_variants_equal_pandas(spark, label, closed):
    times = pd.date_range("2025-01-01", periods=40, freq="7min")
    pdf = pd.DataFrame({"ts": times, "v": np.arange(40.0)})
    want = pdf.set_index("ts")["v"].resample("15min", label=label, closed=closed).mean().dropna()
    df = spark.createDataFrame(pdf).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("s").alias("k"), "v")
    got = resample(df, ["k"], "ts", {"v": "mean"}, 900, label, closed).select(slot_start("pos", 900).alias("ts"), "v").toPandas()
    got = got.set_index("ts")["v"].sort_index()
    assert list(got.index) == list(want.index) and np.allclose(got, want)


def test_collapse_first_last_follow_the_ordinal(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 1, None), ("a", 2, 5.0), ("a", 9, None)], "k string, o int, v double")
    row = collapse(df.select("k", "o", *[F.col("v").alias(m) for m in ("first", "last", "median", "mean")]), ["k"],
                   {m: m for m in ("first", "last", "median", "mean")}, "o").first()
    assert (row["first"], row["last"], row["median"], row["mean"]) == (5.0, 1.0, 3.0, 3.0)
    with pytest.raises(ValueError):
        collapse(df, ["k"], {"v": "mode"})


def test_gap_flag_is_outside_every_table_range(spark):
    mk = lambda f, ps: spark.createDataFrame([("p", f, p, 1.0) for p in ps], "series_id string, field string, pos long, value double")
    out = align({"a": mk("x", [1, 4]), "b": mk("y", [8, 9])}, ["x"])
    rows = {(r["field"], r["pos"]): (r["value"], r["gap_inserted"]) for r in out.collect()}
    assert len(rows) == 18
    # the hole inside table a is an empty bin of a summed field, not a gap
    assert rows["x", 2] == (0.0, 0) and rows["x", 8] == (None, 0) and rows["x", 6] == (None, 1) and rows["y", 2] == (None, 0)
    with pytest.raises(Exception, match="several tables"):
        align({"a": mk("x", [1]), "b": mk("x", [2])}).collect()


def test_long_skeleton_is_built_block_by_block(spark):
    bounds = spark.createDataFrame([("s", 5, 25_000)], "series_id string, lo long, hi long")
    out = slot_skeleton(bounds, block=1000)
    assert out.count() == 24_996 and out.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (5, 25_000, 24_996)


def test_sources_resolve_in_order_and_combine(spark):
    spec = FieldSpec("p", ("b", "a", "zz"), ("c.*", "a"))
    assert resolve_sources(["a", "b", "c1", "xc1"], spec) == ["b", "a", "c1"]
    df = spark.createDataFrame([("1", None, "x"), (None, None, None), ("2", "3", "4")], "a string, b string, c1 string")
    got = [r[0] for r in df.select(bind_fields(df, [spec])["p"].alias("p")).collect()]
    assert got == [1.0, None, 9.0]
    assert [r[0] for r in df.select(combine([to_number("a"), to_number("b")], "mean")).collect()] == [1.0, None, 2.5]
    with pytest.raises(ValueError):
        bind_fields(df, [FieldSpec("q", ("nothing",), required=True)])


def test_bad_numbers_and_times_become_null(spark):
    df = spark.createDataFrame([("1e3", "2025-01-01 00:00:00"), ("NaN", "2025-13-01 00:00:00"), ("inf", None), ("x", "bad")], "n string, t string")
    rows = df.select(to_number("n"), parse_time(df, "t")).collect()
    assert [r[0] for r in rows] == [1000.0, None, None, None]
    assert [r[1] is None for r in rows] == [False, True, True, True]


def test_percentage_errors_at_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (2.0, 1.0)], "y double, p double")
    rows = df.select(ape_official("y", "p"), ape_floor("y", "p")).collect()
    assert rows[0][0] == float("inf") and np.isnan(rows[1][0]) and rows[2][0] == 0.5
    assert rows[0][1] == 1e6 and rows[1][1] == 0.0
    assert df.select(finite(F.lit(float("nan")))).first()[0] is None


def test_outer_align_refuses_clashing_names(spark):
    a = spark.createDataFrame([(1, 2.0)], "t int, v double")
    with pytest.raises(ValueError):
        outer_align([a, a], ["t"])


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n) * 10) / 2  # many ties
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", None)], "k string, v double")
    qs = {"q1": 0.25, "q3": 0.75, "p95": 0.95}
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], F.col("v"), qs, INTERPOLATIONS, ranges=8).collect()}
    for name, q in qs.items():
        for rule in INTERPOLATIONS:
            assert out["a"][f"{name}_{rule}"] == pytest.approx(np.quantile(values, q, method=rule)), (name, rule)
    assert out["b"]["q1_linear"] == 1.0 and out["b"]["n"] == 1


def test_exact_quantiles_without_keys_and_with_a_hot_group(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
                                    (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    pdf = df.toPandas()
    got = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5}).collect()}
    assert got == pytest.approx(pdf.groupby("k")["v"].median().to_dict())
    assert exact_quantiles(df, [], F.col("v"), {"m": 0.9}).first()["m"] == pytest.approx(pdf["v"].quantile(0.9))


def test_weighted_median_and_even_spacing(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("b", 4.0, 1.0), ("b", 5.0, 1.0)], "k string, v double, w double")
    out = {r["k"]: r["m"] for r in weighted_median(df, ["k"], F.col("v"), F.col("w"), "m").collect()}
    assert out == {"a": 3.0, "b": 4.0}
    assert evenly_spaced(10, 4) == [0, 3, 6, 9] and evenly_spaced(3, 5) == [0, 1, 2]


def test_files_round_trip_and_suffix_rule(spark, tmp_path):
    text = "﻿datetime,gas_1,gas_2\n2025-01-01 00:00:00,1.5,2\n2025-01-01 00:15:00,x,4\nbroken,5,6\n2025-01-01 00:15:00,3,\n"
    path = tmp_path / "gas.csv"
    path.write_text(text, encoding="utf-8")
    raw = read_table(spark, str(path))
    assert raw.columns[0] == "datetime"
    spec = TableSpec("gas", "datetime", (FieldSpec("gas", ("gas_1", "gas_2")),))
    q = table_quality(raw, spec, 900).collect()
    filled = [r for r in q if r["filled_slots"]][0]
    assert (filled["input_rows"], filled["invalid_rows"], filled["duplicate_rows"], filled["output_rows"]) == (4, 1, 1, 2)
    aligned = load_aligned(spark, [(spec, str(path))], 900)
    assert sorted(r["value"] for r in aligned.collect()) == [3.5, 3.5]
    with pytest.raises(ValueError):
        read_table(spark, "a.xlsx")
    frame = spark.createDataFrame([("p", dt.datetime(2025, 1, 1), 1.23456789)], "series_id string, ts timestamp_ntz, v double")
    write_frame(frame, str(tmp_path / "out"), 900)
    back = read_frame(spark, str(tmp_path / "out")).first()
    assert back["v"] == 1.234568 and back["ts"] == dt.datetime(2025, 1, 1)


def test_original_columns_need_unique_times(spark):
    good = spark.createDataFrame([("2025-01-01 00:00:00", "1")], "datetime string, a string")
    other = spark.createDataFrame([("2025-01-01 00:00:00", "2")], "datetime string, b string")
    assert load_original_columns({"x": good, "y": other}).columns == ["ts", "a", "b"]
    with pytest.raises(ContractError):
        load_original_columns({"x": good.union(good)})


def test_written_table_is_checked_twice(spark, tmp_path):
    rules = lambda df: count_rules(df, {"negative": F.col("v") < 0})
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert write_checked(df, str(tmp_path / "ok"), rules).count() == 2
    with pytest.raises(ContractError):
        write_checked(df.selectExpr("-v as v"), str(tmp_path / "bad"), rules)


def test_scoring_rows_cannot_be_trained_on(spark):
    df = spark.createDataFrame([("p", 1, 2.0)], "series_id string, pos long, value double")
    assert training_only(tag_source(df, "training")).count() == 1
    with pytest.raises(Exception, match="scoring rows"):
        # the guard is a filter, so no column pruning can drop it
        training_only(tag_source(df, "scoring")).select("pos").collect()


def test_origins_and_families(spark, long_grid):
    grid = long_grid({"x": range(10), "y": range(10)})
    assert forecast_origins(grid, last=3).count() == 3
    names = ["feat_current_a", "feat_lag_a_4", "feat_roll_a_8_mean", "feat_current_b", "feat_time_hour"]
    assert feature_family(names, "target", "a") == names[:3]
    assert feature_family(names, "compact", "a") == [names[0], names[1], names[4]]


def test_densify_and_lengthen(spark, long_grid):
    rows = long_grid({"x": [1, None, 3]}).where("value is not null")
    assert densify(rows).count() == 3
    wide = rows.groupBy("series_id", "pos").agg(F.max("value").alias("x"))
    assert lengthen(wide, ["x"]).count() == 2
