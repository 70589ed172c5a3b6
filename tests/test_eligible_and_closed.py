"""Blends on eligible rows, any number of candidates; gates and contracts that fail on nothing."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators.blocks import join_small
from slotwise.operators.neighbours import PivotIndex
from slotwise.plans.contracts import ContractError, forecast_frame_rules, input_frame_rules, plan_frame_rules
from slotwise.plans.fusion import gram, hard_winner, oof_weights, simplex_fit
from slotwise.plans.gates import candidate_gate, column_gate


def best_support(g, b):
    """Least loss over all supports that are feasible."""
    best = np.inf
    for size in range(1, len(b) + 1):
        for idx in map(list, combinations(range(len(b)), size)):
            kkt = np.ones((size + 1, size + 1))
            kkt[:-1, :-1], kkt[-1, -1] = g[np.ix_(idx, idx)], 0
            w = np.linalg.lstsq(kkt, np.append(b[idx], 1.0), rcond=None)[0][:-1]
            if w.min() >= -1e-10:
                best = min(best, w @ g[np.ix_(idx, idx)] @ w - 2 * b[idx] @ w)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_active_set_finds_the_optimum(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 7))
    p = rng.normal(size=(30, k)) + rng.normal() * 3
    if k > 2 and seed % 3 == 0:
        p[:, 1] = p[:, 0]
    y = p @ rng.dirichlet(np.ones(k) / 2) + rng.normal(size=30) * 0.3
    g, b = p.T @ p, p.T @ y
    w = simplex_fit(g, b, np.ones(k, bool))
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    assert w @ g @ w - 2 * b @ w == pytest.approx(best_support(g, b), rel=1e-7, abs=1e-7)


def test_forty_members_keep_the_optimality_conditions():
    rng = np.random.default_rng(1)
    p, y = rng.normal(size=(300, 40)) + 4, rng.normal(size=300) + 4
    g, b = p.T @ p, p.T @ y
    allowed = np.arange(40) % 5 > 0
    w = simplex_fit(g, b, allowed)
    slope = g @ w - b
    level = slope @ w
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and not w[~allowed].any()
    assert (slope[allowed] >= level - 1e-6 * abs(level)).all() and np.allclose(slope[w > 0], level, rtol=1e-6)


def test_rejected_candidate_with_gaps_drops_no_row(spark):
    rows = [(f"recent_{i % 3}", "a", 1, 100.0 + i, 101.0 + i, 99.0 + i, None if i % 2 else 5.0) for i in range(15)]
    models = ["m0", "m1", "m2"]
    wide = spark.createDataFrame(rows, "fold string, field string, horizon int, y_true double, m0 double, m1 double, m2 double")
    masks = spark.createDataFrame([("a", 1, [True, True, False])], "field string, horizon int, mask array<boolean>")
    sums = gram(wide, models, masks=masks)
    assert sums.agg(F.sum("n")).first()[0] == 15 and gram(wide, models).agg(F.sum("n")).first()[0] == 8
    fit = oof_weights(sums, models, masks=masks).where("held IS NULL").first()
    assert fit["samples"] == 15 and fit["weights"][2] == 0 and sum(fit["weights"]) == pytest.approx(1)
    best = hard_winner(wide, models, masks=masks).where("held IS NULL").first()
    assert best["selection_samples"] == 15 and best["winner"] in ("m0", "m1")
    many = wide.select("*", *[(F.col("m0") + i).alias(f"x{i}") for i in range(13)])
    names = ["m0", "m1", *[f"x{i}" for i in range(13)]]
    assert len(oof_weights(gram(many, names), names).first()["weights"]) == 15


def test_gates_fail_on_nothing(spark):
    schema = "fold int, field string, horizon int, y_true double, last_value double, c double"
    wide = spark.createDataFrame([(0, "a", 1, 1.0, 2.0, None), (0, "b", 1, 1.0, 2.0, 1.5)], schema)
    got = {r["field"]: r for r in column_gate(wide, ["c"]).collect()}
    assert not got["a"]["passed"] and got["a"]["reasons"] == ["nothing comparable"] and got["b"]["passed"]
    tidy = "fold string, field string, horizon int, y_true double, y_pred double"
    none = candidate_gate(spark.createDataFrame([], tidy), spark.createDataFrame([], tidy)).collect()
    assert [(r["passed"], r["total_folds"]) for r in none] == [(False, 0)]
    one = spark.createDataFrame([("f", "a", 1, 1.0, 2.0)], tidy)
    other = spark.createDataFrame([("g", "a", 1, 1.0, 1.0)], tidy)
    apart = candidate_gate(one.withColumn("w", F.lit("x")), other.withColumn("w", F.lit("x")), by=["w"]).first()
    assert not apart["passed"] and apart["reasons"] == ["nothing comparable"]


def test_contracts_fail_on_nothing_and_keep_their_tolerance(spark):
    names = ["a_t+15_pred", "b_t+15_pred"]
    frame = lambda rows: spark.createDataFrame(rows, "series_id string, datetime string, `a_t+15_pred` double, `b_t+15_pred` double")
    time = "2025-01-01 00:00:00"
    check = lambda df, **more: {r["check"]: r["broken"] for r in forecast_frame_rules(df, ["a", "b"], [1], capacities={"a": 200.0}, **more).collect()}
    assert check(frame([]))["empty"] == 1
    good = frame([("s", time, 200.0000005, -5e-7)])
    assert not any(check(good).values()) and check(frame([("s", time, 200.00001, 1.0)]))["capacity_a"] == 1
    assert check(good, origins=frame([("s", "2025-01-01 00:15:00", 1.0, 1.0)]))["origins"] == 2
    assert names == good.columns[2:]
    plan = lambda rows, **more: {r["check"]: r["broken"] for r in plan_frame_rules(
        spark.createDataFrame(rows, "datetime string, opt_x double"), **more).collect()}
    assert plan([])["empty"] == 1 and plan([("t", -1e-12)])["negative"] == 0 and plan([("t", -1e-6)])["negative"] == 1
    assert plan([("t", 1.0), ("t", 2.0), (None, 1.0)])["unique_time"] == 1 and plan([(None, 1.0)])["no_time"] == 1
    with pytest.raises(ContractError):
        plan([("t", 1.0)], columns=["opt_y"])
    inputs = "series_id string, pos long, x double"
    rows = input_frame_rules(spark.createDataFrame([], inputs), ["x"]).collect()
    assert [r["status"] for r in rows] == ["failed"]
    some = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 1.0)], inputs)
    assert input_frame_rules(some, ["x"], rows=2).first()["status"] == "passed"
    assert input_frame_rules(some, ["x"], rows=3).first()["status"] == "failed"
    want = spark.createDataFrame([("s", 2), ("s", 3), ("t", 1)], "series_id string, pos long")
    got = {r["series_id"]: (r["missing"], r["unexpected"], r["status"]) for r in input_frame_rules(some, ["x"], origins=want).collect()}
    assert got == {"s": (1, 1, "failed"), "t": (1, 0, "failed")}


def test_join_small_beyond_its_bound(spark):
    rows = spark.range(20).withColumn("k", F.col("id") % 3)
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert join_small(rows, table, ["k"], "left").where("v IS NOT NULL").count() == 14
    large = join_small(rows, table, ["k"], "left", limit=1)
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
    assert large.where("v IS NOT NULL").count() == 14 and large.count() == 20


def test_fallback_folder_where_none_is_set(spark, monkeypatch):
    from slotwise import session

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = spark.sparkContext

    assert session.checkpoint_folder(Unset) == session.checkpoint_folder(Unset) != ""


def test_pivot_index_is_exact_and_spares_visits(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 50, (12, 6))
    points = np.concatenate([c + rng.normal(0, 1, (100, 6)) for c in centres])
    points[5] = points[6]  # a tie
    rows = [("g", i, v.tolist()) for i, v in enumerate(points)] + [("h", i, v.tolist()) for i, v in enumerate(points[:3])] + [("g", 9999, None)]
    table = spark.createDataFrame(rows, "g string, id long, v array<double>")
    index = PivotIndex(table, ["g"], "v", "id", chunk=50)
    got = {}
    for r in index.nearest(table, 4, "v", "id", same=False).collect():
        got.setdefault((r.g, r.query), []).append((r["rank"], r.neighbour, r.distance))
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for i in range(len(points)):
        near = [j for j in np.lexsort((np.arange(len(points)), gap[i])) if j != i][:4]
        assert [(k, j) for k, j, _ in sorted(got["g", i])] == [(k + 1, j) for k, j in enumerate(near)]
    assert [len(got["h", i]) for i in range(3)] == [2, 2, 2] and ("g", 9999) not in got
    chunks = len(points) / 50
    sent = sum(v.where("g = 'g'").count() for v in index.visits) / len(points)
    assert sent < chunks / 4  # a plan without an index sends every query to every chunk
    assert index.nearest(table.limit(0), 4, "v", "id").count() == 0
    assert PivotIndex(table.limit(0), ["g"], "v", "id").nearest(table, 4, "v", "id").count() == 0


def test_pivot_index_sends_a_query_a_fixed_number_of_times(spark):
    # vectors without clusters: a query has to see all pieces, but not one for every 20 rows
    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, v array<float>")
    index = PivotIndex(table, [], "v", "id", chunk=20)
    asked = table.where("id % 50 = 0")
    got = {(r["query"], r["rank"]): r.neighbour for r in index.nearest(asked, 3, "v", "id", same=False).collect()}
    exact = points.astype(float)
    for i in range(0, 3000, 50):
        gap = np.sqrt(((exact - exact[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(gap, kind="stable")[:3].tolist()
    sent = sum(v.count() for v in index.visits) / 60
    assert sent < 60  # 150 chunks of 20 rows
