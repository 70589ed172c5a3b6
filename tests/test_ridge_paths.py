import numpy as np
import pytest

from slotwise.plans.ridge_paths import predict_paths, ridge_paths, unsolved

FAMILIES = {"one": ["a"], "all": ["a", "b", "flat"]}
ALPHAS = (0.1, 10.0)


def _rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for target in ("p", "q"):
        for i in range(200):
            a, b = rng.normal(50.0, 3.0), rng.normal()
            missing = i % 17 == 0
            y = None if i % 31 == 0 else 0.3 * a - b + rng.normal() * 0.1
            out.append((target, i, a, None if missing else b, 7.0, y, 2.0 * a + rng.normal()))
    return out, spark.createDataFrame(out, "field string, pos long, a double, b double, flat double, y1 double, y4 double")


def test_all_settings_against_direct_fits(spark):
    rows, frame = _rows(spark)
    models = ridge_paths(frame, {1: "y1", 4: "y4"}, FAMILIES, ALPHAS)
    found = {(m["field"], m["family"], m["alpha"], m["horizon"]): m for m in models.collect()}
    assert len(found) == 2 * 2 * 2 * 2
    for target in ("p", "q"):
        mine = [r for r in rows if r[0] == target and r[5] is not None]
        x = np.array([[r[2], np.nan if r[3] is None else r[3], r[4]] for r in mine])
        middle = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), middle, x)
        for family, columns in (("one", [0]), ("all", [0, 1, 2])):
            scale = x[:, columns].std(axis=0)
            scale[scale < 1e-9] = 1.0
            z = (x[:, columns] - x[:, columns].mean(axis=0)) / scale
            for horizon, place in ((1, 5), (4, 6)):
                y = np.array([r[place] for r in mine])
                for alpha in ALPHAS:
                    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(columns)), z.T @ (y - y.mean())) / scale
                    m = found[target, family, alpha, horizon]
                    assert m["rows"] == len(mine) and m["medians"] == pytest.approx(middle.tolist())
                    assert [m["coefficients"][i] for i in columns] == pytest.approx(w.tolist(), abs=1e-9)
                    assert m["intercept"] == pytest.approx(y.mean() - (x[:, columns].mean(axis=0) - middle[columns]) @ w)
    left = unsolved(frame, models, {1: "y1", 4: "y4"}, FAMILIES["all"]).collect()
    assert len(left) == len(found) and max(r["residual"] for r in left) < 1e-9
    assert unsolved(frame.withColumn("y1", frame.y1 + frame.a), models, {1: "y1", 4: "y4"}, FAMILIES["all"]).where(
        "horizon = 1").agg({"residual": "min"}).first()[0] > 0.1
    told = predict_paths(frame.where("pos = 17"), models, FAMILIES["all"]).where("field = 'p' AND family = 'all'")
    assert told.count() == 4 and told.where("predicted IS NULL").count() == 0


def test_no_rows_give_no_models(spark):
    _, frame = _rows(spark)
    assert ridge_paths(frame.limit(0), {1: "y1"}, FAMILIES, ALPHAS).count() == 0
    with pytest.raises(ValueError):
        ridge_paths(frame, {1: "y1"}, FAMILIES, (0.0,))
