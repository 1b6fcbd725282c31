import random

import numpy as np
import pytest

from netquarry.operators import profile


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_describe_against_numpy(spark, monkeypatch, accuracy):
    """With coarse sketches the brackets are wide and values lie on their edges; the quartiles stay exact."""
    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    for n in (1, 2, 3, 4, 7, 200):
        rows = [
            (rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.gauss(0, 5), float(rng.randrange(4)), None, rng.choice(["x", "7", "1e3", "-2"])) for _ in range(n)
        ]
        df = spark.createDataFrame(rows, "a double, b double, none double, `some text` string").repartition(3)
        found = {r.column: r for r in profile.describe(df, ["a", "b", "none", "some text"]).collect()}
        assert found["none"]["count"] == 0 and found["none"].p50 is None and found["none"].mean is None
        for i, name in ((0, "a"), (1, "b"), (3, "some text")):
            values = [float(r[i]) for r in rows if r[i] not in (None, "x") and r[i] == r[i]]
            r = found[name]
            assert r["count"] == len(values)
            if values:
                want = [np.mean(values), min(values), *np.quantile(values, [0.25, 0.5, 0.75]), max(values)]
                assert [r.mean, r.min, r.p25, r.p50, r.p75, r.max] == pytest.approx(want)
                assert r.std == (pytest.approx(np.std(values, ddof=1)) if len(values) > 1 else None)
    empty = profile.describe(df.limit(0), ["a"]).collect()
    assert [(r.column, r["count"], r.p25) for r in empty] == [("a", 0, None)]


def test_correlations_of_wide_tables_with_gaps(spark):
    """Nulls in other rows for each column, constants, values that aren't finite, far offsets, columns without any value."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(700, 12)) + np.arange(12) * 1e6
    data[:, 3] = data[:, 2] * -2 + 5
    data[:, 4] = 0.1
    data[5, 5] = np.nan
    data[6, 6] = np.inf
    gaps = rng.random(data.shape) < 0.3
    gaps[:, 7] = True
    gaps[:, 4] = False
    rows = [[None if g else float(v) for v, g in zip(r, h, strict=True)] for r, h in zip(data, gaps, strict=True)]
    names = [f"x {i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    for block in (16, 8192):
        found = {(r.a, r.b): r.r for r in profile.correlations(df, names, block=block, fan_in=3).collect()}
        assert len(found) == 66
        for i in range(12):
            for j in range(i + 1, 12):
                both = ~gaps[:, i] & ~gaps[:, j]
                got = found[names[i], names[j]]
                if not both.any():
                    assert got is None
                elif 4 in (i, j) or not np.isfinite(data[both][:, [i, j]]).all():
                    assert np.isnan(got)
                else:
                    assert abs(got - np.corrcoef(data[both, i], data[both, j])[0, 1]) < 1e-9
    assert {r.r for r in profile.correlations(df.limit(0), names).collect()} <= {None}
