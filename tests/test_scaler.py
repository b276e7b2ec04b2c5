"""Moments of features against plain ones."""

import math

import pytest

from tidewatch.operators import tiers as T


def test_scaler_equals_plain_moments(spark):
    nan, inf = float("nan"), float("inf")
    data = [(float(i), 1e6 + i % 3, nan if i % 2 else float(i), None, inf if i == 3 else 1.0, 5.0) for i in range(50)]
    rows = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double").repartition(7)
    sc = T.fit_scaler(rows, tuple("abcdef"))
    assert sc["a"] == (pytest.approx(24.5), pytest.approx(math.sqrt((50**2 - 1) / 12)))
    b = [1e6 + i % 3 for i in range(50)]
    assert sc["b"][1] == pytest.approx(math.sqrt(sum((x - sum(b) / 50) ** 2 for x in b) / 50), rel=1e-9)
    c = [float(i) for i in range(0, 50, 2)]
    assert sc["c"] == (pytest.approx(24.0), pytest.approx(math.sqrt(sum((x - 24) ** 2 for x in c) / 25)))
    assert sc["d"] == (0.0, 1.0) and sc["e"] == (inf, 1.0) and sc["f"] == (5.0, 1.0)
    assert T.fit_scaler(rows.limit(0), ("a",)) == {"a": (0.0, 1.0)}
