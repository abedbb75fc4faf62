"""The degradation classifier against a plain fit, and its report."""

import random

import numpy as np
import pytest

from stresslens.operators import degradation
from stresslens.operators.fit import Network, class_loss

CLASSES = ("blur", "clean", "color", "noise")


def table(spark, n=400):
    r, rows = random.Random(6), []
    for i in range(n):
        f = r.choice(["blur", "noise", "noise", "noise", "clean", "color"])
        a = r.gauss({"blur": -2, "noise": 2}.get(f, 0), 0.6)
        rows.append((i, f, a, r.choice([None, float("nan"), r.gauss(1e3, 5), float("inf")])))
    return rows, spark.createDataFrame([*rows, (n, "other", 1.0, 1.0), (n + 1, None, 1.0, 1.0)], "id long, family string, sharp double, width double").repartition(4)


def test_losses_equal_a_plain_fit(spark):
    rows, d = table(spark)
    got = degradation.train(d, "family", ("sharp", "width"), CLASSES, hidden=5, rounds=25)
    x = np.array([[a, 1.0, *((w, 1.0) if w is not None and np.isfinite(w) else (0.0, 0.0))] for _, _, a, w in rows])
    y = np.array([CLASSES.index(f) for _, f, *_ in rows])
    mean, scale = x.mean(0), x.std(0)
    for j in (1, 3):
        mean[j], scale[j] = 0, 1
    np.testing.assert_allclose([got.mean, got.scale], [mean, scale], rtol=1e-9)
    plain = Network([4, 5, 4], "relu", 20260828)
    want = plain.train((x - mean) / scale, class_loss(y, 4), rounds=25, rate=0.05)
    np.testing.assert_allclose(got.losses, want, rtol=1e-7)
    assert got.losses[-1] < 0.8 * got.losses[0]


def test_report_and_confusion(spark):
    rows, d = table(spark)
    r = degradation.train(d, "family", ("sharp", "width"), CLASSES, hidden=8, rounds=60)
    told = degradation.report(d, r)
    out = {x.id: x for x in told.collect()}
    assert len(out) == len(rows) + 2
    for x in out.values():
        assert x.weak_here == (x.told_family in degradation.HARD) and 0.25 <= x.confidence <= 1 and x.second != x.told_family
        assert (x.caveat is not None) == ({x.told_family, x.second} == {"clean", "color"})
    c = {x.family: x for x in degradation.confusion(told.where(told.family.isin(*CLASSES)), "family").collect()}
    assert c["blur"].recall > 0.9 and c["noise"].recall > 0.9 and c["clean"].most_confused == "color"
    for f in CLASSES:
        own = [out[i].told_family for i, g, *_ in rows if g == f]
        assert c[f].n == len(own) and c[f].recall == round(own.count(f) / len(own), 6)


def test_no_rows(spark):
    _, d = table(spark, 4)
    with pytest.raises(ValueError, match="no row"):
        degradation.train(d.limit(0), "family", ("sharp",), CLASSES)
