"""Order statistics and row numbers against sorted lists."""

from __future__ import annotations

import random

import numpy as np
import pytest

from terravane.operators.order import numbered, quantiles, selected


def values(rng, kind, n):
    return {
        "spread": lambda: rng.uniform(-1e6, 1e6), "few": lambda: float(rng.randrange(5)), "powers": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300),
        "huge": lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 1.0]), "close": lambda: 1.0 + rng.randrange(1000) * 2.0**-52,
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "few", "powers", "huge", "close"])
def test_selected(spark, kind):
    rng = random.Random(kind)
    make = values(rng, kind, 0)
    groups = {"a": [make() for _ in range(3000)], "b": [make()], None: [make() for _ in range(77)], "c": []}
    rows = [(g, v) for g, of in groups.items() for v in of] + [("a", None), ("a", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    places = [(g, p) for g in groups for p in (0, 1, 40, 1500, 2999, 3000, -1)]
    got = {(r["g"], r["place"]): r["v"] for r in selected(df, ["g"], "v", spark.createDataFrame(places, "g string, place long")).collect()}
    assert got == {(g, p): sorted(groups[g])[p] for g, p in places if 0 <= p < len(groups[g])}


def test_quantiles(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 9) for _ in range(1001)], "b": [3.0, 8.0], None: [1.0], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, of in groups.items() for v in of], "g string, v double")
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in quantiles(df, "g", "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    assert got.keys() == groups.keys() and got["none"] == (None, None, None)
    for g in ("a", "b", None):
        assert got[g] == pytest.approx([np.quantile(groups[g], q) for q in (0.05, 0.5, 1.0)])
    assert quantiles(df.limit(0), "g", "v", {"mid": 0.5}).count() == 0


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "id int, x int").repartition(6), "x", "id").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r["id"], r["x"]) for r in sorted(got, key=lambda r: r["number"])] == want
    assert sorted(r["number"] for r in got) == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "id int, x int"), "x").count() == 0
