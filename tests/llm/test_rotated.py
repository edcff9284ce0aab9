from __future__ import annotations

import numpy as np
import pytest

from terravane.llm import rotated


def brute(rows, threshold=0.98):
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sound = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if sound[i] and sound[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: (links[i], rows[find(i)][0]) for i in range(len(rows))}


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_as_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.standard_normal(32) * 0.14], i % 3) for i in range(300)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 32, 1), (402, [float("nan")] + [1.0] * 31, 1), (403, [None] + [1.0] * 31, 1), (404, rows[0][1], None), (405, [], 1), (406, rows[1][1][:16], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rotated.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_bands_miss_few(spark):
    rng = np.random.default_rng(3)
    n, d = 6000, 32
    base = rng.standard_normal((n // 2, d))
    twin = base + rng.standard_normal((n // 2, d)) * 0.15
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, twin]).astype(np.float32))]
    units = rotated.unit(np.concatenate([base, twin]).astype(np.float32).astype(float))
    cosines = units @ units.T
    want = int((np.triu(cosines >= 0.98, 1)).sum())
    got = rotated.links(spark.createDataFrame(rows, SCHEMA)).groupBy().sum("n_links").first()[0] // 2
    assert rotated.bands(n, 0.98)[0] > 0 and 0.98 * want <= got <= want


@pytest.mark.parametrize(("n", "d"), [(20_000, 32), (20_000, 256), (300_000, 64)])
def test_bands_at_the_threshold(n, d):
    """20,000 pairs with a cosine of exactly 0.98, in the bands of a label of n vectors."""
    rng = np.random.default_rng(n + d)
    base = rotated.unit(rng.standard_normal((20_000, d)))
    side = rng.standard_normal((20_000, d))
    side = rotated.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    bits, number = rotated.bands(n, 0.98)
    left, right = (rotated.band_keys(x, bits, number) for x in (base, 0.98 * base + np.sqrt(1 - 0.98**2) * side))
    missed = 1 - (left == right).any(axis=1).mean()
    print(f"missed {n} {d} {bits} {number} {missed:.5f}")
    assert bits > 0 and missed <= 0.003


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], SCHEMA)
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in rotated.links(df).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert rotated.links(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    a, b = rotated.unit(rng.standard_normal((400, 64))), rotated.unit(rng.standard_normal((400, 64)))
    turn = rotated.rotation(64, 0).T
    turned = a @ turn
    codes = np.where(turned > 0, 1.0, -1.0) / 8
    factor = (codes * turned).sum(axis=1)
    estimate = (codes / factor[:, None]) @ (b @ turn).T
    off = estimate - a @ b.T
    assert abs(off.mean()) < 0.002
    assert (np.abs(off) <= rotated.EPSILONS * np.sqrt((1 - factor**2) / factor**2 / 63)[:, None]).mean() > 0.999


def test_one_id_under_two_labels(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 2), (2, [1.0, 0.001], 1), (9, [0.001, 1.0], 2)]
    got = rotated.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(2, 1, 2), (5, 1, 2), (5, 1, 5), (9, 1, 5)]
